"""Operator 3: chat formatting with a grammar round trip, native functions only.

A conversation is rendered as turns ``<|im_start|>role\\ntext<|im_end|>\\n``.
The rendering is parsed again and the recovered turns are compared with the
source; the chunks of turns that differ, or whose roles or texts hold ``<|`` or
an escape of it, are rendered once more with such content escaped, and the
comparison is repeated.  So whether a text is escaped depends on that text alone.
The parser is deterministic and always the same: a turn ends at its first
``<|im_end|>``, after which only a line feed and a new turn may stand, and it
undoes the escape wherever it stands, so both renderings are read by one grammar.

Escape: in ``<``, k backslashes, ``|`` one more backslash is put before the bar.
Parsing takes one away.  That is a bijection, no escaped text holds a control
string, and text without such runs is left as it is, so the second comparison
cannot fail; if it did, the query would raise.

Edge cases: null texts and roles are empty; turns with equal numbers are ordered
by role and text, null numbers come first; repeated rows are turns of their own;
no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What begins a control string, escaped or not.
CONTROL = r"<\\*\|"
#: Turns that are rendered and compared together, so that no task gets a whole
#: hot conversation turn by turn.
CHUNK = 64


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role_line(c: Column) -> Column:
    """A role on one line: backslash and line feed are written with a backslash."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_of(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a rendering; null for a turn against the grammar."""

    def turn(segment: Column) -> Column:
        end = F.instr(segment, END)
        ended = (end > 0) & (end == F.length(segment) - len(END)) & F.endswith(segment, F.lit("\n"))
        body = F.left(segment, end - 1)
        at = F.instr(body, "\n")
        role = F.when(at > 0, F.left(body, at - 1)).otherwise(body)
        text = F.when(at > 0, F.substr(body, at + 1)).otherwise(F.lit(""))
        return F.when(ended, F.struct(_role_of(unescape(role)).alias("role"), unescape(text).alias("text")))

    segments = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), turn)


def _render(turns: Column, text) -> Column:
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), text(_role_line(t["role"])), F.lit("\n")).alias("head"),
            text(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")


def _spans(parts: Column) -> Column:
    """Where the assistant texts stand in the joined parts, in code points."""
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + len(END) + 1).cast("long").alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, n_turns, formatted, loss_spans, escaped), a row for each conversation.

    ``loss_spans`` are the code point ranges of ``formatted`` that a loss mask
    covers: the assistant texts.  ``escaped`` says whether a chunk needed it.
    """
    rows = df.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.floor(F.col(turn) / CHUNK), F.lit(-(2**40))).alias("chunk"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chunks = chunks.select(
        "conv", "chunk", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source")
    )
    chunks = chunks.withColumn("plain", _render(F.col("source"), lambda c: c))
    held = F.exists("source", lambda t: t["role"].rlike(CONTROL) | t["text"].rlike(CONTROL))
    chunks = chunks.withColumn("same", ~held & (parse(_joined(F.col("plain"))) == F.col("source")))
    chunks = chunks.withColumn("parts", F.when(F.col("same"), F.col("plain")).otherwise(_render(F.col("source"), escape)))
    chunks = chunks.withColumn("formatted", _joined(F.col("parts")))
    chunks = chunks.withColumn("identical", F.col("same") | (parse(F.col("formatted")) == F.col("source")))
    chunks = chunks.select(
        "conv",
        F.struct(
            "chunk",
            F.when(F.col("identical"), F.col("formatted"))
            .otherwise(F.raise_error(F.lit("a rendering does not parse back to its turns")).cast("string"))
            .alias("formatted"),
            _spans(F.col("parts")).alias("spans"),
            F.size("source").cast("long").alias("n"),
            (~F.col("same")).alias("escaped"),
        ).alias("c"),
    )
    whole = chunks.groupBy("conv").agg(F.sort_array(F.collect_list("c")).alias("c"))
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<array<struct<start:long,end:long>>>").alias("spans"),
    )
    moved = F.aggregate(
        "c",
        zero,
        lambda acc, c: F.struct(
            (acc["at"] + F.length(c["formatted"])).cast("long").alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.transform(
                        c["spans"],
                        lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: F.flatten(acc["spans"]),
    )
    return whole.select(
        F.col("conv").alias(conv),
        F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n_turns"),
        F.array_join(F.transform("c", lambda c: c["formatted"]), "").alias("formatted"),
        moved.alias("loss_spans"),
        F.exists("c", lambda c: c["escaped"]).alias("escaped"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )
