"""Sanitiser patches: propose, verify all at once, and repeat file by file."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.operators import diffs, findings, parse
from tracegrain.operators.tables import cut

# The sanitiser of each category and the import it needs.
FIX = {"EXEC": "shlex.quote", "FILE": "os.path.basename", "XSS": "html.escape", "REDIRECT": "urllib.parse.quote", "XXE": "defusedxml.fromstring"}
IMPORT = {"shlex.quote": "import shlex", "os.path.basename": "import os.path", "html.escape": "import html", "urllib.parse.quote": "import urllib.parse"}
REFUSED = {
    "SQL": "needs a parameterised statement", "DESER": "needs another data format", "NET": "needs a list of allowed hosts",
    "CRYPTO": "needs a choice of algorithm and a migration", "CRED": "needs a secret store", "UPLOAD": "needs a policy for stored files",
}
#: What is put around a sink's text to see whether its class of sanitiser kills the flow.
PROBE = {
    "SQL": "sqlalchemy.sql.text", "XSS": "html.escape", "FILE": "os.path.basename", "EXEC": "shlex.quote", "NET": "urllib.parse.urlparse",
    "REDIRECT": "urllib.parse.urlparse", "DESER": "json.loads", "CRYPTO": "hashlib.sha256", "CRED": "os.getenv", "UPLOAD": "os.path.basename",
    "XXE": "defusedxml.fromstring",
}
SCHEMA = "path string, trace_id string, category string, refused boolean, rationale string, patched string, line_delta int"


def wrap(source: str, line: int, call: str, position: int, sanitiser: str) -> str | None:
    """The source with one argument of the call on that line wrapped, and the import; None if it can't be located."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and n.lineno == line and parse.dotted(n.func) == call and position < len(n.args):
            a = n.args[position]
            if a.lineno != a.end_lineno:
                return None
            lines = source.split("\n")
            raw = lines[a.lineno - 1].encode()
            body = raw[: a.col_offset] + sanitiser.encode() + b"(" + raw[a.col_offset : a.end_col_offset] + b")" + raw[a.end_col_offset :]
            lines[a.lineno - 1] = body.decode()
            need = IMPORT.get(sanitiser)
            if need and need not in lines:
                at = max((s.end_lineno for s in tree.body if isinstance(s, ast.Import | ast.ImportFrom)), default=0)
                lines.insert(at, need)
            return "\n".join(lines)
    return None


def sanitise(source: str, category: str, line: int, call: str, position: int) -> tuple[str | None, str]:
    """The default backend: (patched source or None, reason)."""
    if category not in FIX:
        return None, REFUSED.get(category, "no sanitiser is known")
    out = wrap(source, line, call, position, FIX[category])
    return out, f"wraps the argument in {FIX[category]}" if out else "the argument can't be located"


def propose(traces: DataFrame, sources: DataFrame, backend: Callable = sanitise) -> DataFrame:
    """A proposal for each trace; ``backend`` is any function of (source, category, line, call, position)."""

    def f(batches):
        for pdf in batches:
            rows = []
            for path, tid, cat, line, call, arg, source in pdf.itertuples(index=False):
                position = int(arg[4:]) if arg.startswith("pos:") and arg[4:].isdigit() else -1
                out, why = backend(source, cat, int(line), call, position) if position >= 0 else (None, "no positional argument")
                rows.append((path, tid, cat, out is None, why, out, out.count("\n") - source.count("\n") if out else 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    joined = traces.join(sources.hint("merge"), "path").select("path", "trace_id", "category", "sink_line", "sink_call", "sink_arg", "source")
    return joined.mapInPandas(f, SCHEMA)


def verify(proposals: DataFrame, sources: DataFrame) -> DataFrame:
    """Every proposal rescanned in one job: accepted if it parses, the flow is gone and none is new."""
    made = proposals.where("not refused").withColumn("patch", F.concat_ws("|", "path", "trace_id"))
    after = cut(parse.parse(made.select(F.col("patch").alias("path"), F.col("patched").alias("source"))))
    before = cut(parse.parse(made.join(sources.hint("merge"), "path").select(F.col("patch").alias("path"), "source")))
    entries = diffs.diff(
        findings.flows(before).select(F.struct("path", "trace_id").alias("k"), "sink_line"), findings.flows(after).select(F.struct("path", "trace_id").alias("k"), "sink_line"), "k"
    ).select(F.col("k.path").alias("patch"), F.col("k.trace_id").alias("trace_id"), "outcome")
    status = diffs.patch_status(entries, ["patch"], made.select("patch", "trace_id"))
    bad = after.where("error is not null").select(F.col("path").alias("patch"), F.lit(False).alias("parses"))
    out = made.select("path", "trace_id", "category", "patch").join(status.drop("trace_id").hint("merge"), "patch", "left").join(bad.hint("merge"), "patch", "left")
    out = out.withColumn("parses", F.coalesce("parses", F.lit(True)))
    return out.withColumn("accepted", F.coalesce("accepted", F.lit(False)) & F.col("parses")).drop("patch")


def repair(sources: DataFrame) -> DataFrame:
    """(path, patched, applied): patches applied one after another, the worklist being derived anew after each.

    A file is done when every hit that is left has been tried; each patch leaves fewer hits.

    Only within a file does one patch depend on the last, so files run side by side.
    """

    def hits(source: str) -> list[tuple]:
        out = []
        for row in parse.facts("x", source):
            for h in row[17] or []:
                if h[6] and h[3] is not None and not h[12] and not h[13]:
                    cat = parse.R.SINKS[h[0]][0]
                    if cat not in h[7] and h[3] in parse.R.SINKS[h[0]][1]:
                        out.append((row[4], cat, h[2], h[1], h[3]))
        return out

    def f(batches):
        for pdf in batches:
            rows = []
            for path, source in zip(pdf["path"], pdf["source"], strict=True):
                left, applied, tried = hits(source), 0, set()
                while todo := [h for h in left if h not in tried]:
                    tried.add(todo[0])
                    out, _why = sanitise(source, *todo[0][1:])
                    if out is not None and len(after := hits(out)) < len(left):
                        source, left, applied, tried = out, after, applied + 1, set()
                rows.append((path, source, applied))
            yield pd.DataFrame(rows, columns=["path", "patched", "applied"])

    return sources.select("path", "source").mapInPandas(f, "path string, patched string, applied int")


def probed(traces: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, trace_id, category, probe): the source with the text between the sink call's brackets wrapped, up to the first that closes; null if it isn't there."""
    line = F.get(F.split("source", "\n", -1), F.col("sink_line") - 1)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in PROBE.items() for x in kv]), F.col("category"))
    token = F.concat("sink_call", F.lit("("))
    joined = traces.join(sources.select("path", "source").hint("merge"), "path").withColumns({"line": line, "token": token, "wrap": name})
    joined = joined.withColumns({"at": F.expr("instr(line, token)"), "head": F.expr("substr(line, 1, instr(line, token) + length(token) - 1)")})
    joined = joined.withColumn("rest", F.expr("substr(line, length(head) + 1)")).withColumn("end", F.expr("instr(rest, ')')"))
    made = F.expr("concat(head, wrap, '(', substr(rest, 1, end - 1), ')', substr(rest, end))")
    put = F.transform(F.split("source", "\n", -1), lambda x, i: F.when(i == F.col("sink_line") - 1, made).otherwise(x))
    whole = F.when((F.col("at") > 0) & (F.col("end") > 1), F.array_join(put, "\n"))
    return joined.select("path", "trace_id", "category", whole.alias("probe"))


def kills(traces: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, trace_id, category, killed): whether no flow is left in the probe; null where there is none."""
    probes = cut(probed(traces, sources).withColumn("key", F.concat_ws("|", "path", "trace_id")))
    scanned = parse.parse(probes.where("probe is not null").select(F.col("key").alias("path"), F.col("probe").alias("source")))
    left = findings.flows(scanned).select(F.col("path").alias("key")).distinct().withColumn("left", F.lit(True))
    killed = F.when(F.col("probe").isNotNull(), F.col("left").isNull())
    return probes.join(left.hint("merge"), "key", "left").select("path", "trace_id", "category", killed.alias("killed"))


def rendered(status: DataFrame) -> DataFrame:
    """(line): patches by what became of them; refused ones were declined."""
    what = F.when(F.col("refused"), "declined").when(F.col("accepted"), "accepted").otherwise("rejected")
    shown = F.format_string("%-8s %s %s: %s", what, "path", "category", "rationale")
    return status.withColumn("what", what).orderBy("what", "path", "trace_id").select(shown.alias("line"))
