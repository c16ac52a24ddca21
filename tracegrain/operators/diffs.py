"""Revision diffs, patch status and set algebra over identities."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.functions import scalars as S

OUTCOMES = {"introduced": 0, "killed": 1, "changed": 2, "residual": 3}


def diff(before: DataFrame, after: DataFrame, key: str = "trace_id", line: str = "sink_line") -> DataFrame:
    """(key, outcome, line_delta): each row of ``before`` against the first of ``after``, and what only ``after`` has.

    One full outer join on the identity.  All rows of ``before`` with one
    identity meet the same counterpart; a counterpart on another line is changed.
    """
    first = Window.partitionBy(key).orderBy(line)
    a = after.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(key, F.col(line).alias("__b"))
    b = before.select(key, F.col(line).alias("__a"))
    both = b.join(a, key, "full_outer")
    outcome = F.when(F.col("__b").isNull(), "killed").when(F.col("__a").isNull(), "introduced").when(F.col("__a") == F.col("__b"), "residual").otherwise("changed")
    return both.select(key, outcome.alias("outcome"), F.coalesce(F.col("__b") - F.col("__a"), F.lit(0)).cast("long").alias("line_delta"))


def verdicts(entries: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome and the verdict of each group."""
    n = {o: F.count(F.when(F.col("outcome") == o, 1)) for o in OUTCOMES}
    g = entries.groupBy(*by).agg(*[c.alias(o) for o, c in n.items()])
    return g.withColumns({"net_new": F.col("introduced") - F.col("killed"), "verdict": S.verdict(F.col("introduced"), F.col("killed"))})


def patch_status(entries: DataFrame, by: list[str], expected: DataFrame | None = None, key: str = "trace_id") -> DataFrame:
    """Whether each patch is accepted, and why not: it introduces, it kills nothing, an expected flow stays."""
    g = verdicts(entries, by)
    if expected is not None:
        killed = entries.where("outcome = 'killed'").select(*by, key).distinct()
        missing = expected.join(killed.hint("merge"), [*by, key], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("missing"))
        g = g.join(missing.hint("merge"), by, "left")
    else:
        g = g.withColumn("missing", F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.col("introduced") > 0, "introduces flows"), F.when(F.coalesce("missing", F.lit(0)) > 0, "expected flows remain"),
        F.when(F.col("killed") == 0, "nothing killed"),
    ))
    return g.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def patch_outcome(killed, introduced, guarded):
    """persists, traded, removed or guarded, in this order of priority."""
    return F.when(~killed & guarded, "guarded").when(~killed, "persists").when(introduced, "traded").otherwise("removed")


def survived(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_semi")


def only(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_anti")


def leaves(text: str | None) -> list[tuple[str, str]] | None:
    """(path, value as JSON) of a document's leaves, and the length of each list; None if it is none."""
    try:
        todo = [("", json.loads(text or ""))]
    except ValueError:
        return None
    out = []
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict) and x:
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in x.items()]
        elif isinstance(x, list):
            out.append((f"{path}[]", str(len(x))))
            todo += [(f"{path}[{i}]", v) for i, v in enumerate(x)]
        else:
            out.append((path, x if isinstance(x, str) else json.dumps(x)))
    return out


def compare_json(a: DataFrame, b: DataFrame, volatile: list[str], names: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, left, right) of leaves that differ; a, b: (id, doc) with JSON of any depth.

    Keys that are volatile are left out wherever they stand.  Values differ
    whatever separator paths in them use; of keys in ``names`` only the last part
    of the path counts.  A document that is no JSON has one leaf of an empty path.
    """

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def flat(docs: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "value": v} for p, v in found] if (found := leaves(d)) is not None else [{"path": "", "value": d}] for d in docs], dtype=object)

    keys = F.filter(F.split("path", r"\.|\[\d*\]"), lambda k: k != "")
    kept = ~F.arrays_overlap(keys, F.array(*map(F.lit, volatile)).cast("array<string>")) if volatile else F.lit(True)

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("id", F.explode(flat("doc")).alias("l")).select("id", "l.path", "l.value").where(F.coalesce(kept, F.lit(True)))
        value = F.replace("value", F.lit("\\"), F.lit("/"))
        last = F.element_at(keys, -1)
        own = F.when(last.isin(*names), F.substring_index(value, "/", -1)).otherwise(value) if names else value
        return rows.select("id", "path", F.col("value").alias(name), own.alias(f"__{name}"))

    both = side(a, "left").join(side(b, "right"), ["id", "path"], "full_outer")
    return both.where(~F.col("__left").eqNullSafe(F.col("__right"))).select("id", "path", "left", "right")


def change_similarity(rows: DataFrame, before: str, proposed: str, true: str) -> DataFrame:
    """``rows`` with similarity: the Jaccard index of the identifiers on the lines that two patches of one source touch."""

    @F.pandas_udf("array<string>")
    def touched(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (x or "").splitlines(), (y or "").splitlines()
            steps = difflib.SequenceMatcher(None, x, y).get_opcodes()
            lines = [line for tag, i, j, k, n in steps if tag != "equal" for line in (*x[i:j], *y[k:n])]
            out.append(sorted({w for line in lines for w in re.findall(r"[A-Za-z_]\w*", line, re.A)}))
        return pd.Series(out, dtype=object)

    x, y = touched(before, proposed), touched(before, true)
    return rows.withColumns({"__x": x, "__y": y}).withColumn(
        "similarity", F.when((F.size("__x") == 0) & (F.size("__y") == 0), 1.0).otherwise(S.jaccard(F.col("__x"), F.col("__y")))
    ).drop("__x", "__y")
