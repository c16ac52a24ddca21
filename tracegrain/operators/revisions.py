"""Revisions of repositories as sources, and their differences.

git runs where the rows are, once for each repository of a batch; repositories have
to be reachable from the executors.
"""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.operators import diffs, findings, parse
from tracegrain.operators.tables import cut
from tracegrain.sources import readers


def _git(repo: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, check=False)
    return [x for x in done.stdout.decode("utf-8", "replace").split("\0") if x] if not done.returncode else []


def _inside(path: str) -> bool:
    return not path.startswith("/") and ".." not in path.split("/")


def _listed(requests: DataFrame, column: str, args) -> DataFrame:
    def f(batches):
        for pdf in batches:
            rows = [
                (repo, x, path, i)
                for repo, x in zip(pdf["repo"], pdf[column], strict=True)
                for i, path in enumerate(p for p in _git(repo, *args(x)) if p.endswith(".py") and _inside(p))
            ]
            yield pd.DataFrame(rows, columns=["repo", column, "path", "at"])

    return requests.select("repo", column).mapInPandas(f, f"repo string, {column} string, path string, at int")


def tree(requests: DataFrame) -> DataFrame:
    """(repo, revision, path, source): all Python files of each (repo, revision); paths that leave the tree are left out."""
    files = _listed(requests, "revision", lambda r: ("ls-tree", "-r", "-z", "--name-only", r)).drop("at")
    return readers.git_blobs(files)


def changed_files(requests: DataFrame, limit: int = 12) -> DataFrame:
    """(repo, commit, path): the first ``limit`` Python files that a commit changes, without tests."""
    every = _listed(requests, "commit", lambda c: ("diff", "--name-only", "-z", f"{c}~1", c))
    own = every.where(~F.lower("path").rlike(r"(^|/)(tests?|testing)(/|$)|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"))
    w = Window.partitionBy("repo", "commit").orderBy("at")
    return own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("repo", "commit", "path")


def replay(files: DataFrame) -> DataFrame:
    """(repo, commit, side, path, source): the files of changed_files() before and after their commit; absent ones have none."""
    sides = F.explode(F.array(
        F.struct(F.lit("before").alias("side"), F.concat("commit", F.lit("~1")).alias("revision")),
        F.struct(F.lit("after").alias("side"), F.col("commit").alias("revision")),
    ))
    asked = files.select("repo", "commit", "path", sides.alias("s")).select("repo", "commit", "path", "s.side", "s.revision")
    got = readers.git_blobs(asked)
    return asked.join(got, ["repo", "revision", "path"]).where("source is not null").select("repo", "commit", "side", "path", "source")


def diff_sources(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of two trees of (path, source): the outcome of each flow, and the files of either side that don't parse.

    Flows are told apart by path and identity.
    """
    a, b = cut(parse.parse(before)), cut(parse.parse(after))
    key = F.struct("path", "trace_id").alias("k")
    facts = ("function", "cwe", "sink", "sink_line")
    left, right = (cut(findings.flows(s).select(key, *facts)) for s in (a, b))
    entries = diffs.diff(left, right, "k")
    # facts of the side that has them, the later one if both do
    known = left.withColumn("s", F.lit(0)).unionByName(right.withColumn("s", F.lit(1))).groupBy("k").agg(F.max_by(F.struct(*facts), F.struct("s", -F.col("sink_line"))).alias("f"))
    entries = entries.join(known.hint("merge"), "k").select("k.path", "k.trace_id", "f.*", "outcome", "line_delta")
    errors = a.where("error is not null").select(F.lit("before").alias("side"), "path", "error").unionByName(
        b.where("error is not null").select(F.lit("after").alias("side"), "path", "error")
    )
    return entries, errors


def in_order(entries: DataFrame) -> DataFrame:
    """By outcome, introduced first, then by place."""
    rank = F.create_map(*[F.lit(x) for kv in diffs.OUTCOMES.items() for x in kv])
    return entries.orderBy(F.element_at(rank, F.col("outcome")), "path", "sink_line", "sink", "trace_id")


def rendered(entries: DataFrame) -> DataFrame:
    """(line): the entries, grouped by outcome."""
    shown = F.format_string("%-10s %s:%d %s in %s (%s)", "outcome", "path", "sink_line", "sink", "function", "cwe")
    return in_order(entries).select(F.when(F.col("line_delta") != 0, F.concat(shown, F.format_string(" moved by %d", "line_delta"))).otherwise(shown).alias("line"))
