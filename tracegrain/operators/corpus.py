"""Corpus construction: advisories, repositories, revisions and records as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.functions import scalars as S


def first_by(rows: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def distinct_content(rows: DataFrame, source: str, order: list) -> DataFrame:
    """The first of rows whose sources are equal but for indentation, blank lines and comments."""
    return first_by(rows.withColumn("fingerprint", S.fingerprint(F.col(source))), ["fingerprint"], order)


def merge_advisories(a: DataFrame, b: DataFrame, key: str, fields: list[str], commits: str) -> DataFrame:
    """``a`` with the fields that it lacks taken from its twin in ``b``, and the commits of both, in order."""
    twin = b.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.col(commits).alias("__commits"))
    empty = F.array().cast("array<string>")
    return a.join(twin, key, "left").select(
        key, *[F.coalesce(f, f"__{f}").alias(f) for f in fields],
        F.array_distinct(F.concat(F.coalesce(commits, empty), F.coalesce("__commits", empty))).alias(commits),
    )


def attribute(advisories: DataFrame, commits: DataFrame, repos: DataFrame) -> DataFrame:
    """(advisory_id, repo, how): by a commit that a repository has, else by its name; the first repository wins.

    advisories: advisory_id, commit, package.  commits: commit, repo.  repos: repo, name.
    """
    by_commit = advisories.join(commits, "commit").select("advisory_id", "repo", F.lit(0).alias("rank"))
    by_name = advisories.join(repos, F.col("package") == F.col("name")).select("advisory_id", "repo", F.lit(1).alias("rank"))
    best = by_commit.unionByName(by_name).groupBy("advisory_id").agg(F.min(F.struct("rank", "repo")).alias("x"))
    return best.select("advisory_id", "x.repo", F.when(F.col("x.rank") == 0, "commit").otherwise("name").alias("how"))


def changed_pairs(before: DataFrame, after: DataFrame, key: list[str], body: str) -> DataFrame:
    """Functions of both revisions whose bodies differ."""
    b = after.select(*key, F.col(body).alias("__after"))
    return before.join(b, key).where(F.col(body) != F.col("__after")).select(*key, F.col(body).alias("vulnerable"), F.col("__after").alias("patched"))


def densest(rows: DataFrame, hits: str, size: str, order: list, n: int) -> DataFrame:
    """The n rows of the most hits for the square root of their size."""
    density = F.col(hits) / F.sqrt(F.greatest(F.col(size), F.lit(1)))
    return rows.withColumn("density", density).orderBy(F.desc("density"), *order).limit(n)


def enclosing(lines: DataFrame, functions: DataFrame, by: str) -> DataFrame:
    """The innermost function around each (by, line): functions has by, name, start, end."""
    hit = lines.join(functions, by).where("line between start and end")
    return hit.groupBy(by, "line").agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), "name")).alias("function"))


def labelled_sections(lines: DataFrame, by: str, line: str, text: str, markers: list[str]) -> DataFrame:
    """Rows with the last marker at or before them in their file."""
    mark = F.regexp_extract(F.col(text), "(" + "|".join(markers) + ")", 1)
    w = Window.partitionBy(by).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("label", F.last(F.when(mark != "", mark), ignorenulls=True).over(w))


def evidence_tier(calls: DataFrame, by: list[str]) -> DataFrame:
    """direct-sink if a call of the snippet is a sink of the class with a variable argument; module-proximity if only the module has one."""
    g = calls.groupBy(*by).agg(F.max(F.col("direct").cast("int")).alias("d"), F.max(F.col("in_module").cast("int")).alias("m"))
    return g.select(*by, F.when(F.col("d") == 1, "direct-sink").when(F.col("m") == 1, "module-proximity").alias("tier")).where("tier is not null")
