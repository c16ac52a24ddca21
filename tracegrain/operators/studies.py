"""Studies over records: coverage, rates with intervals, splits, ties, profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.functions import scalars as S


def coverage(rows: DataFrame, by: list[str], expected: str, reported: str) -> DataFrame:
    """Of the expected classes (arrays), how many are reported, missed and spurious, and the share."""
    n = {
        "expected": F.size(expected), "covered": F.size(F.array_intersect(expected, reported)),
        "missed": F.size(F.array_except(expected, reported)), "spurious": F.size(F.array_except(reported, expected)),
    }
    g = rows.groupBy(*by).agg(*[F.sum(c).alias(k) for k, c in n.items()])
    return g.withColumn("rate", S.ratio(F.col("covered"), F.col("expected")))


def confusion(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn; precision, recall, f1 and false positive rate; abstentions are null predictions."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    cells = {"tp": t & p, "fp": ~t & p, "fn": t & ~p, "tn": ~t & ~p, "abstained": F.col(predicted).isNull()}
    g = rows.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in cells.items()])
    n_rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") + F.col("abstained")
    precision, recall = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumns({
        "precision": precision, "recall": recall, "f1": S.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "fpr": S.ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        # of the rows that are decided at all: how many there are, and how many of them are right
        "coverage": S.ratio(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), n_rows),
        "selective_precision": S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "abstention": S.ratio(F.col("abstained"), n_rows),
    })


def intervals(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    g = rows.groupBy(*by).agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return g.withColumns({"low": low, "high": high})


def bootstrap(rows: DataFrame, value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(mean, low, high): the 95 % interval by percentile index of resampled means.

    A resample weighs each row by a Poisson(1) draw, the form of the bootstrap that
    needs neither the row count nor all rows in one place.  Rows are first counted
    by value; the weights of n equal rows sum up to a Poisson(n) draw, from a
    generator that the value names.  Each task sums its values' draws for all
    resamples, so it gives ``resamples`` rows however many values it has.
    """

    def f(batches):
        total, weighted = np.zeros(resamples), np.zeros(resamples)
        for pdf in batches:
            for x, n, h in zip(pdf["x"], pdf["n"], pdf["h"], strict=True):
                w = np.random.default_rng([seed, int(h) & (2**63 - 1)]).poisson(n, resamples)
                total += w
                weighted += w * x
        yield pd.DataFrame({"r": np.arange(resamples), "w": total, "wx": weighted})

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    drawn = counts.select("x", "n", F.xxhash64("x").alias("h")).mapInPandas(f, "r long, w double, wx double")
    means = drawn.groupBy("r").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    every = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # ``resamples`` numbers
    low, high = int(resamples * 0.025), int(resamples * 0.975)
    mean = rows.agg(F.avg(value).alias("mean"))
    return every.crossJoin(mean).select("mean", F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))


def label_ties(rows: DataFrame, vector: list[str], label: str) -> DataFrame:
    """Identical vectors with more than one label."""
    g = rows.where(F.col(label).isNotNull()).groupBy(*vector).agg(F.countDistinct(label).alias("labels"), F.count(F.lit(1)).alias("rows"))
    return g.where("labels > 1")


def grouped_split(rows: DataFrame, group: str, label: str, share: float = 0.25) -> DataFrame:
    """``rows`` with side: of each label's groups in hash order, the first with ``share`` of its rows are test.

    A group with several labels can be on both sides; ``leaked`` marks it.
    """
    groups = rows.groupBy(label, group).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(label).orderBy(F.md5(F.col(group).cast("string")), group)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(label))})
    groups = groups.withColumn("side", F.when(F.col("at") < share * F.col("all"), "test").otherwise("train"))
    sides = groups.groupBy(group).agg((F.countDistinct("side") > 1).alias("leaked"))
    return rows.join(groups.select(label, group, "side"), [label, group]).join(sides, group)


def partition_by(rows: DataFrame, sets: list[str], outcome: str) -> DataFrame:
    """Counts by outcome for each of ``sets`` and in all, one pass."""
    grouping = [[F.col(s), F.col(outcome)] for s in sets] + [[F.col(outcome)]]
    return rows.groupingSets(grouping, *sets, outcome).agg(F.count(F.lit(1)).alias("n"))


def profile(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """(by, leader, best, next_best, margin): who leads each capability and by how much."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc(), F.col(name))
    top = rows.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    g = top.groupBy(by).agg(
        F.max(F.when(F.col("__n") == 1, F.col(name))).alias("leader"), F.max(F.when(F.col("__n") == 1, F.col(value))).alias("best"),
        F.max(F.when(F.col("__n") == 2, F.col(value))).alias("next_best"),
    )
    return g.withColumn("margin", F.col("best") - F.coalesce("next_best", F.lit(0)))


def pair_violations(rows: DataFrame, pair: str, kind: str, body: str) -> DataFrame:
    """Pairs that don't have one row of each kind, or whose bodies are equal."""
    g = rows.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kind).alias("kinds"), F.countDistinct(body).alias("bodies"))
    return g.where("n <> 2 or kinds <> 2 or bodies <> 2")


def mitigation(rows: DataFrame, pair: str, kind: str, classes: str, label: str) -> DataFrame:
    """(measurable, noticed, missed): pairs whose vulnerable side shows the label, and those whose patched side no longer does."""
    has = lambda k: F.max(F.when(F.col(kind) == k, F.array_contains(classes, F.col(label))))
    g = rows.groupBy(pair).agg(has("vulnerable").alias("v"), has("patched").alias("p"))
    return g.agg(
        F.count(F.when(F.col("v"), 1)).alias("measurable"), F.count(F.when(F.col("v") & ~F.col("p"), 1)).alias("noticed"),
        F.count(F.when(F.col("v") & F.col("p"), 1)).alias("missed"),
    )


def rank_agreement(rows: DataFrame, by: str, rank: str, first: Column, second: Column) -> DataFrame:
    """(pairs, agree): how many pairs of a ``first`` and a ``second`` row rank the first one before.

    Counted by running sums over the ranking, not by pairs.
    """
    w = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({"__a": first.cast("long"), "__b": second.cast("long")})
    ahead = marked.withColumn("__s", F.coalesce(F.sum("__a").over(w), F.lit(0)))
    g = ahead.groupBy(by).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"), F.sum(F.col("__b") * F.col("__s")).alias("agree"))
    return g.select(by, (F.col("a") * F.col("b")).alias("pairs"), F.col("agree").cast("long").alias("agree"))


def stability(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.when(F.col(a).eqNullSafe(F.col(b)), 1)).alias("stable"), F.count(F.lit(1)).alias("n"))


def tool_medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The element at half the sorted size, by rank, so that no group is collected."""
    w = Window.partitionBy(by)
    r = rows.withColumns({"__n": F.row_number().over(w.orderBy(value)), "__all": F.count(F.lit(1)).over(w)})
    return r.where(F.col("__n") == F.floor(F.col("__all") / 2) + 1).select(by, F.col(value).alias("median"), F.col("__all").alias("n"))


def agreement(a: DataFrame, b: DataFrame, key: list[str], facts: list[str], by: list[str]) -> DataFrame:
    """(stable, n, rate) by ``by``: how many keys have equal sets of facts in two runs.  A key of one run alone isn't stable."""
    prints = [r.groupBy(*key, *by).agg(F.sort_array(F.collect_set(F.struct(*facts))).alias(n)) for r, n in ((a, "x"), (b, "y"))]
    both = prints[0].join(prints[1], [*key, *by], "full_outer")
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    g = both.groupBy(*by).agg(F.count(F.when(same, 1)).alias("stable"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("rate", S.ratio(F.col("stable"), F.col("n")))


def kill_rate(rows: DataFrame, by: list[str], killed: str) -> DataFrame:
    """(tried, killed, rate): rows without an answer weren't tried."""
    g = rows.groupBy(*by).agg(F.count(killed).alias("tried"), F.count(F.when(F.col(killed), 1)).alias("killed"))
    return g.withColumn("rate", S.ratio(F.col("killed"), F.col("tried")))


def tool_coverage(expected: DataFrame, reported: DataFrame, by: str) -> DataFrame:
    """(tool, class, expected, covered, spurious, unmapped): of each class how many records a tool names, and what it names that has none.

    expected: (by, class), distinct.  reported: (tool, by, class); a null class is a rule without a mapping.
    """
    tools = reported.select("tool").distinct()
    named = reported.where("class is not null").select("tool", by, "class").distinct()
    want = F.broadcast(tools).crossJoin(expected.select(by, "class"))  # a handful of tools
    both = want.withColumn("e", F.lit(1)).join(named.withColumn("r", F.lit(1)), ["tool", by, "class"], "full_outer")
    g = both.groupBy("tool", "class").agg(
        F.count("e").alias("expected"), F.count(F.when(F.col("e").isNotNull() & F.col("r").isNotNull(), 1)).alias("covered"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("spurious"),
    )
    unmapped = reported.where("class is null").groupBy("tool").agg(F.count(F.lit(1)).alias("unmapped"))
    return g.join(unmapped, "tool", "left").withColumn("unmapped", F.coalesce("unmapped", F.lit(0)))


def sink_matches(calls: DataFrame, reported: DataFrame, by: str) -> DataFrame:
    """``calls`` (by, call, line) with matched: whether a report (by, text, line) of the same line names the call.

    It does if its text is call@line, starts with the call, or contains it.
    """
    hit = calls.join(reported.withColumnRenamed("line", "__line"), by).where(
        (F.col("line") == F.col("__line"))
        & ((F.col("text") == F.concat_ws("@", "call", F.col("line").cast("string"))) | F.startswith("text", F.col("call")) | F.contains(F.col("text"), F.col("call")))
    )
    found = hit.select(by, "call", "line").distinct().withColumn("matched", F.lit(True))
    return calls.join(found, [by, "call", "line"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def disputed(named: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """What is named but not expected."""
    return named.select(*key).distinct().join(expected.select(*key).distinct(), key, "left_anti")


def merged_parts(parts: DataFrame, key: str, order: str, then: list[str]) -> DataFrame:
    """Of rows with one key, that of the last part; of several such, the first by ``then``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), *then)
    return parts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def repository_totals(items: DataFrame, commits: DataFrame, sets: list[str]) -> DataFrame:
    """Items by each of ``sets`` with their commits, and in all with the number of commits examined.

    items: repo, commit, cwe, tier, outcome; commits: repo, commit.
    """
    g = items.groupingSets([[F.col(c)] for c in sets] + [[]], *sets).agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("repo", "commit").alias("with_items"),
        F.count(F.when(F.col("outcome") == "introduced", 1)).alias("introduced"), F.count(F.when(F.col("outcome") == "killed", 1)).alias("killed"),
        F.min(F.grouping_id()).alias("level"),
    )
    whole = (1 << len(sets)) - 1
    n = commits.select("repo", "commit").distinct().agg(F.count(F.lit(1)).alias("examined"))
    return g.crossJoin(F.broadcast(n)).withColumn("examined", F.when(F.col("level") == whole, F.col("examined"))).drop("level")


def verification_summary(rows: DataFrame, by: str, outcome: str, similarity: str) -> DataFrame:
    """Counts of each patch outcome, and the least, upper median and greatest similarity to the true patch."""
    w = Window.partitionBy(by)
    r = rows.withColumns({"__n": F.row_number().over(w.orderBy(F.col(similarity).asc_nulls_last())), "__all": F.count(similarity).over(w)})
    kinds = ("removed", "guarded", "traded", "persists")
    return r.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(outcome) == k, 1)).alias(k) for k in kinds], F.min(similarity).alias("least"),
        F.max(F.when(F.col("__n") == F.floor(F.col("__all") / 2) + 1, F.col(similarity))).alias("median"), F.max(similarity).alias("greatest"),
    )


def invariants(rows: DataFrame, equal: dict[str, tuple[str, str]]) -> DataFrame:
    """(invariant, violations): for each name, how many rows have two expressions that differ."""
    counts = rows.agg(*[F.count(F.when(~F.expr(a).eqNullSafe(F.expr(b)), 1)).alias(n) for n, (a, b) in equal.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, equal)), F.array(*equal))).alias("invariant", "violations"))


def missing_keys(docs: DataFrame, text: str, required: list[str]) -> DataFrame:
    """``docs`` with missing: the required keys that a JSON object lacks; all of them if it is none."""
    have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return docs.withColumn("missing", F.array_except(F.array(*map(F.lit, required)), have))


def report_print(findings: DataFrame, by: list[str]) -> DataFrame:
    """What two reports have to agree in: classes, identities and origins in order, and the number of confirmed flows."""
    return findings.groupBy(*by).agg(
        F.sort_array(F.collect_set("cwe")).alias("classes"), F.sort_array(F.collect_set(F.when(F.col("trace_id") != "", F.col("trace_id")))).alias("identities"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"), F.count(F.when(F.col("detector") == "taint", 1)).alias("confirmed"),
    )
