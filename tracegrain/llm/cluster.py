"""Classes of similar texts from shared buckets, without all pairs of a bucket.

Members of a bucket are first compared with one of them, its centre, alone: the
member that meets most others over all its buckets, which among near copies is
the text that they vary.  Of those that aren't linked to it, the strongest is a
second centre, and the others are compared with that.  Texts linked so far fall
into classes.  Only where a bucket still holds more than one class can a link be
missing; what is outside its first centre's class is then compared with all members
of other classes, so no link between two classes is lost, however large a bucket
is, and a bucket of a thousand near copies costs about a thousand comparisons.

For that last step every text carries features.  ``near`` says of two texts'
features whether they may be linked (for certain, or with a stated chance); other
pairs don't become rows.  A pair that shares many buckets becomes a row in the
first one alone.

Rows of buckets are names only; features are joined to the rows of the buckets that
are compared across classes.  Comparisons run in groups of some ``GROUP`` pairs, so a
text that thousands are compared with is sent once for each group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

GROUP = 64
ROUNDS = 60


def compared(pairs: DataFrame, texts: DataFrame, linked: Callable[[str, list[str]], list[bool]]) -> DataFrame:
    """The (a, b) of the distinct ``pairs`` that are linked; texts: (t, text)."""

    def grouped(batches):
        # rows come sorted by a: some GROUP rows are a group, and every a that has rows in it joins it itself
        from pyspark import TaskContext

        number, last, size = TaskContext.get().partitionId() << 40, None, 0
        for pdf in batches:
            out = []
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                if size >= GROUP:
                    number, last, size = number + 1, None, 0
                if a != last:
                    last = a
                    out.append((number, a, a))
                size += 1
                out.append((number, a, b))
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["g", "a", "t"])

    # partitions by a that Spark can split where one a has very many rows
    near_a = pairs.hint("rebalance", F.col("a")).sortWithinPartitions("a")
    rows = near_a.mapInPandas(grouped, "g long, a long, t long").join(texts.hint("merge"), "t")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        centres: dict[int, str] = {}
        others: dict[int, dict[int, str]] = {}
        for a, t, text in zip(pdf["a"].tolist(), pdf["t"].tolist(), pdf["text"], strict=True):
            if a == t:
                centres[a] = text
            else:
                others.setdefault(a, {})[t] = text
        out = [(a, b) for a, by in others.items() for b, yes in zip(by, linked(centres[a], list(by.values())), strict=True) if yes]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return cut(rows.groupBy("g").applyInPandas(f, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(t, label) for both ends of every (a, b): the least t of the component.

    Large-star and small-star rounds in turn, until there are stars only; a
    component's diameter shrinks exponentially.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    for _ in range(ROUNDS):
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or n > 0 and low = 0").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        before, edges = edges, cut(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        forget(before)
    else:
        raise RuntimeError(f"components are not stable after {ROUNDS} rounds")
    out = cut(edges.select(F.col("u").alias("t"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("t"), F.col("v").alias("label")).distinct()))
    forget(edges)
    return out


def classes(
    members: DataFrame,
    features_of: Callable[[DataFrame], DataFrame],
    texts_of: Callable[[DataFrame], DataFrame],
    linked: Callable[[str, list[str]], list[bool]],
    near: Callable[[Column, Column], Column],
    first: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """(t, label) of the texts that are linked to another one, and no other rows.

    members: (b, t, indexed), rows of buckets with at least two different t; two
    members that are not indexed need no comparison.  texts_of: (t) to (t, text) of
    the same texts; features_of: those to (t, x), x being a struct of features.
    near(x, y): whether two texts may be linked.  first(b, x, y): whether b is the
    first bucket that they share.
    """
    members = cut(members)
    sizes = cut(members.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    met = cut(members.join(sizes, "b").groupBy("t").agg(F.sum("n").alias("met")))
    texts = cut(texts_of(met.select("t")))
    rows = cut(members.join(met, "t"))
    forget(sizes, members)

    def star(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The centres (b, c) and the links of all rows to them."""
        centres = cut(rows.where("indexed").groupBy("b").agg(F.max_by("t", F.struct("met", "t")).alias("c")))
        pairs = rows.join(centres, "b").where("t <> c").select(F.col("c").alias("a"), F.col("t").alias("b")).distinct()
        return centres, compared(pairs, texts, linked)

    first_centres, links = star(rows)
    rest = rows.join(first_centres, "b").where("t <> c")
    outside = cut(rest.join(links.select(F.col("a").alias("c"), F.col("b").alias("t")).hint("merge"), ["c", "t"], "left_anti").drop("c"))
    second_centres, more = star(outside)
    links = cut(links.unionByName(more))
    label = components(links)
    forget(outside, second_centres)
    marked = cut(rows.join(label.hint("merge"), "t", "left").select("b", "t", "indexed", F.coalesce("label", "t").alias("label")))
    still = marked.join(first_centres, "b").groupBy("b").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("t") == F.col("c"), F.col("label"))).alias("of_first")
    )
    still = cut(still.where("low < high").select("b", "of_first"))
    open_ = cut(marked.join(still, "b"))
    forget(rows, marked, first_centres, still)
    if open_.isEmpty():
        return label
    left = open_.select("t").distinct()
    features = cut(features_of(texts.join(left.hint("merge"), "t", "left_semi")))
    full = cut(open_.join(features.hint("merge"), "t"))
    some = full.where("label != of_first").select("b", F.col("t").alias("t1"), F.col("label").alias("l1"), F.col("x").alias("x1"), F.col("indexed").alias("i1"))
    every = full.select(
        "b", F.col("t").alias("t2"), F.col("label").alias("l2"), F.col("x").alias("x2"), F.col("indexed").alias("i2"), (F.col("label") != F.col("of_first")).alias("both")
    )
    # a pair of members that are both outside the first class would come twice
    once = ~F.col("both") | (F.col("t1") < F.col("t2"))
    cross = some.join(every.hint("merge"), "b").where(
        (F.col("l1") != F.col("l2")) & (F.col("i1") | F.col("i2")) & once & near(F.col("x1"), F.col("x2")) & first(F.col("b"), F.col("x1"), F.col("x2"))
    )
    found = compared(cross.select(F.greatest("t1", "t2").alias("a"), F.least("t1", "t2").alias("b")).distinct(), texts, linked)
    forget(features, full, open_)
    return label if found.isEmpty() else components(links.unionByName(found))
