"""Call resolution and reachability over call graphs, as iterated joins.

State is a DataFrame; every round joins only what the last one added, until
that is nothing: what is known never comes again, so loops end.  Each round is written as a table in the shared folder, so lineage doesn't grow.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.functions import scalars as S
from tracegrain.operators.tables import Rounds, cut


def resolve_sinks(calls: DataFrame, aliases: DataFrame, safe: DataFrame, name: str = "name", modules: str | None = None) -> DataFrame:
    """``calls`` with sink: the alias of the best tier, the longest suffix among equals; safe names have none.

    Distinct names are resolved once: their suffixes meet the aliases by equality.
    ``modules`` names a column with the modules (whole, first and last part) that a
    bare name was imported from, which is the second of three tiers.
    """
    if modules is not None:
        plain = resolve_sinks(calls, aliases, safe, name)
        known = calls.select(name, modules).distinct()
        low = F.broadcast(aliases.where("tier = 2").select(F.col("name").alias("__n"), F.col("modules").alias("__m"), F.col("sink").alias("__s")))
        bound = known.join(low, F.col(name) == F.col("__n")).where(F.arrays_overlap(modules, "__m")).groupBy(name, modules).agg(F.min("__s").alias("__s"))
        exact = F.broadcast(aliases.where("tier = 1").select(F.col("name").alias(name)).distinct().withColumn("__exact", F.lit(True)))
        vetoed = F.broadcast(safe.select(F.col("name").alias(name)).distinct().withColumn("__safe", F.lit(True)))
        out = plain.join(bound, [name, modules], "left").join(exact, name, "left").join(vetoed, name, "left")
        # the name is bare, so only its own alias or veto comes before the binding
        sink = F.when(F.col("__safe"), None).when(F.col("__exact"), F.col("sink")).otherwise(F.coalesce("__s", "sink"))
        return out.withColumn("sink", sink).drop("__s", "__exact", "__safe")
    names = calls.select(F.col(name).alias("call")).distinct()
    tails = names.select("call", F.posexplode(S.dotted_suffixes(F.col("call"))).alias("at", "tail"))
    vetoed = tails.join(F.broadcast(safe.select(F.col("name").alias("tail"))), "tail", "left_semi").select("call").distinct()
    last = F.col("tail") == S.tail(F.col("call"))
    found = tails.join(F.broadcast(aliases.where("tier <> 2").select(F.col("name").alias("tail"), "tier", "sink")), "tail").where((F.col("tier") == 1) | last)
    best = found.groupBy("call").agg(F.min_by("sink", F.struct("tier", "at")).alias("sink")).join(vetoed, "call", "left_anti")
    return calls.join(best.withColumnRenamed("call", name), name, "left")


def resolve_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(callee) to target: the function of that name, else the least of those with its last segment."""
    exact = functions.select(F.col("qualname").alias("callee"), F.col("qualname").alias("exact")).distinct()
    by_tail = functions.groupBy(S.tail(F.col("qualname")).alias("last")).agg(F.min("qualname").alias("near"))
    out = calls.join(exact.hint("merge"), "callee", "left").withColumn("last", S.tail(F.col("callee"))).join(by_tail.hint("merge"), "last", "left")
    return out.withColumn("target", F.coalesce("exact", "near")).drop("exact", "near", "last")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) that nobody calls."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct().hint("merge"), "node", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entry, node, depth): all nodes that each (node) of seeds reaches, with the fewest hops."""
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    known = Rounds(seeds.select(F.col("node").alias("entry"), "node", F.lit(0).alias("depth")).distinct())
    for depth in itertools.count(1):
        step = known.last.join(edges.hint("merge"), F.col("node") == F.col("src")).select("entry", F.col("dst").alias("node")).distinct()
        new = step.join(known.all().select("entry", "node").hint("merge"), ["entry", "node"], "left_anti")
        if known.add(new.withColumn("depth", F.lit(depth))).isEmpty():
            return known.all()


def chains(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entry, node, chain): the first-found shortest chain from each entry to each node it reaches.

    edges: src, dst, ord; among chains of equal length, the one of the earlier
    parent and then of the earlier call is kept.
    """
    edges = cut(edges.select("src", "dst", "ord").where("src <> dst"))
    start = seeds.select(F.col("node").alias("entry"), "node", F.array("node").alias("chain"), F.array(F.lit(0).cast("long")).alias("queue"))
    known = Rounds(start.dropDuplicates(["node"]))
    while True:
        step = known.last.join(edges.hint("merge"), F.col("node") == F.col("src")).select(
            "entry", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"), F.concat("queue", F.array(F.col("ord").cast("long"))).alias("queue")
        )
        step = step.join(known.all().select("entry", "node").hint("merge"), ["entry", "node"], "left_anti")
        new = step.groupBy("entry", "node").agg(F.min(F.struct("queue", "chain")).alias("x")).select("entry", "node", "x.chain", "x.queue")
        if known.add(new).isEmpty():
            return known.all().select("entry", "node", "chain")


def propagate(params: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(fn, idx, entry): the parameters that taint reaches, and from which entries.

    params: fn, n.  seeds: fn, idx, entry.  edges: src, dst, from_idx (null: an
    external origin), to_idx (null: keyword or splat, which taints them all).
    """
    every_param = params.select(F.col("fn").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p")).where("p >= 0")
    wide = cut(
        edges.join(every_param.hint("merge"), "dst").where("to_idx is null or to_idx = p").select("src", "dst", "from_idx", F.col("p").alias("to_idx")).distinct()
    )
    outside = wide.where("from_idx is null").select(F.col("dst").alias("fn"), F.col("to_idx").alias("idx"), F.col("src").alias("entry"))
    known, inner = Rounds(seeds.select("fn", "idx", "entry").unionByName(outside).distinct()), cut(wide.where("from_idx is not null"))
    while True:
        step = known.last.join(inner.hint("merge"), (F.col("fn") == F.col("src")) & (F.col("idx") == F.col("from_idx")))
        step = step.select(F.col("dst").alias("fn"), F.col("to_idx").alias("idx"), "entry").distinct()
        if known.add(step.join(known.all().hint("merge"), ["fn", "idx", "entry"], "left_anti")).isEmpty():
            return known.all()


def compose(targets: DataFrame, reached: DataFrame) -> DataFrame:
    """Cross-function records: sinks (fn, sink, idx, confidence, n_steps) whose parameter an entry taints."""
    hit = targets.join(reached, ["fn", "idx"])
    by = hit.groupBy("entry", "fn", "sink").agg(
        F.array_sort(F.collect_set("idx")).alias("params"), F.max_by("confidence", F.struct("confidence", "n_steps")).alias("c"), F.max("n_steps").alias("n")
    )
    return by.select(
        "entry", "fn", "sink", F.array_join("params", ",").alias("params"),
        F.round(F.greatest(F.lit(0.5), F.col("c") - 0.01 * F.greatest(F.lit(0), F.col("n") - 4)), 4).alias("confidence"),
        F.substring(F.sha2(F.concat_ws("|", "entry", "fn", "sink", F.array_join("params", ",")), 256), 1, 16).alias("trace_id"),
    )
