"""The scan across functions: from parsed scopes to flows that cross calls.

Functions are named as in the source, without their class; definitions that share
a name count as one, with the calls of both.  A call means the function of its
name, or of its last segment.  A function that no call means is an entry: all its
parameters are tainted.  Taint goes from there, and from external reads inside any
function, along arguments (``callgraph.propagate``); each sink whose parameter an
entry taints becomes one flow, with the first-found shortest chain of calls.

Everything grows with calls and with the (entry, function) pairs that taint
connects; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.operators import callgraph
from tracegrain.operators.findings import flows
from tracegrain.operators.tables import cut


def summaries(scopes: DataFrame) -> DataFrame:
    """(fn, file, lineno, n, params): the functions by name."""
    f = scopes.where("error is null and scope > 0")
    return f.groupBy(F.col("function").alias("fn")).agg(
        F.min_by("path", F.struct("path", "scope")).alias("file"), F.min("lineno").alias("lineno"), F.max(F.size("params")).alias("n"),
        F.min_by("params", F.struct("path", "scope")).alias("params"),
    )


def calls(scopes: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst, ord, args): the calls that mean a known function, in source order."""
    made = scopes.where("error is null and scope > 0").select(F.col("function").alias("src"), "path", "scope", F.posexplode("invocations").alias("at", "i"))
    made = made.select("src", "path", "scope", "at", F.col("i.callee").alias("callee"), F.col("i.args").alias("args"))
    known = callgraph.resolve_functions(made, functions.select(F.col("fn").alias("qualname"))).where("target is not null")
    order = Window.partitionBy("src").orderBy("path", "scope", "at")
    return known.select("src", F.col("target").alias("dst"), F.row_number().over(order).cast("long").alias("ord"), "args")


def argument_edges(graph: DataFrame) -> DataFrame:
    """(src, dst, from_idx, to_idx) of callgraph.propagate(): process state taints nothing."""
    a = graph.select("src", "dst", F.explode("args").alias("a")).select("src", "dst", F.col("a.position").alias("to_idx"), F.explode("a.origins").alias("o"))
    index = F.when(F.col("o").startswith("PARAM#"), F.substring("o", 7, 9).cast("int"))
    return a.where("o <> 'GLOBAL'").select("src", "dst", index.alias("from_idx"), "to_idx").distinct()


def cross_flows(scopes: DataFrame) -> DataFrame:
    """The flows that start at an entry: entry, chain, sink and where it is, steps, confidence, identity.

    scopes: a table (tables.cut), as it is read several times.
    """
    functions = cut(summaries(scopes))
    graph = cut(calls(scopes, functions))
    entries = callgraph.entry_points(functions.select(F.col("fn").alias("node")), graph.select("dst").distinct())
    seeds = entries.join(functions.select(F.col("fn").alias("node"), "n").hint("merge"), "node").where("n > 0").select(
        F.col("node").alias("fn"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"), F.col("node").alias("entry")
    )
    reached = callgraph.propagate(functions.select("fn", "n"), argument_edges(graph), seeds)
    traces = cut(flows(scopes).where("scope > 0 and size(origins) > 0").withColumnRenamed("function", "fn"))
    per_sink = cut(traces.groupBy("fn", "sink").agg(
        F.array_distinct(F.flatten(F.collect_list("param_indices"))).alias("idx"), F.max(F.size("param_indices") == 0).alias("outside")
    ))
    by_entry = per_sink.select("fn", "sink", F.explode("idx").alias("idx")).join(reached.hint("merge"), ["fn", "idx"]).groupBy("entry", "fn", "sink").agg(
        F.array_sort(F.collect_set("idx")).alias("indices")
    )
    external = traces.where("size(param_indices) = 0").select("fn").distinct()
    own = per_sink.where("size(idx) = 0").join(external.hint("merge"), "fn").select(F.col("fn").alias("entry"), "fn", "sink", F.array().cast("array<int>").alias("indices"))
    pending = cut(by_entry.unionByName(own))
    chains = callgraph.chains(graph.select("src", "dst", "ord"), pending.select(F.col("entry").alias("node")).distinct())
    found = pending.join(chains.withColumnRenamed("node", "fn").hint("merge"), ["entry", "fn"], "left")
    found = found.withColumn("chain", F.coalesce("chain", F.when(F.col("entry") == F.col("fn"), F.array("entry")).otherwise(F.array("entry", "fn"))))
    return composed(found, traces, functions)


def composed(found: DataFrame, traces: DataFrame, functions: DataFrame) -> DataFrame:
    """(entry, fn, sink, indices, chain) with the first flow of that sink that its parameters reach, and the whole path."""
    fits = F.arrays_overlap("param_indices", "indices")
    order = F.struct(F.when(fits, 0).otherwise(1).alias("other"), F.col("path"), F.col("scope"), F.col("ord"))
    facts = ("cwe", "category", "sink_call", "sink_line", "origins", "steps", "kills", "confidence")
    best = found.join(traces.select("fn", "sink", "path", "scope", "ord", "param_indices", *facts).hint("merge"), ["fn", "sink"]).groupBy("entry", "fn", "sink").agg(
        F.first("indices").alias("indices"), F.first("chain").alias("chain"), F.min_by(F.struct(*facts), order).alias("t")
    )
    starts = functions.select(F.col("fn").alias("entry"), F.col("file").alias("entry_file"), F.col("lineno").alias("entry_line"), "params")
    best = best.join(starts.hint("merge"), "entry").join(functions.select("fn", F.col("file").alias("sink_file")).hint("merge"), "fn")

    def step(kind: str, edge: str, detail):
        return F.struct(F.col("entry_line").alias("line"), F.lit(0).alias("column"), F.lit(kind).alias("kind"), F.lit(edge).alias("edge"), detail.alias("detail"))

    names = F.transform("indices", lambda i: step("source", "param", F.coalesce(F.get("params", i), F.concat(F.lit("arg"), i.cast("string")))))
    outside = F.array(step("source", "param", F.array_join("t.origins", " / ")))
    bridge = F.transform(F.slice("chain", 2, F.size("chain")), lambda n: step("propagate", "call", n))
    best = best.withColumn("steps", F.concat(F.when(F.size("indices") > 0, names).otherwise(outside), bridge, F.col("t.steps")))
    identity = F.concat_ws("|", "entry", "fn", "sink", F.array_join(F.transform("indices", lambda i: i.cast("string")), ","))
    return best.select(
        F.substring(F.sha2(identity, 256), 1, 16).alias("trace_id"), "t.cwe", "t.category", "sink", "t.sink_call", "sink_file", "t.sink_line", "chain",
        "entry", "entry_file", "entry_line", "t.origins", F.col("indices").alias("param_indices"), "steps", "t.kills",
        F.round(F.greatest(F.lit(0.5), F.col("t.confidence") - 0.01 * F.greatest(F.lit(0), F.size("steps") - 4)), 4).alias("confidence"),
    )
