"""From parsed scopes to ranked findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.functions import scalars as S
from tracegrain.operators.tables import cut
from tracegrain.plans import registry as R


#: So many suppression rules may be given.
MAX_RULES = 10_000


def dangerous(hits: DataFrame, sinks: DataFrame) -> DataFrame:
    """(.., sink, position, keyword, splat) with category, cwe and danger: whether that argument matters.

    A safe position wins, then the dangerous positions; keywords are dangerous
    unless safe; splats always are.
    """
    d = hits.join(F.broadcast(sinks), "sink")
    danger = (
        F.when(F.col("splat"), True)
        .when(F.col("keyword").isNotNull(), ~F.array_contains("safe_kw", F.col("keyword")))
        .when(F.array_contains("safe", F.col("position")), False)
        .otherwise(F.array_contains("danger", F.col("position")))
    )
    return d.withColumn("danger", F.coalesce(danger, F.lit(False)))


def sink_decision(category: Column, origins: Column, neutralised: Column, partial: Column) -> Column:
    return (
        F.when((F.size(origins) == 0) | F.array_contains(neutralised, category), "suppressed")
        .when(F.array_contains(partial, category), "partial").otherwise("report")
    )


def flows(scopes: DataFrame, typed_kills: bool = True, inline_guards: bool = True, schemas: bool = True) -> DataFrame:
    """The flow records of parsed scopes.  The switches are those of the ablation study."""
    spark = scopes.sparkSession
    hits = scopes.where("error is null").select("path", "function", "scope", "lineno", "params", F.posexplode("hits").alias("ord", "h"))
    hits = hits.select("path", "function", "scope", "lineno", "params", "ord", "h.*")
    amp = hits.where("amplifier").withColumns({"category": F.lit("XSS"), "cwe": F.lit("CWE-79"), "danger": F.lit(True)})
    own = dangerous(hits.where("not amplifier"), R.dims(spark)["sink"]).drop("safe", "safe_kw")
    own = own.drop("danger").withColumn("danger", F.lit(True)) if not schemas else own
    keep = [c for c in amp.columns]
    rows = own.select(*keep).unionByName(amp.select(*keep))
    if not typed_kills:
        rows = rows.withColumn("neutralised", F.array().cast("array<string>"))
    decision = sink_decision(F.col("category"), F.col("origins"), F.col("neutralised"), F.col("partial"))
    rows = rows.withColumn("decision", decision)
    rows = rows.where(F.col("amplifier") | (F.col("danger") & ~F.col("structural") & (F.col("decision") != "suppressed")))
    guard = F.col("guard") if inline_guards else F.lit(None).cast("string")
    own_confidence = S.confidence(F.col("decision") == "partial", F.size("steps"), guard, F.col("origins") == F.array(F.lit("GLOBAL")))
    arg = F.when(F.col("splat"), "splat").when(F.col("keyword").isNotNull(), F.concat(F.lit("kw:"), "keyword")).otherwise(
        F.concat(F.lit("pos:"), F.col("position").cast("string"))
    )
    rows = rows.withColumns({
        "confidence": F.when(F.col("amplifier"), F.when(F.size("origins") > 0, 0.75).otherwise(0.60)).otherwise(own_confidence),
        "sink_arg": arg,
        "shown": S.shown_origins(F.col("origins"), F.col("params")),
        "detector": F.when(F.col("amplifier"), "amplifier").otherwise("taint"),
        "param_indices": F.transform(F.filter("origins", lambda o: o.startswith("PARAM#")), lambda o: F.substring(o, 7, 9).cast("int")),
    })
    rows = rows.withColumn("trace_id", trace_id("function", "sink", "sink_arg", "shown", F.transform("steps", lambda s: s["edge"])))
    first = Window.partitionBy("path", "scope", "trace_id", "line").orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(
        "path", "function", "scope", "lineno", "ord", "cwe", "category", "sink", F.col("call").alias("sink_call"), F.col("line").alias("sink_line"),
        "sink_arg", F.col("shown").alias("origins"), "steps", "kills", "confidence", "detector", "param_indices", "trace_id",
    )


def trace_id(function, sink, arg, origins, edges) -> Column:
    """Identity of a flow: what it does, not on which line."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return S.short_hash(c(function), c(sink), c(arg), F.array_join(c(origins), ","), F.array_join(c(edges), ","))


def contained(traces: DataFrame, scopes: DataFrame) -> DataFrame:
    """``traces`` with guard_line: the first containment test that dominates a FILE sink.

    A range join: the guard stands before the sink in the same scope, its reach
    covers it, and it tests a name that the sink uses (or the sink uses none).  In
    a scope without guards, a sink that uses a function of the same file whose
    every return a guard dominates has that function's guard.
    """
    g = scopes.where("error is null").select("path", "scope", F.explode("guards").alias("g")).select("path", "scope", "g.*")
    u = scopes.where("error is null").select("path", "scope", F.explode("sink_names").alias("u")).select(
        "path", "scope", F.col("u.line").alias("sink_line"), F.col("u.names").alias("used")
    ).dropDuplicates(["path", "scope", "sink_line"])
    t = traces.where("category = 'FILE'").join(u.hint("merge"), ["path", "scope", "sink_line"], "left")
    found = t.join(g.hint("merge"), ["path", "scope"]).where(
        (F.col("line") < F.col("sink_line")) & (F.col("sink_line") <= F.col("last"))
        & ((F.coalesce(F.size("used"), F.lit(0)) <= 0) | F.arrays_overlap("names", "used"))
    )
    key = ["path", "scope", "trace_id", "sink_line"]
    found = found.select(*key, "line")
    callees = scopes.where("error is null and guarded_returns and function <> '<module>'").select(
        "path", F.col("function").alias("callee"), F.array_min(F.transform("guards", lambda g: g["line"])).alias("line")
    )
    calling = scopes.where("error is null and size(guards) = 0").select("path", "scope", F.explode("calls").alias("callee")).distinct()
    called = t.join(calling.hint("merge"), ["path", "scope"]).join(callees.hint("merge"), ["path", "callee"]).where(F.array_contains("used", F.col("callee")))
    first = found.unionByName(called.select(*key, "line")).groupBy(*key).agg(F.min("line").alias("guard_line"))
    return traces.join(first.hint("merge"), ["path", "scope", "trace_id", "sink_line"], "left")


def certificates(traces: DataFrame, cross: DataFrame) -> DataFrame:
    """(kind, trace_id, cwe, path, function, sink, sink_line): flows inside functions and across them; those across are the last function's."""
    own = traces.where(F.size("origins") > 0).select(F.lit("intra").alias("kind"), "trace_id", "cwe", S.slashes(F.col("path")).alias("path"), "function", "sink", "sink_line")
    over = cross.select(
        F.lit("cross").alias("kind"), "trace_id", "cwe", S.slashes(F.col("sink_file")).alias("path"), F.element_at("chain", -1).alias("function"), "sink", "sink_line"
    )
    return own.unionByName(over)


def call_keys(found: DataFrame) -> DataFrame:
    """(path, classes, calls): the classes of each file, and its sink calls as call@line, for comparison with other tools."""
    key = F.concat_ws("@", "sink_call", F.col("lineno").cast("string"))
    return found.groupBy("path").agg(F.sort_array(F.collect_set("cwe")).alias("classes"), F.sort_array(F.collect_set(F.when(F.col("sink_call") != "", key))).alias("calls"))


def with_keys(traces: DataFrame) -> DataFrame:
    """``traces`` with location, the key of a place, and summary, a line for readers."""
    place = F.concat_ws(":", "path", "function", "sink", F.col("sink_line").cast("string"))
    line = F.format_string("%s %s -> %s in %s at line %d (%.2f)", "cwe", F.array_join("origins", ", "), "sink_call", "function", "sink_line", "confidence")
    return traces.withColumns({"location": place, "summary": line})


def in_order(traces: DataFrame) -> DataFrame:
    """By file, function, sink and identity."""
    return traces.orderBy("path", "lineno", "sink_line", "sink", "trace_id")


def pattern_findings(scopes: DataFrame, traces: DataFrame) -> DataFrame:
    """A finding for each category that a function touches without a confirmed flow."""
    dims = R.dims(scopes.sparkSession)
    known = F.broadcast(dims["sink"].select("sink", "category", "cwe"))
    functions = scopes.where("error is null and function <> '<module>'")
    touched = functions.select("path", "function", "scope", "lineno", F.explode("sinks").alias("sink")).join(known, "sink")
    touched = touched.groupBy("path", "function", "scope", "lineno", "category", "cwe").agg(F.array_join(F.array_sort(F.collect_set("sink")), ",").alias("sink"))
    # calls as written, by first occurrence; calls without arguments have none
    made = functions.select("path", "scope", F.posexplode("hits").alias("ord", "h")).where("not h.amplifier").select("path", "scope", "ord", "h.sink", "h.call").join(known, "sink")
    first = made.groupBy("path", "scope", "category", "call").agg(F.min("ord").alias("ord")).groupBy("path", "scope", "category").agg(
        F.array_sort(F.collect_list(F.struct("ord", "call"))).alias("c")
    )
    calls = first.select("path", "scope", "category", F.array_join(F.transform("c", lambda x: x["call"]), ",").alias("sink_call"))
    sure = traces.select("path", "scope", "category").distinct()
    found = touched.join(sure.hint("merge"), ["path", "scope", "category"], "left_anti").join(calls.hint("merge"), ["path", "scope", "category"], "left")
    return found.withColumns({"sink_call": F.coalesce("sink_call", F.lit("")), "confidence": F.lit(0.40), "detector": F.lit("pattern")})


def findings(scopes: DataFrame, containment: bool = True, threshold: float = 0.0, **options) -> DataFrame:
    """All findings of parsed scopes, unranked.  ``threshold`` marks, it doesn't drop."""
    traces = cut(flows(scopes, **options))  # read by each of the joins below
    rated = traces.withColumn("severity", S.severity(F.col("category"), F.col("confidence")))
    rated = rated.withColumn("below_threshold", F.col("confidence") < threshold)
    if containment:
        rated = contained(rated, scopes).withColumn(
            "confidence", F.when(F.col("guard_line").isNotNull(), F.least("confidence", F.lit(0.12))).otherwise(F.col("confidence"))
        )
    columns = [
        "path", "function", "cwe", "category", "sink", "sink_call", "sink_arg", "confidence", "severity", "detector", "origins", "steps", "kills", "trace_id",
    ]
    a = rated.select(*columns, F.coalesce(F.nullif("sink_line", F.lit(0)), "lineno").alias("lineno"), "below_threshold")
    p = pattern_findings(scopes, traces).withColumns({
        "severity": S.severity(F.col("category"), F.col("confidence")), "origins": F.array().cast("array<string>"), "trace_id": F.lit(""),
        "sink_arg": F.lit("none"), "steps": F.array().cast(traces.schema["steps"].dataType), "kills": F.array().cast("array<string>"),
    })
    return a.unionByName(p.select(*columns, "lineno", F.lit(False).alias("below_threshold")))


def dedupe(rows: DataFrame, key: list[str], confidence: str, order: list[str]) -> DataFrame:
    """The row of highest confidence for each key; the first in ``order`` among equals."""
    w = Window.partitionBy(*key).orderBy(F.col(confidence).desc(), *order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked(rows: DataFrame, severity: str, confidence: str, then: list[str]) -> DataFrame:
    return rows.orderBy(S.severity_rank(F.col(severity)).desc(), F.col(confidence).desc(), *then)


def dedupe_and_rank(rows: DataFrame) -> DataFrame:
    one = dedupe(rows, ["path", "function", "cwe", "sink", "lineno"], "confidence", ["detector", "trace_id"])
    return ranked(one, "severity", "confidence", ["path", "lineno", "sink"])


def suppressed(rows: DataFrame, rules: DataFrame, fields: dict[str, str], keep: bool) -> DataFrame:
    """Rows that no rule (kind, pattern) matches, or with ``keep`` False those that one does.

    Rules are globs on the column that ``fields`` names for their kind; those of
    kind function may end with ``:>=x``, a floor for confidence.  Users write them
    by hand; they become one filter, so more than ``MAX_RULES`` are refused.
    """
    few = rules.select("kind", "pattern").limit(MAX_RULES + 1).collect()
    if len(few) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} suppression rules")
    globs: dict[str, list[str]] = {}
    match = F.lit(False)
    for kind, pattern in few:
        if kind not in fields or pattern is None:
            continue
        glob, _, floor = pattern.partition(":") if kind == "function" else (pattern, "", "")
        if not floor.startswith(">="):
            globs.setdefault(kind, []).append(S.glob_pattern(glob))
        elif re.fullmatch(r"\s*\d*\.?\d+\s*", floor[2:]):
            named = F.col(fields[kind]).cast("string").rlike(S.glob_pattern(glob))
            match = match | F.coalesce(named & (F.col("confidence") >= float(floor[2:])), F.lit(False))
    for kind, patterns in globs.items():
        match = match | F.coalesce(F.col(fields[kind]).cast("string").rlike("|".join(patterns)), F.lit(False))
    return rows.where(~match if keep else match)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each column and in all, in one pass."""
    return rows.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(F.count(F.lit(1)).alias("n"))


def evidence(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rule classifier: the best evidence of each function and its confidence.

    rows: key, category, sink_line, trace_id, detector.
    """
    ranks = F.create_map(*[F.lit(x) for kv in R.RANK.items() for x in kv])
    order = F.struct(F.element_at(ranks, F.col("category")).alias("r"), "sink_line", "trace_id", "category")
    g = rows.groupBy(*key).agg(
        F.min(F.when(F.col("detector") == "taint", order)).alias("taint"),
        F.max((F.col("detector") == "amplifier").cast("int")).alias("amp"),
        F.countDistinct(F.when(F.col("detector") == "pattern", F.col("category"))).alias("n_pattern"),
        F.min(F.when(F.col("detector") == "pattern", F.col("category"))).alias("pattern"),
    )
    return g.select(
        *key,
        F.when(F.col("taint").isNotNull(), F.col("taint.category")).when(F.col("amp") == 1, "XSS").when(F.col("n_pattern") == 1, F.col("pattern")).alias("label"),
        F.when(F.col("taint").isNotNull(), 0.90).when(F.col("amp") == 1, 0.60).when(F.col("n_pattern") == 1, 0.40).when(F.col("n_pattern") > 1, 0.25).otherwise(0.0).alias("evidence"),
    )
