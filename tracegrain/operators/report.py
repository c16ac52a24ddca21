"""Reports: JSON, SARIF, text, tokens and traces, as columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions import scalars as S
from tracegrain.operators import corpus, findings
from tracegrain.plans import registry as R

TRACE_SCHEMA = 3


def to_json(rows: DataFrame) -> DataFrame:
    """A JSON object for each row, keys in order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def traces_to_json(traces: DataFrame) -> DataFrame:
    return to_json(traces.withColumn("schema", F.lit(TRACE_SCHEMA)))


def traces_from_json(lines: DataFrame, schema: str) -> DataFrame:
    """Traces of (json); raises on another schema version."""
    t = lines.select(F.from_json("json", f"schema int, {schema}").alias("t")).select("t.*")
    checked = F.when(F.col("schema") == TRACE_SCHEMA, F.col("trace_id")).otherwise(F.raise_error(F.lit("traces of another schema version")).cast("string"))
    return t.withColumn("trace_id", checked).drop("schema")


def render_steps(steps: Column) -> Column:
    mark = lambda k: F.when(k == "source", ">>").when(k == "sink", "<<").otherwise("//")
    return F.array_join(F.transform(steps, lambda s: F.concat_ws(" ", mark(s["kind"]), F.concat(F.lit("line "), s["line"].cast("string")), s["edge"], s["detail"])), "\n")


def text_lines(rows: DataFrame) -> DataFrame:
    shown = F.format_string("%s:%d %s [%s] %s in %s (%.2f)", "path", "lineno", "severity", "cwe", "sink", "function", "confidence")
    return findings.ranked(rows, "severity", "confidence", ["path", "lineno", "sink"]).select(shown.alias("line"))


def gate(rows: DataFrame, fail_on: str) -> int:
    """The exit code: 1 if a finding is at or above what ``fail_on`` names."""
    if fail_on == "never":
        return 0
    hit = rows if fail_on == "any" else rows.where("severity in ('high', 'critical')")
    return int(not hit.isEmpty())


def tokens(scopes: DataFrame) -> DataFrame:
    """(path, scope, tokens): the token sequence of each scope.

    Decorators, name, parameters, calls, sinks, their categories, a SQL literal
    without a sink, returned names, sinks without a security decorator, then what
    its flows say: origin and sink, tainted sinks, sanitisers on the way, amplifiers.
    """
    tag = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    if_ = lambda c, *x: F.when(c, F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>"))
    category = F.create_map(*[F.lit(v) for s, (c, *_) in R.SINKS.items() for v in (s, c)])
    f = findings.flows(scopes).where(F.size("origins") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "sink", "origins", "kills", "sink_call", "detector"))).alias("f")
    own = scopes.where("error is null").join(f.groupBy("path", "scope").agg(ordered).hint("merge"), ["path", "scope"], "left")
    f = F.coalesce("f", F.array().cast(own.schema["f"].dataType))
    taint = F.filter(f, lambda x: x["detector"] == "taint")
    flow = F.flatten(F.transform(taint, lambda x: F.transform(x["origins"], lambda o: F.concat(F.lit("flow:"), o, F.lit("->"), x["sink"]))))
    guarded = F.exists("decorators", lambda d: F.substring_index(d, ".", -1).isin(sorted(R.AUTH_DECORATORS)))
    every = F.concat(
        tag("@", F.col("decorators")), F.array(F.concat(F.lit("def:"), "function")), tag("arg:", F.col("params")), tag("call:", F.col("calls")),
        tag("sink:", F.col("sinks")), tag("SCAT:", F.array_distinct(F.transform("sinks", lambda s: F.element_at(category, s)))),
        if_(F.col("sql_literal") & ~F.array_contains("sinks", "SQL_EXECUTE"), "sink:SQL_EXECUTE", "SCAT:SQL"), tag("ret:", F.col("returned")),
        if_((F.size("sinks") > 0) & ~guarded, "meta:no_auth"), flow, tag("tainted:", F.array_distinct(F.transform(taint, lambda x: x["sink"]))),
        tag("kill:", F.array_distinct(F.flatten(F.transform(f, lambda x: x["kills"])))),
        tag("amp:", F.array_distinct(F.transform(F.filter(f, lambda x: x["detector"] == "amplifier"), lambda x: F.substring_index(x["sink_call"], ".", -1)))),
    )
    return own.select("path", "scope", every.alias("tokens"))


# What a rule advises, by category.
HELP = {
    "SQL": "Use parameterised queries. Never concatenate untrusted input into a statement.",
    "XSS": "Encode output for its context. Do not assert that a value is markup-safe.",
    "FILE": "Constrain the path to an allow-listed root and strip directory components.",
    "EXEC": "Avoid passing untrusted input to a command. Use an argument allow-list.",
    "NET": "Validate the destination host against an allow-list before requesting it.",
    "REDIRECT": "Restrict redirect targets to relative paths or an allow-listed host set.",
    "DESER": "Deserialise only data formats that cannot construct objects.",
    "CRYPTO": "Use a modern, purpose-built primitive instead of a general hash or PRNG.",
    "CRED": "Load credentials from a secret store rather than embedding them.",
    "UPLOAD": "Validate upload content and store files outside the web root.",
    "XXE": "Use a hardened XML parser that disables external entity resolution.",
}


def _level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def _text(x: Column) -> Column:
    return F.struct(x.alias("text"))


def _place(path: Column, line: Column) -> Column:
    region = F.struct(F.greatest(line, F.lit(1)).alias("startLine"))
    return F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))


def sarif_results(rows: DataFrame) -> DataFrame:
    """``rows`` with result, a SARIF 2.1.0 result; rows with ``suppressed`` are notes."""
    level = F.when(F.col("suppressed"), "note").otherwise(_level(F.col("severity")))
    steps = F.transform("steps", lambda s: F.struct(F.struct(_place(F.col("path"), s["line"])["physicalLocation"].alias("physicalLocation"), _text(F.concat_ws(" ", s["edge"], s["detail"])).alias("message")).alias("location")))
    flow = F.when(F.size("steps") > 0, F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))
    result = F.struct(
        F.col("cwe").alias("ruleId"), level.alias("level"), _text(F.concat_ws(" ", "sink", F.lit("in"), "function")).alias("message"),
        F.array(_place(F.col("path"), F.col("lineno"))).alias("locations"), F.struct(F.col("trace_id").alias("traceId/v1")).alias("partialFingerprints"),
        F.struct("category", F.round("confidence", 4).alias("confidence"), "detector", "origins", "sink", F.col("sink_arg").alias("sinkArg"), F.col("kills").alias("sanitisers")).alias("properties"),
        flow.alias("codeFlows"),
    )
    return rows.withColumn("result", result)


def sarif_log(rows: DataFrame, suppressed: DataFrame | None = None, errors: DataFrame | None = None, tool: str = "tracegrain") -> DataFrame:
    """(path, sarif): a SARIF 2.1.0 document for each file, so that no task gathers all findings.

    Rules are those of the file's results; the first finding of a class describes
    it.  ``suppressed`` findings become notes, ``errors`` (path, error) notifications.
    """
    every = rows.withColumn("suppressed", F.lit(False))
    if suppressed is not None:
        every = every.unionByName(suppressed.withColumn("suppressed", F.lit(True)))
    rank = F.struct("suppressed", (-F.col("confidence")).alias("c"), "lineno", "trace_id", "sink")
    help_ = F.create_map(*[F.lit(x) for kv in HELP.items() for x in kv])
    rule = F.struct(
        F.col("cwe").alias("id"), F.replace("cwe", F.lit("CWE-"), F.lit("Cwe")).alias("name"), _text(F.col("category")).alias("shortDescription"),
        _text(F.concat(F.lit("Untrusted data reaches a "), "category", F.lit(" sink ("), "sink", F.lit(")."))).alias("fullDescription"),
        _text(F.element_at(help_, F.col("category"))).alias("help"), F.struct(_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
    )
    made = sarif_results(every).withColumn("rule", rule)
    rules = made.groupBy("path", "cwe").agg(F.min_by("rule", rank).alias("rule")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("cwe", "rule"))).alias("rules"))
    order = F.struct("suppressed", "lineno", "cwe", "trace_id", "sink")
    by = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.to_json("result").alias("r")))).alias("results")).join(rules.hint("merge"), "path")
    if errors is not None:
        by = by.join(errors.groupBy("path").agg(F.array_sort(F.collect_set("error")).alias("errors")), "path", "full_outer")
    else:
        by = by.withColumn("errors", F.array().cast("array<string>"))
    failed = F.coalesce("errors", F.array().cast("array<string>"))
    notes = F.transform(failed, lambda e: F.struct(F.lit("error").alias("level"), _text(F.concat_ws(": ", "path", e)).alias("message")))
    call = F.to_json(F.array(F.struct((F.size(failed) == 0).alias("executionSuccessful"), notes.alias("toolExecutionNotifications"))))
    parts = [
        F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":['),
        F.array_join(F.transform(F.coalesce("rules", F.array().cast(by.schema["rules"].dataType)), lambda x: F.to_json(x["rule"])), ","), F.lit(']}},"results":['),
        F.array_join(F.transform(F.coalesce("results", F.array().cast(by.schema["results"].dataType)), lambda x: x["r"]), ","), F.lit('],"invocations":'), call, F.lit("}]}"),
    ]
    return by.select("path", F.concat(*parts).alias("sarif"))


def report_object(rows: DataFrame, suppressed: DataFrame, errors: DataFrame, scopes: DataFrame) -> DataFrame:
    """(json), one row: files, functions, findings, suppressed and errors counted, findings by class and severity."""
    counts = lambda df, by: df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(f"by_{by}"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    files = scopes.agg(F.countDistinct("path").alias("files_scanned"), F.count(F.when(F.col("scope") > 0, 1)).alias("functions_scanned"))
    out = files.crossJoin(n(rows, "findings")).crossJoin(n(suppressed, "suppressed")).crossJoin(n(errors, "errors")).crossJoin(counts(rows, "cwe")).crossJoin(counts(rows, "severity"))
    return to_json(out.withColumn("schema", F.lit(TRACE_SCHEMA)))


def prompts(records: DataFrame, traces: DataFrame) -> DataFrame:
    """(pair_id, prompt, forbidden) of vulnerable records: the source and the facts of the first flow of its class.

    records: pair_id, path, source, cwe, patched, advisory_id, commit.  A record
    without such a flow has no prompt.  forbidden: what may not appear in it.
    """
    first = corpus.first_by(traces, ["path", "cwe"], ["sink_line", "trace_id"])
    facts = F.format_string("%s: %s reaches %s on line %d", "cwe", F.array_join("origins", ", "), "sink_call", "sink_line")
    lines = lambda c: F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    joined = records.join(first.select("path", "cwe", "origins", "sink_call", "sink_line"), ["path", "cwe"])
    secret = F.array_compact(F.concat(F.array("advisory_id", "commit"), F.array_except(lines(F.col("patched")), lines(F.col("source")))))
    return joined.select("pair_id", F.concat(facts, F.lit("\n\n"), "source").alias("prompt"), secret.alias("forbidden"))


def leak_guard(prompts: DataFrame, text: str, forbidden: str) -> DataFrame:
    """Prompts in which no forbidden string (an array column) appears."""
    return prompts.where(~F.exists(forbidden, lambda s: F.contains(F.col(text), s) & (F.length(s) > 0)))


def answers(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, answer) of the files (name, text) that a manifest (pair_id, name) lists, without fences; and what is missing."""
    both = manifest.join(files, "name", "left")
    return both.where("text is not null").select("pair_id", S.unfenced(F.col("text")).alias("answer")), both.where("text is null").select("pair_id", "name")
