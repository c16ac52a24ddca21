"""88 features of each scope, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.operators import findings
from tracegrain.plans import registry as R

# The names and order of the features.
STRUCTURAL = (
    "sink_count call_count arg_count decorator_count return_count unique_call_count loop_count branch_count nesting_depth statement_count "
    "has_try has_with has_comprehension has_lambda has_async line_span"
).split()
TAINT = (
    "flow_count tainted_sink_count distinct_origins has_external_origin has_global_only_origin max_path_length avg_path_length sanitiser_count "
    "has_partial_mitigation has_full_mitigation_observed has_amplifier has_module_scope_flow"
).split()
CATEGORIES = "SQL XSS FILE EXEC NET REDIRECT DESER CRYPTO CRED UPLOAD XXE".split()
KILLS = {
    "kill_shell_quote": "shell_quote", "kill_path_basename": "path_basename", "kill_path_normalise": "path_normalise", "kill_html_escape": "html_escape",
    "kill_html_clean": "html_clean", "kill_numeric_coercion": "numeric_coercion", "kill_structural_decoder": "literal_eval",
    "kill_safe_deserialiser": "safe_decoder", "kill_defused_xml": "defused_xml", "kill_regex_escape": "regex_escape", "kill_url_encode": "url_quote",
}
SHAPE = {
    "sink_deser": "DESER_UNSAFE", "sink_crypto": "CRYPTO_WEAK", "sink_network": "NET_REQUEST", "sink_mail": "XSS_MAIL_BODY",
    "sink_template": "XSS_TEMPLATE_BODY XSS_TEMPLATE_NAME XSS_TEMPLATE_PATH",
}
FRAMEWORKS = ("django", "flask", "fastapi")
VERSION = 3


def names() -> list[str]:
    return [
        *STRUCTURAL, *TAINT, *(f"scat_{c.lower()}" for c in CATEGORIES), *(f"tainted_{c.lower()}" for c in CATEGORIES),
        *(f"origin_{o.lower()}" for o in R.ORIGINS), *KILLS, "sink_at_positional", "sink_at_keyword", "sink_at_splat", "sink_high_risk", "sink_low_risk",
        *SHAPE, *(f"framework_{f}" for f in FRAMEWORKS), "framework_other", "has_auth_decorator", "has_csrf_exempt", "has_sql_literal", "parse_error",
    ]


def extract(scopes: DataFrame) -> DataFrame:
    """(path, scope, function, features...): one row for each scope, or for a file that doesn't parse."""
    t = findings.flows(scopes).withColumn("n", F.size("steps"))
    flat = F.array_distinct(F.flatten(F.collect_list("origins")))
    by = t.groupBy("path", "scope").agg(
        F.count(F.lit(1)).alias("flow_count"), F.countDistinct("sink", "sink_line").alias("tainted_sink_count"), flat.alias("__o"),
        F.max("n").alias("max_path_length"), F.avg("n").alias("avg_path_length"), F.array_sort(F.collect_set("category")).alias("__t"),
        F.max((F.col("detector") == "amplifier").cast("int")).alias("has_amplifier"),
        F.max(F.startswith("sink_arg", F.lit("pos")).cast("int")).alias("sink_at_positional"),
        F.max(F.startswith("sink_arg", F.lit("kw")).cast("int")).alias("sink_at_keyword"), F.max((F.col("sink_arg") == "splat").cast("int")).alias("sink_at_splat"),
    )
    x = scopes.join(by.hint("merge"), ["path", "scope"], "left")
    sink_cat = F.create_map(*[F.lit(v) for s, (c, *_) in R.SINKS.items() for v in (s, c)])
    cats = F.transform(F.array_distinct("sinks"), lambda s: F.element_at(sink_cat, s))
    high = [c for c, (_, h) in R.CATEGORIES.items() if h]
    low_imports = F.transform("imports", lambda i: F.lower(i))
    has = lambda arr, v: F.array_contains(arr, v)
    some = lambda arr, vs: F.arrays_overlap(arr, F.array(*map(F.lit, vs)))

    def imported(name: str):
        return F.exists(low_imports, lambda i: F.contains(i, F.lit(name)))

    framework = {f: imported(f) for f in (*FRAMEWORKS, *[f for f in R.FRAMEWORKS if f not in FRAMEWORKS])}
    other = F.lit(False)
    for f, c in framework.items():
        other = other | c if f not in FRAMEWORKS else other
    full = [k for k, (_, f, _) in R.KILLS.items() if f]
    part = [k for k, (_, f, _) in R.KILLS.items() if not f]
    c = {
        "sink_count": F.size("sinks"), "call_count": F.size("calls"), "arg_count": F.size("params"), "decorator_count": F.size("decorators"),
        "return_count": F.col("n_returns"), "unique_call_count": F.size(F.array_distinct("calls")), "line_span": F.col("end_lineno") - F.col("lineno") + 1,
        "flow_count": F.col("flow_count"), "tainted_sink_count": F.col("tainted_sink_count"), "distinct_origins": F.size("__o"),
        "has_external_origin": some("__o", R.EXTERNAL), "has_global_only_origin": F.col("__o") == F.array(F.lit("GLOBAL")),
        "max_path_length": F.col("max_path_length"), "avg_path_length": F.col("avg_path_length"), "sanitiser_count": F.size("sanitisers"),
        "has_partial_mitigation": some("sanitisers", part), "has_full_mitigation_observed": some("sanitisers", full), "has_amplifier": F.col("has_amplifier"),
        "has_module_scope_flow": (F.col("function") == "<module>") & (F.col("flow_count") > 0),
        **{f"scat_{k.lower()}": has(cats, k) for k in CATEGORIES}, **{f"tainted_{k.lower()}": has("__t", k) for k in CATEGORIES},
        **{f"origin_{o.lower()}": has("__o", o) for o in R.ORIGINS}, **{k: has("sanitisers", v) for k, v in KILLS.items()},
        **{k: F.col(k) for k in ("sink_at_positional", "sink_at_keyword", "sink_at_splat")},
        "sink_high_risk": some(cats, high), "sink_low_risk": F.exists(cats, lambda k: ~k.isin(high)),
        **{k: some("sinks", v.split()) for k, v in SHAPE.items()}, **{f"framework_{f}": framework[f] for f in FRAMEWORKS}, "framework_other": other,
        "has_auth_decorator": F.exists("decorators", lambda d: F.substring_index(d, ".", -1).isin(sorted(R.AUTH_DECORATORS))),
        "has_csrf_exempt": F.exists("decorators", lambda d: F.substring_index(d, ".", -1) == "csrf_exempt"), "has_sql_literal": F.col("sql_literal"),
        "parse_error": F.col("error").isNotNull(),
    }
    zero = F.lit(0.0)
    return x.select("path", "scope", "function", *[F.greatest(F.coalesce(c[n].cast("double"), zero), zero).alias(n) if n in c else zero.alias(n) for n in names()])
