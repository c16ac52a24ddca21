import pytest

from tracegrain.operators import callgraph, findings, parse, patching, rename
from tracegrain.plans import registry as R


def hits(source):
    return [h for row in parse.facts("x.py", source) for h in (row[17] or [])]


@pytest.mark.parametrize(("name", "sink"), [
    ("cursor.execute", "SQL_EXECUTE"), ("a.b.cursor.execute", "SQL_EXECUTE"), ("json.loads", None), ("yaml.safe_load", None), ("open", "FILE_OPEN"),
    ("x.open", "FILE_OPEN"), ("subprocess.run", "EXEC_COMMAND"), ("nothing", None), ("", None), ("flask.redirect", "REDIRECT_NAV"),
])
def test_sink_names(name, sink):
    assert R.sink_of(name) == sink


def test_import_binding_gives_bare_names_a_meaning():
    assert R.sink_of("loads") is None
    assert R.sink_of("loads", frozenset(["pickle"])) == "DESER_UNSAFE"


@pytest.mark.parametrize("expression", ['"a" + x', 'f"{x}"', '"%s" % x', '"{}".format(x)', '"a" "b" + x', "[x][0]", "x if c else y", "(y := x)"])
def test_flows_survive_string_building(expression):
    (h,) = hits(f"def f(x, c, y):\n    cursor.execute({expression})\n")
    assert "PARAM#0" in h[6]


def test_sanitisers_are_typed():
    (h,) = hits("import html\ndef f(x):\n    cursor.execute(html.escape(x))\n")
    assert h[6] == ["PARAM#0"] and h[7] == ["XSS"]


def test_merge_keeps_only_what_all_tainted_operands_share():
    a = parse.Value(frozenset(["PARAM#0"]), frozenset(["XSS", "SQL"]), path=((1, 0, "a", "b", "c"),))
    b = parse.Value(frozenset(["PARAM#1"]), frozenset(["XSS"]))
    m = parse.merge(a, b, parse.LITERAL)
    assert m.origins == {"PARAM#0", "PARAM#1"} and m.neutralised == {"XSS"} and m.path == ()
    assert parse.merge(b, a) == m
    assert parse.merge(parse.LITERAL, parse.LITERAL).constant


@pytest.mark.parametrize(("test", "guard"), [("x not in ALLOWED", "allowlist"), ("x in DENIED", "denylist"), ("x != 'a'", "equality")])
def test_guards(test, guard):
    (h,) = hits(f"def f(x):\n    if {test}:\n        return\n    open(x)\n")
    assert h[11] == guard


@pytest.mark.parametrize("source", ["def f(:", "x" + "(" * 3000, "\x00", None, ""])
def test_bad_sources_never_raise(source):
    assert parse.facts("x", source)


def test_one_bad_file_does_not_stop_a_scan(spark):
    rows = [("a.py", "def f(x):\n    eval(x)\n"), ("b.py", "def f(:"), ("c.py", None), ("a2.py", "def f(x):\n    eval(x)\n")]
    s = spark.createDataFrame(rows, "path string, source string")
    scopes = parse.parse(s)
    assert scopes.where("error is not null").count() == 1
    found = findings.dedupe_and_rank(findings.findings(scopes)).collect()
    assert [(r["path"], r["severity"]) for r in found] == [("a.py", "critical"), ("a2.py", "critical")]
    again = findings.dedupe_and_rank(findings.findings(parse.parse_distinct(s).repartition(3))).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in found]


def test_rename_keeps_what_is_found():
    source = "import os\ndef f(folder, request):\n    y = folder\n    os.system(y + request)\n"
    out = rename.alpha(source)
    assert "folder" not in out and "request" in out and "os.system" in out
    assert [h[0] for h in hits(out)] == [h[0] for h in hits(source)]
    assert rename.alpha("def f(:") is None


def test_repair_until_clean(spark):
    s = spark.createDataFrame([("a", "def f(x, y):\n    open(x)\n    eval(x)\n    open(y)\n")], "path string, source string")
    (r,) = patching.repair(s).collect()
    assert r["applied"] == 3 and "os.path.basename(y)" in r["patched"]


def test_repair_has_no_bound_on_patches_or_refusals(spark):
    n = 25
    many = f"def f({', '.join(f'x{i}' for i in range(n))}):\n" + "".join(f"    open(x{i})\n" for i in range(n))
    refused = f"def f(x, y):\n{'    cursor.execute(x)' + chr(10)}" * n + "def g(y):\n    open(y)\n"
    s = spark.createDataFrame([("many", many), ("refused", refused)], "path string, source string")
    assert {r["path"]: r["applied"] for r in patching.repair(s).collect()} == {"many": n, "refused": 1}


@pytest.mark.parametrize("loop", ["reach", "chains", "propagate"])
def test_loops_follow_calls_to_their_end(spark, loop):
    n = 66
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = spark.range(0, n, 1, 1).selectExpr("id as src", "id + 1 as dst", "id as ord", "0 as from_idx", "0 as to_idx")
        seeds = spark.range(0, 1, 1, 1).selectExpr("id as node", "id as fn", "0 as idx", "id as entry")
        params = spark.range(0, n + 1, 1, 1).selectExpr("id as fn", "1 as n")
        out = callgraph.propagate(params, edges, seeds) if loop == "propagate" else getattr(callgraph, loop)(edges, seeds)
        assert sorted(r["fn" if loop == "propagate" else "node"] for r in out.collect()) == list(range(n + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_suppression_partitions_findings(spark):
    s = spark.createDataFrame([(f"d/{n}.py", f"def f(x):\n    {c}(x)\n") for n, c in (("a", "eval"), ("b", "open"))], "path string, source string")
    f = findings.findings(parse.parse(s))
    rules = spark.createDataFrame([("file", "d/a*")], "kind string, pattern string")
    fields = {"file": "path", "cwe": "cwe"}
    assert [r["path"] for r in findings.suppressed(f, rules, fields, True).collect()] == ["d/b.py"]
    assert [r["path"] for r in findings.suppressed(f, rules, fields, False).collect()] == ["d/a.py"]


def test_joins_and_the_parse_stage_resolve_names_alike(spark):
    names = sorted({n for _, n, _, _ in R.sink_aliases()} | set(R.SAFE))
    cases = [(p + n, m) for n in names for p, m in (("", ""), ("x.y.", ""), ("", "pickle"), ("", "django"), ("", "subprocess"))]
    dims = R.dims(spark)
    df = spark.createDataFrame(cases, "name string, module string").selectExpr("name", "array(module) AS modules")
    got = {(r["name"], r["modules"][0]): r["sink"] for r in callgraph.resolve_sinks(df, dims["alias"], dims["safe"], modules="modules").collect()}
    assert got == {(n, m): R.sink_of(n, frozenset([m])) for n, m in cases}
