"""Revisions, corpus building, archives and exports on small cases."""

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from tracegrain import __main__ as cli
from tracegrain.operators import archive, builder, export, features, findings, interproc, learn, parse, report, revisions, studies
from tracegrain.plans import snippets
from tracegrain.sources import readers


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Two commits: one file changes, one goes, one comes; a test and a text file change too."""
    folder = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in (1, 2):
        (folder / "tests").mkdir(exist_ok=True)
        (folder / "a.py").write_text("def f(x):\n    return open(x)\n" if k == 1 else "import os\n\n\ndef f(x):\n    return open(os.path.basename(x))\n")
        (folder / "tests/test_a.py").write_text(f"x = {k}\n")
        (folder / "note.txt").write_text(str(k))
        if k == 1:
            (folder / "gone.py").write_text("eval(input())\n")
        else:
            (folder / "gone.py").unlink()
            (folder / "née.py").write_text("def g(c):\n    eval(c)\n")
        git("add", "-A")
        git("commit", "-qm", str(k))
    return str(folder)


def test_revisions(spark, repository):
    asked = spark.createDataFrame([(repository, "HEAD~1"), (repository, "HEAD")], "repo string, revision string")
    found = {(r["revision"], r["path"]) for r in revisions.tree(asked).collect()}
    assert found == {("HEAD~1", p) for p in ("a.py", "gone.py", "tests/test_a.py")} | {("HEAD", p) for p in ("a.py", "née.py", "tests/test_a.py")}
    commits = spark.createDataFrame([(repository, "HEAD")], "repo string, commit string")
    files = revisions.changed_files(commits)
    assert sorted(r["path"] for r in files.collect()) == ["a.py", "gone.py", "née.py"]
    assert revisions.changed_files(commits, limit=1).count() == 1
    both = revisions.replay(files).persist()
    assert sorted((r["side"], r["path"]) for r in both.collect()) == [("after", "a.py"), ("after", "née.py"), ("before", "a.py"), ("before", "gone.py")]
    entries, errors = revisions.diff_sources(*(both.where(F.col("side") == s).select("path", "source") for s in ("before", "after")))
    assert sorted((r["path"], r["outcome"]) for r in entries.collect()) == [("a.py", "killed"), ("gone.py", "killed"), ("née.py", "introduced")]
    assert errors.count() == 0 and revisions.rendered(entries).first()["line"].startswith("introduced née.py:2 EXEC_COMMAND")


def test_cross_function_flows(spark):
    def flows(*files):
        df = spark.createDataFrame(list(files), "path string, source string")
        return sorted((tuple(r["chain"]), r["sink"], r["sink_file"], tuple(r["origins"]), tuple(r["param_indices"])) for r in interproc.cross_flows(parse.parse(df).persist()).collect())

    sink = ("db.py", "def run_query(q):\n    cur.execute(q)\n")
    view = ("app.py", "import db\ndef view(request):\n    q = 'SELECT ' + request.GET['n']\n    db.run_query(q)\n")
    assert flows(sink, view) == flows(view, sink) == [(("view", "run_query"), "SQL_EXECUTE", "db.py", ("PARAM",), (0,))]
    assert flows(sink, ("app.py", "import db\ndef view():\n    db.run_query('SELECT 1')\n")) == []
    assert flows(("r.py", "def recurse(n, acc):\n    if n:\n        return recurse(n - 1, acc + str(n))\n    return cur.execute(acc)\n")) == []
    chain = [(f"{a}.py", f"def {a}(q):\n    return {b}(q)\n") for a, b in ("ab", "bc", "cd")] + [("d.py", "def d(q):\n    cur.execute(q)\n")]
    assert [x[0] for x in flows(*chain)] == [("a", "b", "c", "d")]


def test_builder(spark):
    source = "import os\nLIMIT = 3\nx = 1\n\n\n@deco\ndef f():\n    def g():\n        pass\n    return g\n\n\nclass A:\n    def save(self):\n        return 1\n\n    def save(self):\n        return 2\n"
    got = builder.function_spans(source)
    assert [q for q, *_ in got] == ["f", "f.g", "A.save", "A.save#2"]
    assert got[0][1].startswith("@deco\ndef f") and got[2][1] == "def save(self):\n    return 1" and builder.context_of(source) == "import os\nLIMIT = 3"
    assert builder.function_spans("def (") == [] and builder.context_of(None) == ""
    df = spark.createDataFrame([("a", "import requests\nrequests.get(u)\nx.execute()\nx.execute(q)\ny().open(z)\n"), ("b", "def (")], "path string, source string")
    assert sorted(tuple(r) for r in builder.expected_classes(builder.ast_calls(df)).collect()) == [("a", "CWE-22"), ("a", "CWE-89"), ("a", "CWE-918")]


def test_archive_is_reproducible(spark, tmp_path):
    rows = [(i // 2, "vulnerable" if i % 2 else "patched", "r", "CWE-1", "t", f"g{i // 4}", f"s{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "pair_id long, kind string, repo string, cwe string, tier string, group string, source string")
    a, b = (archive.freeze(x, str(tmp_path / n)) for x, n in ((df, "a"), (df.repartition(5), "b")))
    assert a["archive_sha256"] == b["archive_sha256"] and a["pairs"] == 4 and a["group"] == {"g0": 4, "g1": 4}
    named = (tmp_path / "a/SHA256SUMS").read_text().split()[0]
    assert named == hashlib.sha256((tmp_path / "a/corpus-8.tar.gz").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="7 records"):
        archive.freeze(df.limit(7), str(tmp_path / "c"))


def test_header_computes_what_the_model_does(spark):
    rows = spark.range(400).selectExpr("cast(id % 7 as double) a", "cast(id % 5 as double) b", "if(id % 7 > 3, 'x', if(id % 5 > 2, 'y', 'z')) label")
    model = learn.train(rows, "label", columns=["a", "b"], trees=3, depth=3)
    nodes, trees = export.flat(model)
    some = rows.distinct()
    for r in model.stages.transform(some).collect():
        got = export.margins(nodes, trees, 3, [r["a"], r["b"]])
        assert all(abs(got[k] - r[f"__r{k}"][1]) < 1e-9 for k in range(3))
    text = export.header(model)
    assert "#define RANKER_CLASSES 3" in text and text.count("{") == text.count("}")


def test_paths_that_do_not_exist_and_folders_with_dots(spark, tmp_path, capsys):
    (tmp_path / "v1.2").mkdir()
    (tmp_path / "v1.2/a.py").write_text("def f(x):\n    eval(x)\n")
    s = readers.from_paths(spark, [f"{tmp_path}/v1.2", f"{tmp_path}/none.py"])
    p = parse.parse(s).persist()
    assert [r["error"] for r in p.where("error is not null").collect()] == ["FileNotFound"] and findings.flows(p).count() == 1
    (tmp_path / "b.py").write_text("import a\ndef top(request):\n    a.f(request.GET['q'])\n")
    assert cli.main(["--path", str(tmp_path), "--cross"]) == 0
    assert '"chain":["top","f"]' in capsys.readouterr().out


def test_prompts_and_answers(spark):
    source = "def f(x):\n    eval(x)\n"
    records = spark.createDataFrame([(1, "a.py", source, "CWE-94", "def f(x):\n    safe_eval(x)\n", "GHSA-1", "abc1234"), (2, "a.py", source, "CWE-89", source, "G", "c")],
                                    "pair_id long, path string, source string, cwe string, patched string, advisory_id string, commit string")
    p = report.prompts(records, findings.flows(parse.parse(readers.from_text(spark, source, "a.py")))).persist()
    r = p.first()
    assert p.count() == 1 and "eval on line 2" in r["prompt"] and r["forbidden"] == ["GHSA-1", "abc1234", "safe_eval(x)"]
    assert report.leak_guard(p, "prompt", "forbidden").count() == 1
    assert report.leak_guard(p.withColumn("prompt", F.concat("prompt", F.lit("GHSA-1"))), "prompt", "forbidden").count() == 0
    manifest = spark.createDataFrame([(1, "one"), (2, "two")], "pair_id long, name string")
    got, missing = report.answers(manifest, spark.createDataFrame([("one", "```python\nx = 1\n```")], "name string, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, "x = 1")] and [r["pair_id"] for r in missing.collect()] == [2]


def test_deep_and_broken_sources_are_flagged():
    deep = "x = " + "(" * 90 + "1" + ")" * 90 + " + a" * 180
    assert [r[1] for r in parse.facts("d.py", deep)] == ["TooDeep", None]
    broken = "class A:\n    def ok(self, p):\n        return open(p)\n\n    def bad(self:\n        pass\n\n\ndef fine(c):\n    eval(c)\n"
    rows = parse.facts("b.py", broken)
    assert rows[0][1] == "SyntaxError" and [r[5] for r in rows[1:]] == ["<module>", "A.ok", "fine"]


@pytest.mark.parametrize(("pattern", "safe"), [
    (r"^[a-z0-9_]+$", True), (r"^[a-z]+\.log$", True), (r"^[\w-]+\Z", True), (r"^[^/\\]+$", True), (r"^(a|b)+$", True),
    (r"^.+$", False), (r"^[^/]+$", False), (r"^\W+$", False), (r"^\D$", False), (r"^[ -~]+$", False), (r"^a/b$", False), (r"[a-z]+$", False), (r"^[a-z]+", False), ("", False), ("^($", False),
])
def test_path_safe_patterns(pattern, safe):
    assert parse.path_safe(pattern) is safe


def test_bootstrap_is_that_of_resampling(spark):
    """Rare values: weights of one row have the mean 1, so the interval is that of drawing rows."""
    import numpy as np

    x = np.random.default_rng(3).lognormal(0, 1, 300)
    r = studies.bootstrap(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    drawn = np.sort(np.random.default_rng(4).choice(x, (4000, 300)).mean(axis=1))
    assert abs(r["mean"] - x.mean()) < 1e-9 and abs(r["low"] - drawn[100]) < 0.06 and abs(r["high"] - drawn[3900]) < 0.06


def test_features_against_their_templates(spark):
    f = {r["function"]: r for r in features.extract(parse.parse(snippets.sources(spark.range(44), "id"))).collect()}
    run = f["run_4"]
    assert (run["sink_count"], run["flow_count"], run["arg_count"], run["scat_exec"], run["tainted_exec"], run["origin_param"], run["sink_high_risk"]) == (1, 1, 1, 1, 1, 1, 1)
    assert (run["has_external_origin"], run["max_path_length"], run["sink_at_positional"], run["scat_sql"]) == (0, 3, 1, 0)
    assert f["safe_3"]["kill_html_escape"] == 1 and f["safe_3"]["has_full_mitigation_observed"] == 1 and f["safe_3"]["flow_count"] == 0
    assert f["splat_39"]["sink_at_splat"] == 1 and f["keyword_38"]["sink_at_keyword"] == 1 and f["global_28"]["has_global_only_origin"] == 1
    assert f["show_0"]["has_external_origin"] == f["show_0"]["origin_request"] and f["mark_11"]["has_amplifier"] == 1
