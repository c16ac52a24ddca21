import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tracegrain import __main__ as cli
from tracegrain.operators import diffs, features, findings, learn, parse, report, studies
from tracegrain.plans import snippets
from tracegrain.sources import readers
from tracegrain.streaming import findings as streaming


def test_folder_scan_prunes(spark, tmp_path):
    for p in ("a.py", "sub/b.py", "node_modules/c.py", ".hid/d.py", "e.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("def f(x):\n    eval(x)\n")
    got = readers.from_paths(spark, [f"{tmp_path}/", f"{tmp_path}/e.txt"], base=str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in got.collect()) == ["a.py", "b.py", "e.txt"]


def test_records_need_a_group(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"code": "x", "cwe": "CWE-89", "id": "g"}\n{"source": "y"}\n')
    loose = readers.from_records(spark, str(tmp_path / "r.jsonl"), strict=False).collect()
    assert {(r["source"], r["label"]) for r in loose} == {("x", "CWE-89"), ("y", "")}
    with pytest.raises(Exception, match="no group"):
        readers.from_records(spark, str(tmp_path / "r.jsonl")).collect()


def test_rules_and_tool_results(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("cwe: CWE-89",)], "value string")
    assert [tuple(r) for r in readers.suppression_rules(lines).collect()] == [("cwe", "CWE-89")]
    with pytest.raises(Exception, match="not a rule"):
        readers.suppression_rules(spark.createDataFrame([("CWE-89",)], "value string")).collect()
    bandit = 'noise {"results": [{"filename": "a.py", "line_number": 3, "test_name": "t", "issue_cwe": {"id": 78}}]}'
    assert readers.tool_results(spark.createDataFrame([(bandit,)], "value string"), "bandit").first()["cwes"] == ["CWE-78"]
    semgrep = '{"results": [{"path": "a", "check_id": "r", "start": {"line": 2}, "extra": {"metadata": {"cwe": ["CWE-89: x"]}}}]}'
    assert readers.tool_results(spark.createDataFrame([(semgrep,)], "value string"), "semgrep").first()["cwes"] == ["CWE-89"]
    ruff = '[{"filename": "a", "code": "S608", "location": {"row": 9}}]'
    assert readers.tool_results(spark.createDataFrame([(ruff,)], "value string"), "ruff").first()["line"] == 9


def test_advisories(spark):
    item = {"id": "A", "cwes": ["CWE-89"], "references": ["https://github.com/o/r/commit/0123456789ab"]}
    (r,) = readers.advisories(spark.createDataFrame([(json.dumps(item),), ("{bad",)], "value string")).collect()
    assert (r["repo"], r["fix_commits"]) == ("o/r", ["0123456789ab"])


def test_git_blobs(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "m")
    asked = spark.createDataFrame([(str(tmp_path), "HEAD", "a.py"), (str(tmp_path), "HEAD", "b.py")], "repo string, revision string, path string")
    assert {r["path"]: r["source"] for r in readers.git_blobs(asked).collect()} == {"a.py": "x = 1\n", "b.py": None}


def test_corpus_writer_refuses_half_pairs(spark, tmp_path):
    half = spark.createDataFrame([("p", "vulnerable", "x")], "pair_id string, kind string, source string")
    with pytest.raises(ValueError, match="not whole"):
        readers.write_corpus(half, str(tmp_path / "c"))
    readers.write_corpus(half.unionByName(spark.createDataFrame([("p", "patched", "y")], half.schema)), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    rows = snippets.sources(spark.range(40), "id").collect()
    (tmp_path / "in").mkdir()
    line = lambda r: json.dumps({"path": r["path"], "source": r["source"], "at": "2024-01-01T00:00:00"})
    (tmp_path / "in/1.json").write_text("\n".join(map(line, rows[:20])))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    streaming.stream(*args).awaitTermination()
    (tmp_path / "in/2.json").write_text("\n".join(map(line, rows[10:])))
    streaming.stream(*args).awaitTermination()
    streaming.stream(*args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("path", "cwe", "sink").collect()
    batch = findings.dedupe_and_rank(findings.findings(parse.parse(snippets.sources(spark.range(40), "id")))).select("path", "cwe", "sink").collect()
    assert sorted(got) == sorted(batch)


def test_features_and_ranker(spark, tmp_path):
    assert len(features.names()) == len(set(features.names())) == 88
    scopes = parse.parse(snippets.sources(spark.range(176), "id")).persist()
    flows = findings.flows(scopes).where("detector = 'taint'").groupBy("path", "scope").agg(F.min("cwe").alias("label"))
    rows = features.extract(scopes).join(flows, ["path", "scope"]).persist()
    model = learn.train(rows, "label", group="path", trees=2, depth=3)
    learn.save(model, str(tmp_path / "m"))
    out = learn.predict(learn.load(str(tmp_path / "m")), rows)
    e = learn.evaluate(out, "label").first()
    assert e["rows"] == rows.count() and e["accuracy"] > 0.9 and e["top_right"] >= e["right"]
    assert len(learn.importances(model)) == 10
    found = findings.findings(scopes)
    refined = learn.refined(found, scopes, model)
    assert refined.count() == found.count() and refined.where("detector = 'pattern' and reason is not null").isEmpty()
    assert learn.available(str(tmp_path / "none"))[0] is None and learn.available(None) == (None, "") and learn.available(str(tmp_path / "m"))[1] == ""
    (tmp_path / "m/layout").rename(tmp_path / "m/old")
    spark.createDataFrame([(1, ["a"], ["b"])], "version int, features array<string>, labels array<string>").write.json(str(tmp_path / "m/layout"))
    with pytest.raises(ValueError, match="another layout"):
        learn.load(str(tmp_path / "m"))


def test_sarif_and_json(spark):
    f = findings.dedupe_and_rank(findings.findings(parse.parse(readers.from_text(spark, "def f(x):\n    eval(x)\n", "a.py"))))
    log = json.loads(report.sarif_log(f).first()["sarif"])
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["ruleId"] == "CWE-94"
    assert json.loads(report.to_json(f).first()["json"])["cwe"] == "CWE-94"
    assert (report.gate(f, "never"), report.gate(f, "high"), report.gate(f.limit(0), "any")) == (0, 1, 0)
    old = spark.createDataFrame([('{"schema": 2, "trace_id": "x"}',)], "json string")
    with pytest.raises(Exception, match="another schema"):
        report.traces_from_json(old, "trace_id string").collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def f(x):\n    eval(x)\n")
    assert cli.main(["--file", f"{tmp_path}/a.py", "--fail-on", "high"]) == 1
    assert "critical [CWE-94]" in capsys.readouterr().out


def test_diff_with_itself_is_neutral(spark):
    t = findings.flows(parse.parse(snippets.sources(spark.range(32), "id")))
    assert {r["outcome"] for r in diffs.diff(t, t).collect()} == {"residual"}


def test_bootstrap_holds_the_mean(spark):
    r = studies.bootstrap(spark.range(1000).selectExpr("id % 10 as v"), "v", 500).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 0.6
