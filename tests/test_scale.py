"""What keeps queries in proportion to their input: keys dealt out, sources parsed once, no broadcast of what grows; and ties."""

import os

import duckdb
import pytest

from tracegrain.operators import findings, parse
from tracegrain.operators.tables import cut, spread
from tracegrain.plans import queries, snippets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [spread, lambda k: snippets.sources(k, "k"), lambda k: snippets.groups(k, "k")])
def test_keys_of_one_split_go_to_many_tasks(spark, made):
    keys = spark.range(0, 5000, 1, 1).withColumnRenamed("id", "k")
    out = made(keys)
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 3 and max(sizes) < 1.1 * min(sizes)
    assert sum(sizes) == out.count() == (15000 if "file" in plan(out) else 5000)
    assert spread(keys, 3).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("name", ["rename_invariance", "evidence_from_sources", "patch_verify", "source_diff", "kill_rate", "sarif_report", "determinism_rate", "cross_findings"])
def test_sources_are_parsed_once(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "MapInPandas" not in text and "MapInArrow" not in text and "Scan parquet" in text


@pytest.mark.parametrize("name", ["determinism_rate", "token_sequence"])
def test_what_grows_is_not_broadcast(spark, name):
    lines = plan(queries.QUERIES[name](spark, SF)).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:  # the dimension tables are local; all that comes from files grows
            end = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
            assert not any("FileScan" in x for x in lines[at:end])


def test_findings_of_a_table_join_without_broadcasts(spark):
    scopes = cut(parse.parse(snippets.sources(spark.range(60).withColumnRenamed("id", "k"), "k")))
    text = plan(findings.dedupe_and_rank(findings.findings(scopes)))
    # at most the sinks are broadcast, once for what is touched and once for the calls as written
    assert text.count("BroadcastHashJoin") <= 2 and text.count("SortMergeJoin") >= 5


def test_ranker_reads_a_table(spark):
    text = plan(queries.QUERIES["ranker_scores"](spark, SF))
    assert "Window" not in text and "SortMergeJoin" not in text


def test_merged_parts_keep_the_first_of_equal_rows(spark, tmp_path):
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    # Spark reads the larger file first
    con.execute(f"COPY (SELECT k AS l_orderkey, 2::BIGINT AS l_linenumber, 1::BIGINT AS l_suppkey FROM range(50) t(k)) TO '{folder}/a.parquet'")
    con.execute(f"COPY (SELECT k % 50 AS l_orderkey, 1 + k % 2 AS l_linenumber, 2 + k AS l_suppkey FROM range(5000) t(k)) TO '{folder}/b.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = sorted(con.execute(queries.SQL["merged_parts"]).fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["merged_parts"](spark, str(tmp_path)).select("l_orderkey", "part", "value").collect())
    assert got == want and {r[2] for r in got} == {1}
