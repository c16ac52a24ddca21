"""The pipeline's stages against what each operator promises."""

import re
from collections import Counter

import duckdb
import pandas as pd

import __spark_entry__ as entry
import corpus_pipeline
from tracegrain.llm import mixing, queries, toxicity

from .test_operators import WORDS, near_expected, targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        before, after = {r[0] for r in docs.select("doc_id").collect()}, out.collect()
        assert after and {r["doc_id"] for r in after} <= before
        docs = spark.createDataFrame(after, out.schema)
    assert {"shard", "slot"} <= set(docs.columns)
    by = {}
    for r in docs.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stages_take_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= len(rows)


def test_mixing_meets_its_targets_whatever_the_lengths(spark):
    """Sources of texts of thousands of words whose shares are below a half, between, and above one; rows repeated and without ids."""
    rows = [(i, f"{s} {i} " + "w " * n, "en", s, n) for s, count, least in (("a", 90, 3000), ("b", 20, 2000), ("c", 80, 4000)) for i, n in enumerate(range(least, least + 19 * count, 19))]
    rows += [(500 + i, "x y z", "en", "a", 0) for i in range(40)] + [(None, f"n{i} " + "v " * 2499, "en", "b", 0) for i in range(20)] + [(7000, "r " * 2500, "en", "b", 0)] * 5
    rows += [(8000, "", "en", "a", 0), (8001, None, None, None, 0), (8001, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    sizes, words, longest = {}, {}, {}
    for r in rows:
        n = len((r[1] or "").split())
        sizes[r[3]], longest[r[3]] = sizes.get(r[3], 0) + n, max(longest.get(r[3], 0), n)
    for r in got:
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    want = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert want and {0.3 < r["target"] / r["source_size"] < 0.5 for r in want if r["source"] == "a"} == {True}
    for r in want:
        assert abs(words[r["source"]] - r["target"]) <= longest[r["source"]]
    assert sum(not r["text"] for r in got) == 3 and {tuple(r) for r in got} <= set(rows)
    again = corpus_pipeline.mix_sources(spark, docs.repartition(7), SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_chat_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = c.execute(queries.OP3_SQL)
    names = [d[0] for d in want.description]
    got = sorted(tuple(r[n] for n in names) for r in queries.op3_chat_round_trip(spark, SF).collect())
    assert got == sorted(want.fetchall())


def test_stages_are_what_brute_force_gives_for_their_input(spark):
    """Every stage on all that its predecessor kept of real rows, with near copies, a repeated row and a null text added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    long = max(rows, key=lambda r: len(r[1] or ""))
    words = long[1].split()
    rows += [(9001, " ".join(["changed", *words[1:]]), "en", long[3], 1), (9002, long[1], "en", None, 1), long, (9003, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, docs.schema)
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = (before, [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()], docs)

    before, after, _ = kept["toxicity"]
    scored = toxicity.score(spark.createDataFrame(before, schema=docs.select(*corpus_pipeline.COLUMNS).schema), toxicity.train(spark.createDataFrame(before, docs.select(*corpus_pipeline.COLUMNS).schema), labels))
    assert sorted(map(str, after)) == sorted(str(tuple(r)[:5]) for r in scored.where("score < 0.5").select(*corpus_pipeline.COLUMNS, "score").collect())

    before, after, _ = kept["near_dedup"]
    lowest = {c for _, c in near_expected([(r[0], r[1]) for r in before])}
    assert sorted(r[0] for r in after) == sorted(lowest) and 9001 not in lowest and 9002 not in lowest and 9003 in lowest

    before, after, _ = kept["decontamination"]

    def runs(text, n):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    bad = set()
    for text in items.text:
        n = min(5, len(re.findall(r"\w+", (text or "").lower())))
        own = runs(text, n) if n else set()
        bad |= {r[0] for r in before if own and len(own & runs(r[1], n)) >= 0.8 * len(own)}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in bad) and bad

    before, after, _ = kept["mixing"]
    sizes, words, most = Counter(), Counter(), Counter()
    for r in before:
        n = len(WORDS(r[1] or ""))
        sizes[r[3]] += n
        most[r[3]] = max(most[r[3]], n)
    for r in after:
        words[r[3]] += len(WORDS(r[1] or ""))
    assert all(abs(words[s] - t) <= most[s] for s, t in targets(sizes).items()) and {str(r) for r in after} <= {str(r) for r in before}

    before, after, docs = kept["sharding"]
    size = Counter()
    for r in docs.collect():
        size[r["shard"]] += len((r["text"] or "").encode()) + 1
    assert sorted(map(str, after)) == sorted(map(str, before))
    assert max(abs(n - sum(size.values()) / 8) for n in size.values()) <= max(len((r[1] or "").encode()) for r in before) * max(Counter(before).values()) + 0.001 * sum(size.values())
