"""The training-data operators against brute force and on hard rows."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import chat, decontam, html_wrapper, line_dedup, media, mixing, near_dedup, queries, sharding, substring, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(120))
HARD = [
    (1, BASE), (2, BASE.replace("alpha60", "beta")), (3, BASE), (None, BASE), (4, ""), (5, None), (6, LONG), (6, LONG), (None, None), (7, "one"), (8, "a b c d e f"),
    (9, " ".join(f"gamma{i}" for i in range(50)) + " " + " ".join(f"alpha{i}" for i in range(40))),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).withColumns({"label": F.lit("x"), "score": F.lit(1), "t": F.lit(2), "b": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", source string, lang string, n_chars long")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = WORDS(text or "")
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def components(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in links:
        at[find(i)] = find(j)
    return [find(i) for i in range(n)]


def near_expected(rows):
    s = [shingles(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both, all_ = sum((s[i] & s[j]).values()), sum((s[i] | s[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or all_ and both >= 0.8 * all_:
                links.append((i, j))
    c = components(len(rows), links)
    lowest = {}
    for (d, _), k in zip(rows, c, strict=True):
        if d is not None:
            lowest[k] = min(lowest.get(k, d), d)
    return sorted((d if d is not None else -1, lowest.get(k, -1)) for (d, _), k in zip(rows, c, strict=True))


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_op10_is_brute_force(spark, hard, docs, which):
    rows = HARD if which == "hard" else list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    df = hard if which == "hard" else spark.createDataFrame(rows, SCHEMA)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"]) for r in got) == near_expected(rows)
    assert set(df.columns) <= set(got[0].asDict())


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a):
        q = [i + 1]
        for j, d in enumerate(b):
            q.append(min(p[j] + (c != d), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def test_op1_is_brute_force(spark):
    base = ["the quick brown fox jumps over", "short line", "tiny", "another sentence about rivers", "0123456789"]
    lines = []
    for x in base:
        lines += [x, x[:-1], x[1:], x.replace("o", "0", 1), x + "!", x[: len(x) // 2] + "#" + x[len(x) // 2 :], x[:3] + x[5:], x[:2] + "zzz" + x[5:]]
    lines += ["the quick", "", "", "nineteen characters"]
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(-(-len(lines) // 5))] + [(99, None), (None, lines[0])]
    flat = [(d, k, x) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    links = []
    for i, a in enumerate(flat):
        for j in range(i):
            b = flat[j]
            n = max(len(a[2]), len(b[2]))
            most = 2 if n >= 20 else 1 if n >= 10 else 0
            if edits(a[2], b[2]) <= most:
                links.append((i, j))
    want = components(len(flat), links)
    got = line_dedup.line_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    cls = {(r["doc_id"], r["line_no"]): r["line_class"] for r in got}
    mine = [cls[d, k] for d, k, _ in flat]
    assert len(got) == len(flat) and len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    assert sum(r["kept"] for r in got) == len(set(want))


def removed(rows, window=35):
    seen = Counter()
    words = [WORDS(t or "") for _, t in rows]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_op9_is_brute_force(spark, hard, docs, which):
    rows = HARD if which == "hard" else list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    df = hard if which == "hard" else spark.createDataFrame(rows, SCHEMA)
    got = substring.dedup_substrings(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == removed(rows)


def test_op9_writes_few_tables(spark, docs, monkeypatch):
    """A task that writes a table starts a process for each folder, file and checksum; six tables without checksums are needed."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("cut-*"))
    monkeypatch.setattr(substring, "forget", lambda *tables: None)
    got = substring.dedup_substrings(spark.createDataFrame(docs[["doc_id", "text"]])).select("n_removed").collect()
    tables = set(folder.glob("cut-*")) - before
    assert sum(r["n_removed"] for r in got) > 0 and len(tables) == 6 and not [f for t in tables for f in t.rglob("*.crc")]


def test_op9_joins_have_their_own_exchanges(spark):
    rows = spark.range(100).selectExpr("id % 7 AS h9")
    again = substring._twice(rows, "h9")
    plan = rows.join(again.hint("merge"), "h9", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(h9") == 3, plan


def test_op5_is_brute_force(spark, docs):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")

    def runs(text, n):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in zip(items.item_id, items.text, strict=True):
        n = min(5, len(re.findall(r"\w+", (t or "").lower())))
        own = runs(t, n) if n else set()
        if own:
            want |= {(d, i) for d, x in zip(docs.doc_id, docs.text, strict=True) if len(own & runs(x, n)) >= 0.8 * len(own)}
    got = decontam.contained(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want


def test_op5_hard_rows(spark, hard):
    items = spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(20, 32))), (2, ""), (3, None), (None, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6")], "item_id long, text string")
    got = decontam.contained(hard, items).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got if r["item_id"] == 1) == [-1, 1, 2, 3, 9]
    assert [r["doc_id"] for r in got if r["item_id"] is None] == [6, 6]
    assert decontam.decontaminate(hard, items).count() == len(HARD) - 7


def test_op4_reads_back_what_it_stored(spark, hard):
    got = media.text_media(hard).collect()
    assert len(got) == len(HARD)
    texts = {(d, len((t or "").encode())): (t or "").encode() for d, t in HARD}
    for r in got:
        raw = texts[r["doc_id"], r["n_bytes"]]
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_image(padded)).hexdigest() and r["caption"] == f"{len(raw)} bytes"


def test_op4_keeps_places_and_captions():
    page = '<p>one</p><figure><img src="sha256:aa" alt="x"><figcaption>cap &amp; tion</figcaption></figure>two <b>bold</b><img src=bb>'
    assert media.sequence_of(page) == [
        (0, "text", "one", None, None), (1, "media", "x", "aa", "cap & tion"), (2, "text", "two bold", None, None), (3, "media", None, "bb", None),
    ]
    assert media.sequence_of(None) == [] and media.sequence_of("<img") == [(0, "text", "<img", None, None)]


def test_op6_is_near_equal_and_gapless(spark, hard):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot copy', repeat('x', cast(id % 90 as int))) as text").unionByName(hard.select("doc_id", "text").where("doc_id <> 6 or doc_id is null"))
    out = sharding.shard_rows(sharding.keyed(rows), 8).collect()
    size, slots = Counter(), {}
    for r in out:
        size[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(size.values()) / 8
    assert len(out) == rows.count() and set(size) == set(range(8))
    assert max(abs(s - mean) for s in size.values()) <= 0.001 * mean + 1000
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in order}
        full |= set(over)


def test_op8_meets_its_targets(spark, docs):
    rows = [(d, s, t) for d, s, t in zip(docs.doc_id.tolist(), docs.source.tolist(), docs.text.tolist(), strict=True)]
    rows += [(10_001, None, "a few words here"), (10_002, "tiny", "lonely"), (10_003, "tiny", None), (None, "tiny", "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df)[0].collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORDS(t or ""))
    want, taken = targets(sizes), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    key = lambda rs: sorted(str((r["doc_id"], r["source"], r["taken"])) for r in rs)
    assert key(mixing.mix(df.repartition(7))[0].collect()) == key(got)


def test_op3_round_trip(spark):
    bad = [f"{chat.END}{chat.START}assistant ok", "<\\|x<|", None, "", "a\nb", "<\\\\|im_end|>", "plain"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(bad)] + [(2, None, "odd\nrole\\", "t"), (2, 1, None, "u"), (2, 1, None, "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(0), "chunk": F.lit(0)})
    out = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1]["loss"] == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("odd\nrole\\", "t"), ("", "u"), ("", "u")]


def test_op3_escapes_every_control_string(spark, tmp_path):
    """Texts and roles with control strings but no start of a turn, each alone in its conversation, and next to one with all."""
    texts = [f"bye{chat.END}\nrest", f"a{chat.END}b", chat.END, f"{chat.END}\n", "<|x", "<|endoftext|>", "<\\|x", "a < b | c", f"x{chat.END}\n{chat.START}y"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(50, 0, f"r{chat.END}\n", "t"), (51, 0, "<|x", "t")]
    rows += [(60, i, "assistant", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    esc = lambda x: re.sub(r"<(\\*)\|", r"<\1\\|", x)
    want = {}
    for c, _, role, text in rows:
        head = esc(role.replace("\\", "\\\\").replace("\n", "\\n"))
        want[c] = want.get(c, "") + f"{chat.START}{head}\n{esc(text)}{chat.END}\n"
    got = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    assert {r["conv_id"]: r["formatted"] for r in got} == want
    assert all([(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in rows if x[0] == r["conv_id"]] for r in got)
    forged = spark.createDataFrame([(f"{chat.START}user\na{chat.END}\nb{chat.END}\n",), (f"{chat.START}user\na",), (f"{chat.START}user\na{chat.END}",)], "f string")
    assert [r[0] for r in forged.select(chat.parse(F.col("f"))).collect()] == [[None]] * 3
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = c.execute(queries.OP3_SQL)
    names = [d[0] for d in sql.description]
    assert sorted(tuple(r[n] for n in names) for r in queries.op3_chat_round_trip(spark, str(tmp_path)).collect()) == sorted(sql.fetchall())


def test_op7_separates_held_out_rows(spark):
    got = queries.op7_noisy_or_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("score", "toxic").collect()
    pos, neg = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.9


def test_op7_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(hard.drop("score"), labels).collect()
    assert len(out) == len(HARD) and all(0 <= r["score"] <= 1 for r in out)


def test_op2_finds_the_article(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><header>site</header><div class='cookie-notice'>ok?</div><article><h1>Title {i}</h1><p>Text &amp; {i}  more</p><p>Second <b>bold</b> {i}</p></article><aside>side</aside><div id='comments'>bad</div><footer>foot</footer><script>x()</script></body></html>"
    rows = [(i, f"http://h{i % 2}.example/p{i}", page.replace("{i}", str(i))) for i in range(20)] + [(50, None, None), (51, "http://h0.example/", ""), (52, "x", "just text")]
    got = {r["page_id"]: r for r in html_wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"Title {i}\nText & {i} more\nSecond bold {i}" for i in range(20))
    assert got[50]["text"] == got[51]["text"] == "" and got[52]["text"] == "just text" and got[52]["n_chars"] == 9


def test_op2_keeps_what_few_pages_hold(spark):
    """Pages of div elements only: rare headings, items and inline runs stay, what all pages hold in a class of its own goes."""
    rows, want = [], {}
    for i in range(24):
        parts = [(f"Story {i}", f"<h1>Story {i}</h1>"), ("", "<p class='tool'>Print this page</p>"), (f"Words of page {i} come first.", f"<p>Words of page {i} come first.</p>")]
        if i % 8 == 1:
            parts.append((f"Rare heading {i}", f"<h2>Rare heading {i}</h2>"))
        if i == 5:
            parts.append(("It was not late but early on that day.", "<p>It was <b>not late</b> but <i>early</i> on <a href='x'>that day</a>.</p>"))
        if i == 6:
            parts += [("first thing", "<ul><li>first thing</li></ul>"), ("Call f now.", "<p>Call <code>f</code> now.</p>")]
        if i in (7, 9):
            parts.append(("Both of two pages", "<h3>Both of two pages</h3>"))
        parts.append((f"The end of {i}.", f"<p>The end of {i}.</p>"))
        want[i] = "\n".join(t for t, _ in parts if t)
        rows.append((i, f"http://divs.example/{i}", f"<html><body><div class='content'>{''.join(h for _, h in parts)}</div></body></html>"))
    schema = "page_id long, url string, html string"
    for n in (1, 5):
        got = html_wrapper.main_texts(spark.createDataFrame(rows, schema).repartition(n)).collect()
        assert {r["page_id"]: r["text"] for r in got} == want
    # equal wrappers of several tasks count as often as they come
    same = [(i, "http://same.example/", f"<body><div class='content'><p class='tool'>Print this page</p><p>{'long text ' * 9}{i}</p></div></body>") for i in range(16)]
    got = html_wrapper.main_texts(spark.createDataFrame(same, schema).repartition(4)).collect()
    assert all(r["text"] == f"{'long text ' * 9}{r['page_id']}" for r in got)


def test_op2_the_wrapper_decides(spark):
    """Hosts without article elements: what varies is the article, however long a constant is; names alone decide nothing."""
    side = "The same long words about this site stand on each of its pages. " * 30
    rows = [
        (i, "http://plain.example/", f"<body><div class='left'><p>{side}</p></div><div class='right'><h2>Head {i}</h2><p>Always the same short opening.</p><p>What page {i} says.</p></div></body>")
        for i in range(9)
    ]
    history = "<article><div class='article-header'><h1>T</h1></div><p>Text</p><div class='social-history'><p>History kept?</p></div></article>"
    rows += [(100, "http://one.example/", history), (101, "http://copies.example/", rows[0][2]), (102, "http://copies.example/", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Head {i}\nAlways the same short opening.\nWhat page {i} says." for i in range(9)} | {100: "T\nText\nHistory kept?"}
    found = []
    for n in (1, 4, 9):
        got = {r["page_id"]: r["text"] for r in html_wrapper.main_texts(df.repartition(n)).collect()}
        assert {k: got[k] for k in want} == want
        found.append(got)
    assert found[0] == found[1] == found[2] and "What page 0 says." in found[0][101]
    assert html_wrapper.extract(rows[0][2], None) != want[0]  # alone, a page doesn't show what is constant


def test_op2_alignment_is_brute_force():
    import random

    def longest(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(5)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = html_wrapper.aligned(x, y)
        assert len(got) == longest(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    x = [f"n{i}" for i in range(30_000)]
    y = [v for i, v in enumerate(x) if i % 3] + ["z"]
    assert len(html_wrapper.aligned(x, y)) == 20_000
    assert html_wrapper.aligned([f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)]) == []


def test_op2_very_long_pages(spark):
    page = "<body><article>" + "".join(f"<div class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'><p>text {{k}} {i}</p></div>" for i in range(20_000)) + "<div>" * 400 + "deep" + "</article></body>"
    rows = [(k, "http://long.example/", page.replace("{k}", str(k))) for k in range(3)]
    got = html_wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "\n".join([f"text {r['page_id']} {i}" for i in range(20_000)] + ["deep"]) for r in got) and len(got) == 3


def test_op5_in_several_blocks(spark, docs, monkeypatch):
    df, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda out: sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in out.collect())
    whole, left = key(decontam.contained(df, items)), sorted(r[0] for r in decontam.decontaminate(df, items).select("doc_id").collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    assert key(decontam.contained(df, items)) == whole and whole
    assert sorted(r[0] for r in decontam.decontaminate(df, items).select("doc_id").collect()) == left


def test_clashing_columns_stay(spark):
    names = "t c d s n o x more h score predicted worst offending class_id kept shard slot position caption digest feature held_out __t __c __x __d __h __n __r __p __k __o __part".split()
    df = spark.createDataFrame([(1, "one two three", "a"), (2, "one two three", None), (3, "four", "a")], "doc_id long, text string, source string")
    df = df.withColumns({n: F.lit(f"own {n}") for n in names})

    def own(out):
        rows = out.collect()
        assert rows
        for r in rows:
            d = r.asDict()
            assert all(d.get(n + "_in", d.get(n)) == f"own {n}" for n in names), d
        return rows

    assert {r["class_id"] for r in own(near_dedup.near_duplicates(df))} == {1, 3}
    assert all(isinstance(r["score"], float) for r in own(toxicity.toxicity(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))))
    assert sorted(r["shard"] for r in own(sharding.shard_rows(sharding.keyed(df), 2)))[0] == 0
    assert own(mixing.mixed_documents(df))
    assert len(own(decontam.decontaminate(df, spark.createDataFrame([(1, "four")], "item_id long, text string")))) == 2
    pages = df.withColumn("sequence", media.parse_sequence(F.lit("<img src=aa><figcaption>c</figcaption>")))
    rows = own(media.resolve(pages, "sequence", media.media_table(media.stored_media(df))))
    assert len(rows) == 3 and rows[0]["caption"] == "c"
    assert mixing.mix(df)[0].count() == line_dedup.line_rows(df).count() == substring.dedup_substrings(df).count() == 3


def test_very_long_texts_and_ties(spark):
    """A line of 200,000 code points twice with one edit, a text of 20,000 lines; a turn of a million; ties in sentences and rows."""
    line = "".join(chr(97 + i * i % 26) for i in range(200_000))
    many = "\n".join(f"line {i} of a long text, number {i * 7919 % 10007}" for i in range(20_000))
    df = spark.createDataFrame([(1, line), (2, line[:500] + "!" + line[501:]), (3, many), (3, many), (None, "tie tie tie tie"), (None, "tie tie tie tie")], SCHEMA)
    rows = line_dedup.line_rows(df).collect()
    assert len(rows) == 40_004
    first = {r["doc_id"]: r for r in rows if r["line_no"] == 0}
    assert first[1]["line_class"] == first[2]["line_class"] and first[1]["kept"] and not first[2]["kept"]
    # repeated rows tie in id and place: both keep their line
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True, True] and len({r["line_class"] for r in rows if r["doc_id"] is None}) == 1
    turn = "<|im_end|> x " * 80_000
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "user", turn), (1, 0, "user", turn)], "conv_id long, turn long, role string, text string"))
    assert [[t["text"] for t in r["turns"]] for r in out.withColumn("turns", chat.parse(F.col("formatted"))).collect()] == [[turn, turn]]
    model = ({"^bad$": 9.0}, -4.0)
    r = toxicity.score(spark.createDataFrame([(1, "Fine. bad. So bad. Good."), (2, "a. " * 200_000)], SCHEMA), model).orderBy("doc_id").collect()
    assert r[0]["worst"] == 1 and r[0]["offending"] == [1, 2] and r[0]["predicted"] == 1 and r[1]["worst"] == 0


def test_empty_tables_give_no_rows(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert substring.dedup_substrings(empty).count() == 0
    assert line_dedup.line_rows(empty).count() == 0
    assert media.text_media(empty).count() == 0
    assert mixing.mix(empty)[0].count() == 0
    assert sharding.shard_rows(sharding.keyed(empty), 8).count() == 0
    assert decontam.contained(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert html_wrapper.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
