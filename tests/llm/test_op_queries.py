"""The opN_ queries themselves, over whole tables, against brute force written from their contracts."""

import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
import pytest

from .test_operators import SF, WORDS, components, edits, near_expected, removed, targets
from tracegrain.llm import media, queries


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))


def test_op1(spark, docs, tmp_path):
    """Sixty real lines, each with some of its near copies, and short and equal ones."""
    lines = list(dict.fromkeys(x for t in docs.text.dropna() for x in t.split("\n") if x))[:60]
    every = [y for i, x in enumerate(lines) for y in (x, x[:3] + "#" + x[4:], x[1:-1], x.replace("e", "", 3)[: 10 + i], x[: i % 12])]
    table = pd.DataFrame({"doc_id": range(0, len(every), 6), "text": ["\n".join(every[i : i + 6]) for i in range(0, len(every), 6)], "source": "s"})
    table.to_parquet(tmp_path / "documents.parquet")
    flat = [(i, k, x) for i, t in zip(table.doc_id, table.text, strict=True) for k, x in enumerate(t.split("\n"))]
    most = lambda n: 2 if n >= 20 else 1 if n >= 10 else 0
    links = []
    for i, (_, _, a) in enumerate(flat):
        for j in range(i):
            b = flat[j][2]
            n = most(max(len(a), len(b)))
            if a == b or n and abs(len(a) - len(b)) <= n and sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) <= 2 * n and edits(a, b) <= n:
                links.append((i, j))
    want = components(len(flat), links)
    got = {(r["doc_id"], r["line_no"]): r for r in queries.op1_segment_edit_lines(spark, str(tmp_path)).collect()}
    mine = [got[d, k]["line_class"] for d, k, _ in flat]
    assert len(got) == len(flat) and len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want)) < len(flat)
    assert all(got[d, k]["class_lines"] == c for (d, k, _), c in zip(flat, map(Counter(want).get, want), strict=True))


class Article(HTMLParser):
    """The blocks inside article elements of the synthetic pages."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.run = 0, [], []

    def cut(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ("p", "h1", "h2", "br", "li", "ul", "div"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "ul", "div", "article"):
            self.cut()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.run.append(data)


def test_op2(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op2_wrapper_extraction(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, url, page in zip(pages.page_id.tolist(), pages.url.tolist(), pages.html.tolist(), strict=True):
        a = Article()
        a.feed(page or "")
        a.cut()
        assert got[i]["text"] == "\n".join(a.blocks) and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == url


def test_op4(spark, rows):
    got = {r["doc_id"]: r for r in queries.op4_interleaved_media(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored, r = media.encode_image(padded), got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        # the feature from its definition: which of 64 columns are above the mean, and the entropy of the samples
        columns = [sum(padded[c::64]) for c in range(64)]
        share = [n / len(padded) for n in Counter(padded).values()]
        import math

        bits = int("".join("1" if c * 64 > sum(columns) else "0" for c in columns), 2)
        mask, entropy = r["feature"].split(":")
        assert mask == f"{bits:016x}" and abs(float(entropy) + sum(p * math.log2(p) for p in share)) < 1e-5


def test_op5(spark, rows):
    import re

    items = pd.read_parquet(f"{SF}/benchmark.parquet")

    def runs(text, n):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for i, t in zip(items.item_id.tolist(), items.text.tolist(), strict=True):
        n = min(5, len(re.findall(r"\w+", (t or "").lower())))
        own = runs(t, n) if n else set()
        for d, x in rows if own else ():
            both = len(own & runs(x, n))
            if both >= 0.8 * len(own):
                want[d, i] = (both, len(own))
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in queries.op5_containment_decontam(spark, SF).collect()} == want and want


def test_op6(spark, rows):
    got = queries.op6_histogram_shards(spark, SF).collect()
    texts = dict(rows)
    total, slots = Counter(), {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and set(total) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(total.values()) / 8
    assert max(abs(n - mean) for n in total.values()) <= 0.001 * mean + max(len((t or "").encode()) + 1 for t in texts.values())


def test_op7(spark, rows):
    got = queries.op7_noisy_or_toxicity(spark, SF).collect()
    texts, by_text = dict(rows), {}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert by_text.setdefault(texts[r["doc_id"]], r["score"]) == r["score"]


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in queries.op8_block_mixing(spark, SF).collect()}
    sizes, taken = Counter(), Counter()
    for d, s, t in zip(docs.doc_id.tolist(), docs.source.tolist(), docs.text.tolist(), strict=True):
        assert got[d]["size"] == len(WORDS(t or "")) and got[d]["taken"] <= 3 * got[d]["size"]
        sizes[s] += got[d]["size"]
        taken[s] += got[d]["taken"]
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 and all(abs(r["target"] - want[s]) < 1e-6 * want[s] and r["source_size"] == sizes[s] for r in got.values() if r["source"] == s) for s in want)


def test_op9(spark, rows):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op9_doubling_substrings(spark, SF).collect())
    assert got == removed(rows)


def test_op10(spark, rows):
    got = queries.op10_dart_minhash(spark, SF).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == near_expected(rows)
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted({r["class_id"] for r in got})
