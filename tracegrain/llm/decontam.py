"""Operator 5: benchmark decontamination by size-partitioned MinHash containment.

Which documents contain 0.8 or more of the five-word shingles of a test item?
A short item in a long document has a tiny Jaccard similarity, which MinHash
can't see, so sizes are partitioned: items by the power of two at or above their
number of shingles, and for a class 2**c each document is read as windows of two
neighbouring blocks of 2**c shingles.  An item's run of shingles lies inside one
such window, where its similarity is 0.19 at least if 0.8 of it is there (0.11
if only half of the item is, the rest being elsewhere), so with ``HASHES``
minima, each a band of one row, a pair is missed with a chance of 4e-5 at 0.19.
Blocks of a class are pairs of blocks of the class below, so all classes together
cost one pass over the shingles.  Candidates are verified by the exact share of
the item's distinct shingles that occur anywhere in the document, comparing words.

Words are lower-case runs of word characters.  An item of fewer than five words
is one shingle of all its words.

Scale: one pass over the documents and no shuffle.  Items are broadcast in blocks
of ``BLOCK_BYTES`` of text (or one item) at most, one block at a time, so neither
the driver nor a task ever holds more of them; a larger benchmark takes another
pass over the documents for each block, whose result is written as a table.

Edge cases: null and empty texts contain nothing and null or wordless items are
contained nowhere; repeated rows give repeated results; no items or documents
give no rows; extra columns are kept by decontaminate() and don't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 48
BLOCK_BYTES = 8_000_000
_TOKEN = re.compile(r"\w+")
_A = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD1B54A32D192ED03 * (i + 1)) % 2**64 | 1 for i in range(HASHES)], np.uint64)
_B = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64((1 << 20) - 1)
#: Shingles that are looked at together.
STEP = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(words: list[str], n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words, alike within one Python process."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + h[i : i + m]
    return _mixed(out)


class Items:
    """What a task needs to find the items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = {}
        self.hashes = {}
        self.classes: dict[tuple[int, int], list[int]] = {}
        for k, (_, text) in enumerate(items):
            words = _TOKEN.findall((text or "").lower())
            n = min(SHINGLE, len(words))
            if n:
                self.words[k] = words
                h, first = np.unique(shingles(words, n), return_index=True)
                self.hashes[k] = (n, h, first)
                self.classes.setdefault((n, (len(h) - 1).bit_length()), []).append(k)
        self.ids = [i for i, _ in items]
        self.tables = {}
        for key, members in self.classes.items():
            every = np.stack([(self.hashes[k][1][:, None] * _A).min(axis=0) for k in members])
            seen = np.zeros(1 << 20, bool)
            seen[every & _LOW] = True
            by: dict[tuple[int, int], list[int]] = {}
            for k, row in zip(members, every, strict=True):
                for j, m in enumerate(row):
                    by.setdefault((j, int(m)), []).append(k)
            self.tables[key] = (seen, by)

    def candidates(self, hashes: dict[int, np.ndarray]) -> set[int]:
        found: set[int] = set()
        for n in {n for n, _ in self.tables}:
            levels = sorted(c for k, c in self.tables if k == n)
            top = 1 << levels[-1]
            step = -(-STEP // top) * top
            # parts overlap by a block of the highest class, so that no window is cut
            for start in range(0, len(hashes[n]), step):
                self._find(hashes[n][start : start + step + top], n, levels, found)
        return found

    def _find(self, h: np.ndarray, n: int, levels: list[int], found: set[int]) -> None:
        low = levels[0]
        pad = (-len(h)) % (1 << low)
        if pad:
            h = np.concatenate([h, np.repeat(h[-1:], pad)])
        minima = (h.reshape(-1, 1 << low, 1) * _A).min(axis=1)  # blocks by hashes
        at = low
        for c in levels:
            while at < c:
                if len(minima) % 2:
                    minima = np.concatenate([minima, minima[-1:]])
                minima = np.minimum(minima[::2], minima[1::2])
                at += 1
            seen, by = self.tables[n, c]
            both = np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima
            row, j = np.nonzero(seen[both & _LOW])
            for key in zip(j.tolist(), both[row, j].tolist(), strict=True):
                found.update(by.get(key, ()))

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item's place, distinct shingles in common, the item's) of the items that the text contains."""
        with np.errstate(over="ignore"):
            words = _TOKEN.findall(text.lower())
            hashes = {n: shingles(words, n) for n in {n for n, _ in self.tables}}
            found = self.candidates(hashes)
            out = []
            ordered = {}
            for k in sorted(found):
                n, h, first = self.hashes[k]
                if n not in ordered:
                    o = np.argsort(hashes[n], kind="stable")
                    ordered[n] = (o, hashes[n][o])
                o, s = ordered[n]
                at = np.searchsorted(s, h)
                common = 0
                for x, i, f in zip(h, at, first, strict=True):
                    own = self.words[k][f : f + n]
                    while i < len(s) and s[i] == x:
                        p = int(o[i])
                        if words[p : p + n] == own:
                            common += 1
                            break
                        i += 1
                if common >= THRESHOLD * len(h):
                    out.append((k, common, len(h)))
            return out


def _blocks(items: list[tuple[int, str]]):
    block, size = [], 0
    for i, text in items:
        n = len((text or "").encode("utf-8", "replace"))
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += n
    if block:
        yield block


def _search(shared):
    def f(batches):
        items = Items(shared.value)
        for pdf in batches:
            rows = [
                (doc, items.ids[k], common, n, common / n)
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) if text
                for k, common, n in items.search(text)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return f


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every pair at or above the threshold."""
    light = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    found = [out for _, out in _passes(light, items.select(item_id, "text"), lambda rows, shared: rows.mapInPandas(_search(shared), schema))]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def _passes(docs: DataFrame, items: DataFrame, step):
    """(block, step(docs, block)) for each block, which is written as a table if it isn't the only one."""
    context = small_batches(docs).sparkSession.sparkContext
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for block in _blocks((r[0], r[1]) for r in items.toLocalIterator()):
        shared = context.broadcast(block)
        out = step(docs, shared)
        if size > BLOCK_BYTES:
            out = cut(out)
            shared.unpersist()
        yield shared, out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with their columns."""

    def keep(rows: DataFrame, shared) -> DataFrame:
        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items = Items(shared.value)
            for texts in batches:
                yield pd.Series([not (t and items.search(t)) for t in texts], dtype=bool)

        return rows.where(clean(F.coalesce("text", F.lit(""))))

    left = [docs]  # what earlier passes have kept
    for _, out in _passes(docs, items.select("item_id", "text"), lambda _, shared: keep(left[0], shared)):
        left[0] = out
    return left[0]
