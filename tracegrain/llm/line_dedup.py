"""Operator 1: near-duplicate lines by a segment-partition edit join.

Lines within ``edits(length)`` edits of each other form classes; the first line
of each class stays.  A line is cut into edits + 1 segments of nearly equal
length.  A line within that many edits holds one of the segments unchanged, at a
place that the two lengths and the number of edits restrict.  So segments are
indexed under (length, segment, substring), and a line looks up, for its own and
each shorter length in reach, the substrings that start at those places, under
the same key.  Pairs that share a key are verified by bit-parallel edit distance
in a diagonal band, and grouped (cluster.py).

Edits: 2 for lines of 20 code points and more, 1 from 10, none below; for a pair
the longer line counts.  So a similarity of 0.9 is met at 10 and 20 code points
only, and long lines that differ in more than two places stay: the number of keys
grows with the square of the edits, and a line's are indexed for all of them.

Scale: a task reads each line once however often it comes (until it has seen
SEEN lines of different hash), so a hot line adds a row of 17 bytes for each key
and task.  Index keys are counted by key first, and rows meet those counts and
each other in joins that Spark can split, so a segment that very many different
lines share meets in no single task.  Lines are named by 64-bit hashes: two
different lines of one name count as one, which among 1e9 has a chance of 3 %.

Edge cases: a null text has no line, an empty text one empty line; empty and
short lines are near duplicates only of equal lines; very long lines are compared
whole; null doc_ids come last in the order that decides which line stays, lines
of equal place in rows of equal doc_id tie and all stay; repeated rows keep one
of their lines otherwise; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster
from .common import cut, forget, small_batches

MOST = 2
#: How many line hashes a task remembers, 100 bytes each.
SEEN = 200_000
_SIGN = 2**63


def edits(length: int) -> int:
    return 2 if length >= 20 else 1 if length >= 10 else 0


def _hash(data: bytes, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - 2 * _SIGN if h >= _SIGN else h


def name(line: str) -> int:
    """What a line is called here."""
    return _hash(line.encode("utf-8", "surrogatepass"))


def _distinct(batches):
    """The lines of a task that can have near duplicates, each once."""
    seen: set[int] = set()
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            for line in text.split("\n"):
                if len(line) >= 9:
                    h = hash(line)
                    if h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        out.append(line)
        yield out


def _segments(size: int, k: int) -> list[tuple[int, int]]:
    """(start, width) of k + 1 segments; the last ones are one longer."""
    base, longer = divmod(size, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        width = base + (i >= k + 1 - longer)
        out.append((at, width))
        at += width
    return out


_PLANS: dict[int, list[tuple[int, int, int, bool]]] = {}


def plan(n: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, indexed) of the keys of a line of n code points.

    A key is a substring under a seed made of the edits, the length of the line
    it is indexed for, and the segment's number.
    """
    if n in _PLANS:
        return _PLANS[n]
    out = []
    k = edits(n)
    if k:
        for less in range(k + 1):
            # the other line has n - less code points; the longer one's edits count
            for i, (start, width) in enumerate(_segments(n - less, k)):
                for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                    at = start + shift
                    if at >= 0 and at + width <= n:
                        out.append(((n - less) << 4 | k << 2 | i, at, at + width, less == shift == 0))
    # a line just below a length class is also indexed for the longer lines of that class
    for more, least in ((1, 10), (2, 20)):
        if 0 < least - n <= more:
            out += [(n << 4 | more << 2 | i, start, start + width, True) for i, (start, width) in enumerate(_segments(n, more))]
    if len(_PLANS) < 4096:
        _PLANS[n] = out
    return out


def line_keys(line: str) -> list[tuple[int, bool]]:
    raw = line.encode("utf-32-le", "surrogatepass")
    return [(_hash(raw[4 * start : 4 * end], seed), indexed) for seed, start, end, indexed in plan(len(line))]


def _keys(batches):
    digest, twos = xxhash.xxh3_64_intdigest, np.uint64
    for lines in _distinct(batches):
        for at in range(0, len(lines), 5_000):
            part = lines[at : at + 5_000]
            b, n, own, indexed = [], [], [], []
            for line in part:
                raw = line.encode("utf-32-le", "surrogatepass")
                keys = plan(len(line))
                b += [digest(raw[4 * start : 4 * end], seed) for seed, start, end, _ in keys]
                indexed += [x for _, _, _, x in keys]
                n.append(len(keys))
                own.append(name(line))
            yield pd.DataFrame({"b": np.array(b, twos).view(np.int64), "t": np.repeat(np.array(own, np.int64), n), "indexed": np.array(indexed, bool)})


def keys(docs: DataFrame) -> DataFrame:
    """(b, t, indexed) of the lines of (text): index keys, and keys to look up."""
    return docs.mapInPandas(_keys, "b long, t long, indexed boolean")


def edit_distance(a: str, b: str, most: int = MOST) -> int:
    """The edit distance, or most + 1 if it is larger: bit vectors along a band of the matrix."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_b and a[start] == b[start]:
        start += 1
    while end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not b:
        return len(a)
    # rows of a, columns of b; the band holds the rows from j - most to j + most
    width = 2 * most + 1
    mask, diagonal = (1 << width) - 1, 1 << most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # bit r of column j is row j - most + r; before the first column, rows below 0 don't count
    vp, vn = (mask >> most) << most, 0
    score = 0
    for j, c in enumerate(b):
        x = places.get(c, 0)
        low = j - most
        x = (x >> low if low >= 0 else x << -low) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = vn | (~(d0 | vp) & mask)
        hn = d0 & vp
        if not d0 & diagonal:
            score += 1
            if score > 2 * most:
                return most + 1
        down = d0 >> 1
        vp = hn | (~(down | hp) & mask)
        vn = down & hp
    # from the diagonal's row down to the last one
    for r in range(1, len(a) - len(b) + 1):
        bit = 1 << (most + r - 1)
        score += bool(vp & bit) - bool(vn & bit)
    return min(score, most + 1)


def parities(line: str) -> tuple[int, int]:
    """64 bits that an edit changes two of at most, and 128 that it changes four of.

    Bit i of the first: whether an odd number of code points is i modulo 64; of the
    others: whether an odd number of pairs of neighbours hash to i.  Ends count as neighbours.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return 0, 0
    one = np.bincount(codes & np.uint32(63), minlength=64) & 1
    edged = np.concatenate([[np.uint32(1)], codes, [np.uint32(2)]]).astype(np.uint64)
    pairs = (edged[:-1] * np.uint64(0x9E3779B97F4A7C15) + edged[1:]) * np.uint64(0xD6E8FEB86659FD93)
    two = np.bincount((pairs >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    return int.from_bytes(np.packbits(one.astype(np.uint8)).tobytes(), "big"), int.from_bytes(np.packbits(two.astype(np.uint8)).tobytes(), "big")


def linked(centre: str, others: list[str]) -> list[bool]:
    """Whether the edits are as few as the longer line may have."""
    # an edit changes the counts of any characters by two at most
    some = [(c, n) for c, n in Counter(centre).most_common(12)]
    out = []
    for x in others:
        most = edits(max(len(centre), len(x)))
        may_be = sum(abs(x.count(c) - n) for c, n in some) <= 2 * most
        out.append(may_be and edit_distance(centre, x, most) <= most)
    return out


def _signed(x: int) -> int:
    x &= 2 * _SIGN - 1
    return x - 2 * _SIGN if x >= _SIGN else x


def _features(lines: pd.Series) -> pd.DataFrame:
    """What cluster.classes() knows of a line: parities, and its keys."""
    rows = []
    with np.errstate(over="ignore"):
        for line in lines:
            one, two = parities(line)
            own = line_keys(line)
            rows.append(([_signed(one)], [_signed(two), _signed(two >> 64)], sorted({b for b, i in own if i}), sorted({b for b, _ in own})))
    return pd.DataFrame(rows, columns=["ones", "twos", "index", "keys"])


def _near(x: Column, y: Column) -> Column:
    def differ(name: str) -> Column:
        bits = F.zip_with(x[name], y[name], lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return F.aggregate(bits, F.lit(0), lambda s, n: s + n)

    return (differ("ones") <= 2 * MOST) & (differ("twos") <= 4 * MOST)


def _first(b: Column, x: Column, y: Column) -> Column:
    # in other buckets that they share neither is indexed, and they aren't compared
    return F.array_min(F.array_union(F.array_intersect(x["index"], y["keys"]), F.array_intersect(x["keys"], y["index"]))) == b


def members(docs: DataFrame) -> DataFrame:
    """(b, t, indexed) of the keys that two different lines share, one of them indexed."""
    every = cut(keys(docs))
    index = every.where("indexed").groupBy("b").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    looked = every.where("not indexed").join(cut(index).hint("merge"), "b").where("low < high or t != low").select("b", "t")
    looked = cut(looked.distinct())
    shared = cut(index.where("low < high").select("b").unionByName(looked.select("b")).distinct())
    own = every.where("indexed").join(shared.hint("merge"), "b", "left_semi").select("b", "t")
    out = cut(own.withColumn("indexed", F.lit(True)).unionByName(looked.withColumn("indexed", F.lit(False))).groupBy("b", "t").agg(F.max("indexed").alias("indexed")))
    forget(every, looked, shared)
    return out


def line_classes(docs: DataFrame) -> DataFrame:
    """(t, label) of the distinct lines that have near duplicates."""
    texts = small_batches(docs).select("text").where("text is not null")

    def lines(batches):
        for part in _distinct(batches):
            yield pd.DataFrame({"t": np.array([name(x) for x in part], np.int64), "text": pd.Series(part, dtype=object)})

    def texts_of(names: DataFrame) -> DataFrame:
        return texts.mapInPandas(lines, "t long, text string").join(names.hint("merge"), "t").dropDuplicates(["t"])

    def features_of(own: DataFrame) -> DataFrame:
        made = F.pandas_udf(_features, "ones array<long>, twos array<long>, index array<long>, keys array<long>")
        return own.select("t", made("text").alias("x"))

    return cluster.classes(members(texts), features_of, texts_of, linked, _near, _first)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_class, class_lines, kept) of every line of every document."""
    label = line_classes(docs)
    named = F.pandas_udf(lambda texts: texts.map(lambda x: [name(line) for line in x.split("\n")]), "array<long>")
    rows = docs.where("text is not null").select("doc_id", F.posexplode(named("text")).alias("line_no", "t"))
    rows = cut(rows.join(label.hint("merge"), "t", "left").select("doc_id", "line_no", F.coalesce("label", "t").alias("line_class")))
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long").alias("d"), F.col("line_no").alias("l"))
    first = cut(rows.groupBy("line_class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_lines")))
    return rows.join(first.hint("merge"), "line_class").select("doc_id", "line_no", "line_class", "class_lines", (order == F.col("first")).alias("kept"))
