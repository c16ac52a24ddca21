"""Operator 10: near-duplicate documents by DartMinHash.

A document is the multiset of its five-word runs.  Each occurrence of an element
is a unit of its weight.  Units throw darts: a Poisson process along a rank axis,
drawn by hashing the unit, every dart with a coordinate of the signature.  A
coordinate keeps the dart of lowest rank, so two documents agree in one with the
probability of their weighted Jaccard similarity.  Ranks are thrown cell by cell,
each as wide as all before it; once every coordinate has a dart, no later cell
matters, so long documents throw few darts for each unit and short ones many.

Of each dart 8 bits are kept, in 48 bands of 8 darts, a number of 64 bits each.
These bands meet a document of similarity 0.8 with a chance of 1 - 1.5e-4, and one
of 0.4, such as texts that share a passage, with 3 %.  What shares a band is
verified by its exact weighted Jaccard similarity, 0.8 or more, and grouped
(cluster.py).  Texts that may still be linked across classes get a wider signature
of 1,536 darts, 4 bits of each.  Pairs are left out where more than ``WIDE_DIFFER``
of those differ, or ``DIFFER`` of the 384, or ``BITS_DIFFER`` of one bit of each,
which a pair at 0.8 does with a chance of 8e-5, and a closer one less often.
Equal texts are one element of the join and meet again at the end.

Texts are named by 64-bit hashes: among 1e9 different texts, two get one name
with a chance of 3 %, and would then count as copies.

Scale: signatures are 440 bytes for each row.  Texts are shuffled once, to meet
the names of those that share a band; only these are kept.  Long texts need
memory in proportion to their own length only.

Edge cases: null texts are empty; all texts without a word are alike only if
equal; a text of fewer than five words is one element; the class is named by
its lowest doc_id (null ones last); repeated rows have equal classes, and each
is kept if one is; of texts that tie for the lowest doc_id, the one of lower hash
is kept; an empty table gives no rows.  Extra columns stay; those named class_id
or kept get _in appended.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster
from .common import cut, forget, fresh, out_of_the_way, small_batches, word_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 48, 8
K = BANDS * ROWS
DIFFER, BITS_DIFFER = 108, 68
WIDE = 4 * K
WIDE_DIFFER = 349
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
FIRST_CELL = 1.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _cdf(mean: float) -> np.ndarray:
    """P(Poisson(mean) <= i), long enough to end at 1."""
    i = np.arange(int(mean + 12 * mean**0.5 + 24))
    logs = i * np.log(mean) - mean - np.cumsum(np.log(np.maximum(i, 1)))
    return np.cumsum(np.exp(logs))


def elements(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words, or of all of a shorter text."""
    n = min(SHINGLE, len(h))
    if not n:
        return h
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _C1 + h[i : i + m]
    return _mix(out + np.uint64(n))


def units(x: np.ndarray) -> np.ndarray:
    """A name for each occurrence: the element and how often it came before."""
    x = np.sort(x)
    if len(x) > 1:
        new = np.concatenate([[True], x[1:] != x[:-1]])
        if not new.all():
            at = np.arange(len(x))
            x = x + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _C3
    return _mix(x)


_CELLS: list[tuple[float, float, np.ndarray]] = []


def _cell(m: int) -> tuple[float, float, np.ndarray]:
    while len(_CELLS) <= m:
        i = len(_CELLS)
        low, high = (0.0, FIRST_CELL) if not i else (FIRST_CELL * 2.0 ** (i - 1), FIRST_CELL * 2.0**i)
        _CELLS.append((low, high - low, _cdf(high - low)))
    return _CELLS[m]


def signature(u: np.ndarray, k: int = K) -> np.ndarray:
    """The k darts that stay, by coordinate."""
    rank, dart = np.full(k, np.inf), np.zeros(k, np.uint64)
    open_ = np.ones(k, bool)
    m = 0
    while True:
        low, width, cdf = _cell(m)
        e = _mix(u + np.uint64(m + 1) * _C3)
        p = (e >> np.uint64(11)).astype(np.float64) * 2.0**-53
        n = np.searchsorted(cdf, p, side="right")
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = _mix(np.repeat(e, n) * _C2 + i.astype(np.uint64) + np.uint64(1))
        c = ((d >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        # a later cell only has higher ranks
        some = open_[c]
        if not some.all():
            d, c = d[some], c[some]
        if len(d):
            r = low + width * ((_mix(d) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            order = np.argsort(r)[::-1]
            best = np.full(k, -1)
            best[c[order]] = order  # the last written, the lowest rank, stays
            own = np.flatnonzero(best >= 0)
            rank[own], dart[own] = r[best[own]], d[best[own]]
            open_[own] = False
            if not open_.any():
                return dart
        m += 1


def bands(dart: np.ndarray) -> np.ndarray:
    """8 bits of each dart, those of a band in one number."""
    return (dart >> np.uint64(8)).astype(np.uint8).view(np.int64)


def sketch(dart: np.ndarray) -> np.ndarray:
    """A bit of each dart, 64 to a number."""
    return np.packbits((dart >> np.uint64(7)).astype(np.uint8) & 1).view(np.int64)


def wide(u: np.ndarray) -> np.ndarray:
    """4 bits of each of WIDE darts, 16 to a number."""
    four = (signature(u, WIDE) >> np.uint64(8)).astype(np.uint8) & 15
    return (four[::2] | four[1::2] << 4).view(np.int64)


def _features(texts: pd.Series) -> pd.DataFrame:
    """What cluster.classes() knows of a text that is compared across classes."""
    rows = []
    for text in texts:
        with np.errstate(over="ignore"):
            u = units(elements(word_hashes(text)))
            dart = signature(u)
            rows.append((bands(dart), sketch(dart), wide(u)))
    return pd.DataFrame(rows, columns=["bands", "bits", "wide"])


SIGNED = "t long, d long, bands array<long>, bits array<long>"


def _sign(batches):
    for pdf in batches:
        out, bits = [], []
        for text in pdf["text"]:
            h = word_hashes(text)
            with np.errstate(over="ignore"):
                dart = signature(units(elements(h))) if len(h) else None
            out.append(None if dart is None else bands(dart))
            bits.append(None if dart is None else sketch(dart))
        yield pd.DataFrame({"t": pdf["t"], "d": pdf["d"], "bands": pd.Series(out, dtype=object), "bits": pd.Series(bits, dtype=object)})


def _bucket(place: Column, band: Column) -> Column:
    """The name of a band's bucket; its last six bits are the band's place."""
    return F.xxhash64(place, band).bitwiseAND(F.lit(-64)).bitwiseOR(place.cast("long"))


def _near(x: Column, y: Column) -> Column:
    bits = F.zip_with(x["bits"], y["bits"], lambda p, q: F.bit_count(p.bitwiseXOR(q)))

    def bytes_differ(p: Column, q: Column) -> Column:
        z = p.bitwiseXOR(q)
        for n in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, n))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    def fours_differ(p: Column, q: Column) -> Column:
        z = p.bitwiseXOR(q)
        for n in (2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, n))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    def total(each: Column) -> Column:
        return F.aggregate(each, F.lit(0), lambda s, n: s + n)

    near = (total(bits) <= BITS_DIFFER) & (total(F.zip_with(x["bands"], y["bands"], bytes_differ)) <= DIFFER)
    return near & (total(F.zip_with(x["wide"], y["wide"], fours_differ)) <= WIDE_DIFFER)


def _first(b: Column, x: Column, y: Column) -> Column:
    same = F.transform(F.zip_with(x["bands"], y["bands"], lambda p, q: p == q), lambda e, i: F.when(e, i))
    return F.array_min(same) == b.bitwiseAND(F.lit(63))


def linked(centre: str, others: list[str]) -> list[bool]:
    """Whether the weighted Jaccard similarity, exactly, is SIMILAR or more."""

    def of(text: str):
        with np.errstate(over="ignore"):
            return np.unique(elements(word_hashes(text)), return_counts=True)

    x, cx = of(centre)
    n, out = int(cx.sum()), []
    for text in others:
        y, cy = of(text)
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        hit = x[at] == y
        both = int(np.minimum(cx[at[hit]], cy[hit]).sum())
        # both / either >= 0.8, in whole numbers
        out.append(5 * both >= 4 * (n + int(cy.sum()) - both))
    return out


def named(docs: DataFrame) -> DataFrame:
    """(t, d, text): the text's name, the document's id and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("t"), F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("long").alias("d"), text.alias("text"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(t, d, first): for each distinct text its lowest doc_id, and the (d, t) of the document that its class keeps."""
    rows = named(small_batches(docs))
    signed = cut(rows.mapInPandas(_sign, SIGNED))
    bt = signed.select("t", F.posexplode("bands").alias("j", "band")).select("t", _bucket(F.col("j"), F.col("band")).alias("b"))
    shared = cut(bt.groupBy("b").agg(F.min("t").alias("c"), F.max("t").alias("m")).where("c < m").select("b"))
    members = bt.join(shared.hint("merge"), "b").distinct().withColumn("indexed", F.lit(True))
    owners = cut(signed.groupBy("t").agg(F.min("d").alias("d")))

    def features_of(texts: DataFrame) -> DataFrame:
        made = F.pandas_udf(_features, "bands array<long>, bits array<long>, wide array<long>")
        return texts.select("t", made("text").alias("x"))

    def texts_of(names: DataFrame) -> DataFrame:
        own = names.join(owners.hint("merge"), "t")
        return rows.join(own.hint("merge"), ["t", "d"]).dropDuplicates(["t", "d"]).select("t", "text")

    label = cluster.classes(members, features_of, texts_of, linked, _near, _first)
    forget(signed, shared)
    all_ = cut(owners.join(label.hint("merge"), "t", "left").withColumn("label", F.coalesce("label", "t")))
    lowest = cut(all_.groupBy("label").agg(F.min(F.struct("d", "t")).alias("first")))
    return cut(all_.join(lowest.hint("merge"), "label").select("t", "d", "first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with class_id (the lowest doc_id of its class) and kept (whether it is that document)."""
    t, c = fresh("t"), fresh("c")
    found = near_classes(docs).select(F.col("t").alias(t), F.col("first").alias(c))
    out = out_of_the_way(docs, "class_id", "kept").withColumn(t, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(found.hint("merge"), t, "left")
    last = F.lit(2**63 - 1)
    own = (F.coalesce(F.col("doc_id"), last) == F.col(f"{c}.d")) & (F.col(t) == F.col(f"{c}.t"))
    return out.withColumns({"class_id": F.when(F.col(f"{c}.d") != last, F.col(f"{c}.d")), "kept": own}).drop(t, c)
