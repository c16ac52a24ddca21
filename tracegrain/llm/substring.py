"""Operator 9: removal of repeated passages by level-wise doubling.

Words covered by a window of ``WINDOW`` words whose word sequence also starts
elsewhere go.  Windows are judged from short to long: runs of 9 words that occur
once can't be part of a repeated window, so only the places of repeated runs are
looked at with 18 words, and only those that repeat there with 35.

Level 9 needs no row for each word.  A window of 35 words is represented by the
one of its 27 runs of nine words with the lowest hash (the leftmost of equals).
Equal windows choose equal runs at equal offsets, so nothing is lost, and
neighbouring windows mostly agree: there is a row for each choice, about 7 for a
hundred words.  It stands for the neighbouring windows that chose it and carries
the hashes of the 18 words from the run onwards and of the 18 that end with it;
in a repeated window one of the two lies inside it and repeats too.

Level 35 first compares contexts: all the words of the windows that a choice
stands for.  Where a context repeats, so do all its windows.  Only choices with
more than one context then list their windows, once for each distinct context;
a bit for each window says whether it repeats.

Scale: every level is a count with partial aggregation and a sort-merge
semi-join that Spark can split, so neither a passage that a third of the
documents share nor a group of copies meets in one task: equal contexts become
one row with a count.  Documents are named by a 128-bit hash of their text, so
copies share one row of marks.  Texts are read three times; they are shuffled
once, to meet their marks.  The choices are written once, and their table is
deleted when those that repeat have been written.  Only what several steps read is a
table: on a local file system each task that writes one starts processes.

Edge cases: null and empty texts have no words and keep the digest of the empty
text; shorter documents than a window lose nothing; a repeated row is a document
elsewhere, so both lose all they have if they have a window; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import NO_CHECKSUMS, forget, small_batches, word_hashes, words

WINDOW, SEED = 35, 9
cut = partial(common.cut, **NO_CHECKSUMS)
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of h[i] * P**i, powers of 1/P): hashes of runs of any length come from differences."""
    n = len(h)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = _P
    powers = np.multiply.accumulate(powers)
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = np.uint64(pow(int(_P), -1, 2**64))
    return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * powers[:n])]), np.multiply.accumulate(inverse)


def _runs(s: np.ndarray, inverse: np.ndarray, start: np.ndarray, n) -> np.ndarray:
    """Hashes of the n words (a number or an array) from each start."""
    n = np.asarray(n)
    return _mixed((s[start + n] - s[start]) * inverse[start] + n.astype(np.uint64) * _M)


def choices(h: np.ndarray, window: int = WINDOW, seed: int = SEED):
    """(s, inverse, seeds, first, last, place): windows first .. last choose the run at place."""
    s, inverse = _prefix(h)
    n = len(h) - seed + 1
    seeds = _runs(s, inverse, np.arange(n), seed)
    wide = window - seed + 1
    # leftmost lowest in each window of runs, by doubling
    at, span = np.arange(n), 1
    while span < wide:
        step = min(span, wide - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(seeds[b] < seeds[a], b, a)
        span += step
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])
    return s, inverse, seeds, new, last, at[new]


_CHOICES = "k1 long, k2 long, first int, n int, off int, h9 long, right long, left long, context long"
_WINDOWS = "h9 long, context long, count long, i int, w long"


def _frames(rows: list[tuple], schema: str) -> pd.DataFrame:
    """One frame of many tuples of arrays."""
    columns = [c.split() for c in schema.split(", ")]
    arrays = [np.concatenate([r[i] for r in rows]) for i in range(len(columns))]
    return pd.DataFrame({
        name: x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32 if kind == "int" else np.int64, copy=False)
        for (name, kind), x in zip(columns, arrays, strict=True)
    })


def _in_parts(schema: str, made):
    """A mapInPandas function: made(pdf) gives tuples of arrays, which go out some 50,000 rows at a time."""

    def f(batches):
        for pdf in batches:
            parts, size = [], 0
            with np.errstate(over="ignore"):
                for row in made(pdf):
                    parts.append(row)
                    size += len(row[0])
                    if size > 50_000:
                        yield _frames(parts, schema)
                        parts, size = [], 0
            if parts:
                yield _frames(parts, schema)

    return f


def _choose(window: int, seed: int):
    twice = 2 * seed

    def made(pdf):
        for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["text"], strict=True):
            h = word_hashes(text)
            if len(h) < window:
                continue
            s, inverse, seeds, first, last, place = choices(h, window, seed)
            # the longer run has to lie inside all windows' words; else it says nothing and is left out
            right = np.where(place + twice <= len(h), _runs(s, inverse, np.minimum(place, len(h) - twice), twice), np.uint64(0))
            left = np.where(place >= seed, _runs(s, inverse, np.maximum(place - seed, 0), twice), np.uint64(0))
            context = _runs(s, inverse, first, last - first + window) + (place - first).astype(np.uint64)
            yield np.full(len(first), k1), np.full(len(first), k2), first, last - first + 1, place - first, seeds[place], right, left, context

    return _in_parts(_CHOICES, made)


def _list_windows(window: int):
    """(text, wanted: first and n of choices) to a row for each of their windows."""

    def made(pdf):
        for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
            s, inverse = _prefix(word_hashes(text))
            h9, context, count, first, n, off = (np.array([c[k] for c in wanted], np.int64) for k in ("h9", "context", "count", "first", "n", "off"))
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = _runs(s, inverse, np.repeat(first, n) + i, window) + (np.repeat(off, n) - i).astype(np.uint64)
            yield np.repeat(h9, n), np.repeat(context, n), np.repeat(count, n), i, w

    return _in_parts(_WINDOWS, made)


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(body), "k2": F.xxhash64(F.lit(9), body)})


def _texts(docs: DataFrame) -> DataFrame:
    return _keyed(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "k1", "k2")


def _anew(rows: DataFrame) -> DataFrame:
    """``rows`` as they lie, but dealt by nothing that Spark knows: a join gives them an exchange of its own, which it can split."""
    return rows.coalesce(1 << 20)


def _twice(rows: DataFrame, *by: str) -> DataFrame:
    return _anew(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).where("count > 1").select(*by))


def marks(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(k1, k2, runs): for each text with repeated windows, the first window and the bits of the choices that have some."""
    texts = _texts(small_batches(docs))
    rows = cut(texts.select("k1", "k2", "text").mapInPandas(_choose(window, seed), _CHOICES))
    again = _twice(rows.select("h9"), "h9")
    level1 = cut(rows.join(again.hint("merge"), "h9", "left_semi"))
    forget(rows)
    again = _twice(level1.select(F.explode(F.array("right", "left")).alias("r"), "h9").where("r != 0"), "h9", "r")
    level2 = cut(
        level1.join(again.withColumnRenamed("r", "right").withColumn("a", F.lit(True)).hint("merge"), ["h9", "right"], "left")
        .join(again.withColumnRenamed("r", "left").withColumn("b", F.lit(True)).hint("merge"), ["h9", "left"], "left")
        .where("a or b").drop("a", "b", "right", "left")
    )
    forget(level1)
    # the last level: contexts, one row each
    contexts = cut(level2.groupBy("h9", "context").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("k1", "k2", "first", "n", "off")).alias("at")))
    several = _twice(contexts.select("h9"), "h9")
    open_ = contexts.join(several, "h9", "left_semi")
    wanted = open_.select("at.k1", "at.k2", F.struct("h9", "context", "count", "at.first", "at.n", "at.off").alias("x"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))
    one = texts.join(wanted.hint("merge"), ["k1", "k2"]).select("text", "wanted")
    # copies of a text list the same windows
    listed = cut(one.mapInPandas(_list_windows(window), _WINDOWS).distinct())
    repeated = _anew(listed.groupBy("h9", "w").agg(F.sum("count").alias("s")).where("s > 1").select("h9", "w"))
    bits = listed.join(repeated.hint("merge"), ["h9", "w"]).groupBy("h9", "context").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))
    whole = F.expr("shiftleft(1L, at.n) - 1")
    bits = contexts.where("count > 1").select("h9", "context", whole.alias("bits")).unionByName(
        contexts.where("count = 1").select("h9", "context").join(bits.hint("merge"), ["h9", "context"])
    )
    found = level2.join(bits.hint("merge"), ["h9", "context"]).select("k1", "k2", "first", "bits").distinct()
    out = cut(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "bits")).alias("runs")))
    forget(level2, listed, contexts)
    return out


def _strip(window: int):
    def f(batches):
        for pdf in batches:
            out = []
            for doc, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                tokens = words(text)
                kept = tokens
                if runs is not None and len(runs):
                    edge = np.zeros(len(tokens) + 1, np.int32)
                    for r in runs:
                        first, bits = r["first"], r["bits"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            edge[first + low] += 1
                            edge[first + low + window] -= 1
                            bits &= bits - 1
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, g in zip(tokens, gone, strict=True) if not g]
                text = " ".join(kept)
                out.append((doc, len(tokens), len(tokens) - len(kept), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text))
            got = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
            yield got.astype({"doc_id": "Int64"})

    return f


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document."""
    marked = _texts(docs).join(marks(docs, window, seed).hint("merge"), ["k1", "k2"], "left")
    return marked.select("doc_id", "text", "runs").mapInPandas(
        _strip(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
