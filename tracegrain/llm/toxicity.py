"""Operator 7: toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences.  A sentence's score is the logistic of the sum
of its words' weights and a bias; a document's score is the noisy-or
1 - prod(1 - s) of its sentences.  Only documents carry labels; the weights are
fitted to them through the noisy-or, so that the sentences that explain a label
get its blame, and the same weights then locate offending sentences.  A word's
weight is the sum of those of the word and its runs of four and five characters.

Learning uses a bounded sample: of the labelled documents whose crc32(doc_id)
mod 5 is not 0, the ``max_docs`` with the lowest hash of the id.  Executors
count in how many toxic and clean documents of the sample each feature occurs;
the ``MAX_FEATURES`` that are most surely more frequent in toxic ones are
fitted, on the driver, on their occurrences alone (``MAX_HITS`` at most, those of
the documents of lowest hash, wherever they lie).
Scores are computed for whole texts of all rows.  An automaton finds the words
that hold a feature in one pass over the text, so nothing is kept between texts.

Edge cases: null and empty texts are one sentence without words; several labels
of one document count as toxic if one is; null labels are none; without a toxic
and a clean label every score is 0; repeated rows get equal scores; of sentences
that tie for the worst the first is named; an empty table gives no rows.  Extra
columns stay; those named like a result get _in appended.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, out_of_the_way, small_batches

#: Bounds of what is learnt from: documents; features; occurrences of features.
MAX_DOCS, MAX_FEATURES, MAX_HITS = 12_000, 4096, 4_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_TOKEN = re.compile(r"\w+")


def sentences(text: str | None) -> list[str]:
    return _SENTENCE.split(text or "")


def features(word: str) -> list[str]:
    """The word, marked at both ends, and its runs of four and five characters; some may repeat."""
    w = f"^{word}$"
    return [w, *[w[i : i + 4] for i in range(len(w) - 3)], *[w[i : i + 5] for i in range(len(w) - 4)]]


def weight_of(word: str, weights: dict[str, float]) -> float:
    return sum(weights[f] for f in sorted({f for f in features(word) if f in weights}))


def _count(batches):
    """(label, text) to (feature, toxic, docs) of a task."""
    toxic, docs, memo = Counter(), Counter(), {}
    for pdf in batches:
        for label, text in zip(pdf["label"], pdf["text"], strict=True):
            seen: set[str] = set()
            for w in set(_TOKEN.findall(text.lower())):
                f = memo.get(w)
                if f is None:
                    if len(memo) > 20_000:
                        memo.clear()
                    f = memo[w] = features(w)
                seen.update(f)
            docs.update(seen)
            if label:
                toxic.update(seen)
    yield pd.DataFrame([(f, toxic[f], n) for f, n in docs.items()], columns=["feature", "toxic", "docs"])


def _encode(chosen: dict[str, int]):
    """(label, text, h) to (label, features of words, their sentences, number of sentences, h)."""

    def f(batches):
        memo: dict[str, list[int]] = {}
        for pdf in batches:
            rows = []
            for label, text, h in zip(pdf["label"], pdf["text"], pdf["h"], strict=True):
                ids, at = [], []
                every = sentences(text)
                for i, s in enumerate(every):
                    for w in set(_TOKEN.findall(s.lower())):
                        own = memo.get(w)
                        if own is None:
                            if len(memo) > 100_000:
                                memo.clear()
                            own = memo[w] = sorted({chosen[x] for x in features(w) if x in chosen})
                        ids += own
                        at += [i] * len(own)
                rows.append((int(label), np.array(ids, np.int32).tobytes(), np.array(at, np.int32).tobytes(), len(every), h))
            yield pd.DataFrame(rows, columns=["label", "ids", "at", "n", "h"])

    return f


def _fit(rows, n_features: int, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by Adam on the noisy-or likelihood."""
    ids, sent, bag, y, n = [], [], [], [], 0
    for d, (label, i, at, k) in enumerate(rows):
        ids.append(np.frombuffer(i, np.int32))
        sent.append(n + np.frombuffer(at, np.int32).astype(np.int64))
        bag.append(np.full(k, d))
        y.append(label)
        n += k
    ids, sent, bag, y = np.concatenate(ids), np.concatenate(sent), np.concatenate(bag), np.array(y, np.float64)
    v, b = np.zeros(n_features), -6.0
    m1, m2, bm1, bm2 = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(sent, v[ids], minlength=n) + b, -30, 30)
        s = 1 / (1 + np.exp(-z))
        log_no = np.bincount(bag, np.log1p(-np.minimum(s, 1 - 1e-9)), minlength=len(y))
        p = np.clip(-np.expm1(log_no), 1e-9, 1 - 1e-9)
        # the likelihood's slope in z is (y / p - 1) * s
        g = (y / p - 1)[bag] * s / len(y)
        gv = np.bincount(ids, g[sent], minlength=n_features) - 0.1 / len(y) * v
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gv, 0.999 * m2 + 0.001 * gv**2
        bm1, bm2 = 0.9 * bm1 + 0.1 * gb, 0.999 * bm2 + 0.001 * gb**2
        lr = 0.15 * (1 - t / (rounds + 1)) + 0.005
        v += lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-7)
        b += lr * (bm1 / (1 - 0.9**t)) / (np.sqrt(bm2 / (1 - 0.999**t)) + 1e-7)
        v = np.maximum(v, 0)
    return v, float(b)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[dict[str, float], float]:
    """(weights by feature, bias) from the bounded sample of the labelled rows."""
    small_batches(docs)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sample = (
        known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_docs)
    )
    rows = cut(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    )
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return {}, -40.0
    base = toxic / n
    counts = rows.select("label", "text").mapInPandas(_count, "feature string, toxic long, docs long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    surely = (F.col("toxic") - F.col("docs") * base) / F.sqrt(F.col("docs") * (base * (1 - base)))
    best = counts.withColumn("z", surely).where("docs >= 3 and z >= 4").orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    chosen = {r["feature"]: i for i, r in enumerate(best)}
    if not chosen:
        return {}, -40.0
    got, hits = [], 0
    sampled = rows.select("label", "text", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    encoded = sampled.mapInPandas(_encode(chosen), "label int, ids binary, at binary, n int, h long")
    for r in encoded.orderBy("h", "label", "n", "ids").toLocalIterator():
        hits += len(r["ids"]) // 4
        if hits > MAX_HITS:
            break
        got.append((r["label"], bytes(r["ids"]), bytes(r["at"]), r["n"]))
    v, b = _fit(got, len(chosen))
    return {f: float(v[i]) for f, i in chosen.items() if v[i] > 0}, b


def heavy_words(text: str, automaton, weights: dict[str, float]) -> dict[str, float]:
    """The words of the lower-case ``text`` that hold a feature, and their weights."""
    marked = "^" + "$^".join(_TOKEN.findall(text)) + "$"
    out: dict[str, float] = {}
    for end, n in automaton.iter(marked):
        word = marked[marked.rfind("^", 0, end - n + 2) + 1 : marked.find("$", end)]
        if word not in out:
            out[word] = weight_of(word, weights)
    return out


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """``docs`` with score, predicted, worst (index of the worst sentence) and offending (those of 0.5 or more)."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES numbers

    @F.pandas_udf("struct<score:double,worst:int,offending:array<int>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        automaton = ahocorasick.Automaton()
        for f in weights:
            automaton.add_word(f, len(f))
        automaton.make_automaton()
        none = np.empty(0, np.int32)
        for texts in batches:
            rows = []
            for text in texts:
                every = sentences(text)
                p = np.full(len(every), 1 / (1 + np.exp(-bias)))
                heavy = heavy_words(text.lower(), automaton, weights) if weights else {}
                if heavy:
                    zs = [bias + sum(heavy[w] for w in sorted(heavy.keys() & set(_TOKEN.findall(s.lower())))) for s in every]
                    p = 1 / (1 + np.exp(-np.clip(zs, -30, 30)))
                whole = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
                rows.append((whole, int(p.argmax()), np.flatnonzero(p >= 0.5).astype(np.int32) if whole >= 0.5 else none))
            yield pd.DataFrame(rows, columns=["score", "worst", "offending"])

    x = fresh("x")
    names = ["score", "predicted", "worst", "offending"]
    return out_of_the_way(docs, *names).withColumn(x, scored(F.coalesce("text", F.lit("")))).withColumns({
        "score": F.col(f"{x}.score"), "predicted": (F.col(f"{x}.score") >= 0.5).cast("int"),
        "worst": F.col(f"{x}.worst"), "offending": F.col(f"{x}.offending"),
    }).drop(x)


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """score() and held_out, whether the row was kept from learning."""
    return score(out_of_the_way(docs, "held_out"), train(docs, labels, max_docs)).withColumn("held_out", held_out(F.col("doc_id")))
