"""Operator 8: mixing sources to target weights by blocks.

The words of a source, its documents in pseudorandom order, form one stream that
is packed into blocks of ``block`` words; the last may be short.  A source's
share of the mix is a number of slots.  Slot j takes block P(j mod n), n being
the source's blocks and P a keyed Feistel permutation of their indexes, so every
pass over a source uses each block once; the last slot takes no more words than
are still due, which makes the words taken from a source equal its target,
rounded.  Each source's slots are dealt to output shards by one multinomial
draw; given the totals, that is what drawing a source count vector for each
shard comes to.  Slots and blocks are then joined by (source, index).

Targets: the shares of all words by weight, none above ``most`` times its
source's words, the excess shared again by weight until none is above.

Scale: a stream's offsets are sums over (source, bucket) and then inside a
bucket, so no task holds a whole source; slots are made in runs of 4,096; slots
and pieces, which both grow with the words, meet in a merge join.

Edge cases: a null text has size 0, and documents of size 0 are returned with
taken 0; the null source is a source like any other and comes last; equal rows
are documents of their own; an empty table gives no rows.  Columns are chosen by
name, so extra ones don't matter to mix(); mixed_documents() keeps them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, fresh

BUCKETS = 256
RUN = 4096
#: Whole copies are counted in parts of this size.
UNIT = 2**20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.xxhash64(source.isNull(), source, F.lit(8))


def _order_key(text: Column, doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), doc_id)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P(j) for each row: a permutation of 0 .. n-1 that ``key`` names.

    Four Feistel rounds over the next even number of bits; what falls outside
    0 .. n-1 goes round again.
    """
    j, n, key = j.astype(np.uint64), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    half = np.ones(len(n), np.uint64)
    for _ in range(31):
        half += ((np.uint64(1) << (half * np.uint64(2))) < n).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = j.copy()
    left = np.arange(len(j))
    with np.errstate(over="ignore"):
        while len(left):
            h, m, k = half[left], mask[left], key[left]
            a, b = out[left] >> h, out[left] & m
            for r in range(4):
                a, b = b, a ^ (_mix(b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
            out[left] = (a << h) | b
            left = left[out[left] >= n[left]]
    return out.astype(np.int64)


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    In order of the word count at which a source reaches its limit, those at
    their limit are a prefix; the first source that the even share of the rest
    doesn't lift over its limit ends it.  A row a source, in one task.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy("r", "i")
    t = sizes.withColumn("i", F.row_number().over(ordered) - 1).withColumn("w", F.col("i") % 3 + 1)
    t = t.withColumn("r", most * F.col("source_size") / F.col("w"))
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumns({
        "taken_up": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)),
        "w_left": F.sum("w").over(after),
        "total": F.sum("source_size").over(every),
    })
    t = t.withColumn("share", (F.col("total") - F.col("taken_up")) / F.col("w_left"))
    t = t.withColumn("free", F.min(F.when(F.col("share") <= F.col("r"), F.struct("r", "i", "share"))).over(every))
    at_limit = F.col("free").isNull() | (F.struct("r", "i") < F.struct("free.r", "free.i"))
    return t.select(
        "source", "source_size",
        F.when(at_limit, most * F.col("source_size")).otherwise(F.least(F.col("free.share") * F.col("w"), most * F.col("source_size"))).cast("double").alias("target"),
    )


def _slots(shards: int, seed: int, block: int):
    """(source, source_size, target) to runs of slots: (source_key, n, full passes, words, shard, first, count)."""

    def f(batches):
        for pdf in batches:
            rows = []
            for key, size, target in zip(pdf["source_key"], pdf["source_size"], pdf["target"], strict=True):
                n, due = -(-int(size) // block), round(target)
                if not n or not due:
                    continue
                short = int(size) - (n - 1) * block  # words of the last block
                passes, rest = divmod(due, int(size))
                where = int(permuted_inverse(n - 1, n, int(key)))  # the turn of the last block
                more = -(-rest // block)  # without the short block
                if rest and where < more - (rest <= (more - 1) * block):
                    more = max(where + 1, -(-(rest + block - short) // block))
                taken = more * block - (block - short) * (where < more)
                slots = passes * n + more
                at = 0
                for shard, c in enumerate(np.random.default_rng([seed, int(key) & (2**63 - 1)]).multinomial(slots, [1 / shards] * shards)):
                    for first in range(at, at + int(c), RUN):
                        rows.append((key, n, slots - 1 if taken > rest else -1, taken - rest, shard, first, min(RUN, at + int(c) - first)))
                    at += int(c)
                    if len(rows) > 50_000:
                        yield pd.DataFrame(rows, columns=_RUNS)
                        rows = []
            yield pd.DataFrame(rows, columns=_RUNS)

    return f


_RUNS = ["source_key", "n", "last_slot", "too_many", "shard", "first", "slots"]


def permuted_inverse(y: int, n: int, key: int) -> int:
    """The j with permuted(j) == y."""
    half = 1
    while (1 << (2 * half)) < n:
        half += 1
    mask, k, out = (1 << half) - 1, key % 2**64, y
    while True:
        a, b = out >> half, out & mask
        for r in (3, 2, 1, 0):
            x = np.array([(a + k * 0x9E3779B97F4A7C15 + r + 1) % 2**64], np.uint64)
            with np.errstate(over="ignore"):
                a, b = b ^ (int(_mix(x)[0]) & mask), a
        out = (a << half) | b
        if out < n:
            return out


def streams(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, source_key, size, o, at): where each document starts in its source's stream."""
    light = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        _source_key(F.col(source)).alias("source_key"), _order_key(F.col(text), F.col(doc_id)).alias("o"),
    ))
    light = light.withColumn("bucket", F.pmod("o", F.lit(BUCKETS)))
    sums = light.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_at"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = light.withColumn("b", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_key", "bucket"])
    return out.select("doc_id", "source", "source_key", "size", "o", (F.col("b") + F.col("bucket_at")).alias("at"))


def mix(docs: DataFrame, block: int = 256, shards: int = 8, seed: int = 8, most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: doc_id, source, size, source_size, target, taken, at, the
    document's place in its source's stream, source_key, and o, which names its
    text and id.
    pieces: shard, slot, source_key, at, first_word, n_words: what each slot of
    the mix holds, as words of the document at that place.
    """
    docs_at = cut(streams(docs))
    sizes = docs_at.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    sources = cut(targets(sizes).join(sizes.select("source_key", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    runs = sources.select("source_key", "source_size", "target").mapInPandas(
        _slots(shards, seed, block), "source_key long, n long, last_slot long, too_many long, shard int, first long, slots long"
    )
    slots = runs.repartition("source_key", "first").select(
        "source_key", "n", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"), "last_slot", "too_many"
    )

    @F.pandas_udf("long")
    def block_of(j: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(j.to_numpy() % n.to_numpy(), n.to_numpy(), key.to_numpy()))

    slots = slots.select(
        "source_key", "shard", "slot", block_of("slot", "n", "source_key").alias("block"),
        F.when(F.col("slot") == F.col("last_slot"), F.col("too_many")).otherwise(0).alias("cut"),
    )
    b = F.lit(block)
    pieces = docs_at.where("size > 0").select(
        "source_key", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block"),
    )
    whole = sources.select("source_key", "source_size")
    joined = pieces.join(slots.hint("merge"), ["source_key", "block"]).join(whole, "source_key")
    first = F.greatest(F.col("at"), F.col("block") * b)
    # a cut slot gives the first words of its block, which may be a short one
    end = F.least(F.col("at") + F.col("size"), F.least((F.col("block") + 1) * b, F.col("source_size")) - F.col("cut"))
    mixed = joined.select("shard", "slot", "source_key", "at", (first - F.col("at")).alias("first_word"), (end - first).alias("n_words")).where("n_words > 0")
    taken = mixed.groupBy("source_key", "at").agg(F.sum("n_words").alias("taken")).withColumn("some", F.lit(True))
    out = docs_at.withColumn("some", F.col("size") > 0).join(taken, ["source_key", "at", "some"], "left")
    facts = sources.select("source_key", "source_size", "target")
    out = out.join(facts, "source_key").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "at", "source_key", "o"
    )
    return out, mixed


def whole_copies(taken: DataFrame) -> DataFrame:
    """(d, source_key, size, o, n, copies): whole copies of the n rows alike, from the documents of mix().

    Each source's shares taken / size are summed up along its documents by size,
    and a document gets as many copies as the sum passes halves.  The sum of
    copies is then never off by more than a half, at no place of that order, so a
    source's words differ from those taken by about its longest text at most,
    whatever the lengths.  Shares are whole numbers of 1 / UNIT, so that no order
    of summing matters.  As in streams(), sums over (source, bucket) come first;
    a bucket is 1 of 64 parts of the documents whose sizes agree within 9 %.
    """
    alike = taken.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), "source_key", "size", "o")
    rows = alike.agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"))
    share = F.when(F.col("size") > 0, F.expr(f"(taken * {UNIT} + size div 2) div size")).otherwise(F.col("n") * UNIT)
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8)).otherwise(-1)
    rows = cut(rows.select("d", "source_key", "size", "o", "n", share.alias("x"), (level * 64 + F.pmod("o", F.lit(64))).alias("bucket")))
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("x").alias("in_bucket"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_at"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("size", "o", "d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("b", F.sum("x").over(inside)).join(sums, ["source_key", "bucket"])
    end = f"b + bucket_at + {UNIT // 2}"
    return rows.select("d", "source_key", "size", "o", "n", F.expr(f"({end}) div {UNIT} - ({end} - x) div {UNIT}").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as whole copies that meet each source's target; rows without words once.

    Rows that agree in id, source and text are alike to the mix: each gets the
    same number of copies, and one of them what remains.
    """
    times = whole_copies(mix(docs, **options)[0]).where("copies > 0")
    d, source, n, o, x, more = map(fresh, ("d", "s", "n", "o", "x", "more"))
    key = [d, source, n, o]
    times = cut(times.select(
        F.col("d").alias(d), F.col("source_key").alias(source), F.col("size").alias(n), F.col("o").alias(o),
        F.expr("copies div n").cast("int").alias(x), F.expr("copies % n").cast("int").alias(more),
    ))
    rows = docs.withColumns({
        d: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), source: _source_key(F.col("source")), n: n_words(F.col("text")),
        o: _order_key(F.col("text"), F.col("doc_id")),
    })
    out = rows.join(times.where(F.col(x) > 0).drop(more).hint("merge"), key)
    rest = times.where(F.col(more) > 0).drop(x).withColumnRenamed(more, x)
    if not rest.isEmpty():
        out = out.unionByName(rows.join(rest.hint("merge"), key).dropDuplicates(key))
    return out.withColumn(x, F.explode(F.sequence(F.lit(1), F.col(x)))).select(*docs.columns)
