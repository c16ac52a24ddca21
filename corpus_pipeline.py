"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept.  run() writes every stage as Parquet to the folder in
``spark.checkpoint.dir`` and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import decontam, mixing, near_dedup, sharding, toxicity
from tracegrain.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a toxicity score of 0.5 or more go.

    The weights are fitted on the labels of the documents at hand.  Null and
    empty texts stay; without usable labels every document stays; repeated rows
    have equal scores.
    """
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class of near duplicates the document with the lowest doc_id stays.

    Equal texts, the empty one among them, are a class.  Rows that repeat a kept
    one in id and text go too.
    """
    kept = near_dedup.near_duplicates(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)
    again = docs.groupBy(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")))).count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold 0.8 or more of a test item's shingles go.

    Null and empty texts hold none and stay, as all do where there are no items;
    rows that repeat one another stay or go together; so do ties at exactly 0.8,
    which go.
    """
    return decontam.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: whole documents, so many that every source's words meet its target.

    The mix takes blocks of words, and so parts of some documents; their parts
    are carried along each source and come out as whole texts.  A source's words
    differ from its target by about one document.  Documents without words, null
    texts among them, stay once.  The null source is a source.  Rows alike in id,
    source and text share their number of copies evenly, one taking what remains;
    documents that tie in size and hash are taken by id.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: eight shards of near equal bytes; adds shard and slot.

    A null text counts one byte; repeated rows get slots next to each other; texts
    that tie in their hash are told apart by id.  All rows stay.
    """
    return sharding.shard_rows(sharding.keyed(docs.select(*COLUMNS)), 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL expresses none of the stages; tests/llm hold the operators against brute force,
#: and the stages against what those give for their input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: its columns, shard and slot."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
