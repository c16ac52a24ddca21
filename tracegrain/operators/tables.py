"""Intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a session of one machine (master local or local[n]) gets a
    folder of its own; on a cluster no machine's folder would do, so that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again: no lineage, and its true size as statistics."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of keys for one task, and tasks beyond which each takes more rows.
ROWS, MOST_TASKS = 2_048, 2_000


def spread(keys: DataFrame, least: int = 1) -> DataFrame:
    """``keys`` dealt over as many partitions as their number needs, and ``least`` more but one.

    Keys take a few bytes each, so that one split holds millions of them; the
    sources made of them take about a millisecond each to parse.
    """
    return keys.repartition(min(MOST_TASKS, -(-keys.count() // ROWS) or 1) + least - 1)


class Rounds:
    """The tables of a loop's rounds: each is written once, and read alone or with all before it."""

    def __init__(self, first: DataFrame):
        self.paths: list[str] = []
        self.base = f"{shared_folder(first.sparkSession)}/rounds-{uuid.uuid4().hex}"
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.base}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        self.last = df.sparkSession.read.schema(df.schema).parquet(self.paths[-1])
        return self.last

    def all(self) -> DataFrame:
        return self.last.sparkSession.read.schema(self.last.schema).parquet(*self.paths)
