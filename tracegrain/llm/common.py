"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a batch of rows that goes to Python may hold, in place of Spark's default.
BATCH_BYTES = 4_000_000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A word: the longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table, and read that: rows without lineage.

    The table lies in the folder that ``spark.checkpoint.dir`` names, which every
    executor shares, so a lost executor costs no recomputation.  Unlike a
    checkpoint, a table has its true size as statistics; those that a checkpoint
    keeps are products over all joins before, and a loop's grow without bound.
    options: more options of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


#: Options for cut(), by which a task that writes to a local folder starts two processes, not
#: three.  Without Hadoop's native library, its local file systems run chmod for each folder
#: and file, and the one with checksums again for each checksum's file; this is the other one.
#: A process that starts has its parent's whole memory for an instant, and so an executor
#: counts twice.  Other file systems than local ones are as before.
NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def forget(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more: all that came of them has been cut since.

    Spark deletes the shuffle files of a finished job once the driver's garbage is
    collected, which a large heap puts off; that is asked for here as well.
    """
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._table)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on gives Python rows in batches of BATCH_BYTES.

    A task's Python process holds a batch several times over, as Arrow data and as
    objects; of Spark's default, 64 MB, two processes beside an executor's heap fill
    it.  Where the session says otherwise than that default, it stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES, "67108864b") == "67108864b":
        conf.set(_BYTES, str(BATCH_BYTES))
    return df


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def out_of_the_way(df: DataFrame, *added: str) -> DataFrame:
    """``df`` with columns that are named like added ones renamed: _in is appended until the name is free."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in added}
    for c in df.columns:
        if c.lower() in {a.lower() for a in added}:
            name = c + "_in"
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
            df = df.withColumnRenamed(c, name)
    return df


def words(text: str) -> list[str]:
    """The words of ``text``: what lies between runs of ASCII white space."""
    if text.isascii():
        # str.split() also splits at 0x1C-0x1F, which WORD keeps
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    return _WORDS(text)


_WORDS = re.compile(WORD).findall


#: A fixed random number for each byte value, and the base of the polynomial hash of a word's bytes.
_OF_BYTE = np.random.default_rng(0x5EED).integers(0, 2**64, 256, np.uint64)
_BASE, _BACK = np.uint64(0xA24BAED4963EE407), np.uint64(pow(0xA24BAED4963EE407, -1, 2**64))
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Powers are kept for texts of so many bytes; longer ones get their own.
_KEPT = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


with np.errstate(over="ignore"):
    _UP, _DOWN = _powers(_BASE, _KEPT), _powers(_BACK, _KEPT)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of words(text), the same in every process.

    A polynomial over random numbers for the bytes, taken from prefix sums of the
    whole text, so there is no work in Python for a word and nothing to remember.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    if not space[-1]:
        edges = np.concatenate([edges, [n]])
    start, end = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        up, down = (_UP[:n], _DOWN) if n <= _KEPT else (_powers(_BASE, n), _powers(_BACK, n))
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_OF_BYTE[raw] * up)])
        x = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M1
        x = (x ^ (x >> np.uint64(32))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))
