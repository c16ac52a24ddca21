"""Sources that arrive as files, scanned as they come; replays add nothing."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracegrain.operators import findings, parse


def stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """JSON lines (path, source, at) in ``folder`` to findings in ``out``, a Parquet table partitioned by batch.

    A source that comes again within a day is not scanned again; the watermark
    bounds that state.  A batch that is replayed overwrites its own partition.
    """
    rows = spark.readStream.schema("path string, source string, at timestamp").json(folder)
    new = rows.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["path", "source"])

    def scan(batch, batch_id: int) -> None:
        found = findings.dedupe_and_rank(findings.findings(parse.parse(batch)))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = new.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
