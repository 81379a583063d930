"""Structured Streaming around the batch operators.

Late data: counts and duplicate suppression keep state up to ``watermark`` behind the latest
event time; what comes later is dropped from counts, and still lands in the batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocatio.operators.ingest import prepared
from vocatio.operators.tables import absent

LANDED = "source_id string, url string, fetched_at timestamp, payload string"


def landed_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of landed JSON-lines files (``LANDED``)."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).json(path)


def without_repeats(landed: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A payload of a source and URL once within the watermark."""
    hashed = landed.withColumn("sha256", F.sha2("payload", 256)).withWatermark("fetched_at", watermark)
    return hashed.dropDuplicatesWithinWatermark(["source_id", "url", "sha256"])


def running_counts(events: DataFrame, time: str, by: str, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Rows per window and ``by``; of a stream in update or append mode, of a table at once."""
    w = F.window(time, window)
    return events.withWatermark(time, watermark).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def clean_postings(landed: DataFrame) -> DataFrame:
    """Parsed, redacted and located records; stateless, so the same for streams and tables."""
    return prepared(landed)


LANDED_KEYS = ["part", "source_id", "url", "sha256"]


def with_parts(landed: DataFrame) -> DataFrame:
    """Landed rows with the hash of their payload and the part of the table that they belong to: one of
    256, by a hash of all their keys, so that no source and no page fills one."""
    rows = landed.withColumn("sha256", F.sha2("payload", 256))
    return rows.withColumn("part", F.substring(F.sha2(F.concat_ws("\n", "source_id", "url", "sha256"), 256), 1, 2))


def touched(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of the parts of a landed table that ``rows`` belong to; the other parts' files stay closed."""
    parts = [r.part for r in rows.select("part").distinct().collect()]  # 256 at most
    return table.filter(F.col("part").isin(parts)).select(*LANDED_KEYS)


def start_landing(landed: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append new documents to the Parquet table at ``table``, which is partitioned by ``part``.  A
    batch reads the parts that it touches alone.  One that is run again after a failure finds its
    rows there and adds nothing."""

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = with_parts(batch)
        rows.limit(0).write.mode("append").partitionBy("part").parquet(table)  # the table exists from here on
        there = touched(spark.read.schema(rows.schema).parquet(table), rows)
        new = absent(there, rows, LANDED_KEYS)
        new.repartition("part").write.mode("append").partitionBy("part").parquet(table)

    return landed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
