"""Incremental forms: windows over event streams, and progress of an index fed by submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, late: str, size: str, slide: str | None = None, at: str = "ts", key: str = "event_type") -> DataFrame:
    """(key, start, n) by tumbling or sliding windows; rows later than late are dropped with their window."""
    stream = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, late: str, gap: str, at: str = "ts", key: str = "user_id") -> DataFrame:
    stream = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stream.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def unseen(submissions: DataFrame, late: str, key: str = "node_id", at: str = "ts") -> DataFrame:
    """Each key once: a repeated submission within the watermark is dropped."""
    return submissions.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert_latest(submissions: DataFrame, target: str, checkpoint: str, key: str, at: str) -> StreamingQuery:
    """Keeps the latest submission of each key: every batch is a new version of the target folder.

    Versions are written whole before they count, so a batch that is run again does no harm."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("x")).select("x.*")
        if n:
            old = spark.read.parquet(f"{target}/v={n - 1}")
            latest = old.unionByName(latest).groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("x")).select("x.*")
        latest.write.mode("overwrite").parquet(f"{target}/v={n}")

    return submissions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(done, remaining): how many wanted keys have a submission."""
    both = wanted.select(key).distinct().join(done.select(key).distinct().withColumn("d", F.lit(1)), key, "left")
    return both.agg(F.count("d").alias("done"), F.count_if(F.col("d").isNull()).alias("remaining"))
