"""Queries of the general training-data problems: dates and packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import dates, packed
from quirework.session import prepare, stored, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, record_id, norm): every date field that states a real date, in one form."""
    prepare(spark)
    values = dates.date_values(table(spark, sf_dir, "books"), table(spark, sf_dir, "exth_headers"))
    return dates.normalise_dates(values, table(spark, sf_dir, "feeds"))


def p1_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, zone_name, ties, aligned, violations, declared, declared_violations): the clock found for each
    feed without looking at any declared zone, how many zones fit as well, and how the declared one fits."""
    prepare(spark)
    feeds = table(spark, sf_dir, "feeds").select("feed", "zone_name", "day_first")
    values = dates.date_values(table(spark, sf_dir, "books"), table(spark, sf_dir, "exth_headers"))
    parsed = stored(dates.parsed_values(values, feeds.withColumn("zone_name", F.lit(None).cast("string"))), "dates")
    judged = stored(dates.judge_zones(parsed), "judged")
    declared = judged.join(feeds.select("feed", "zone_name"), ["feed", "zone_name"]).select("feed", F.col("zone_name").alias("declared"), F.col("violations").alias("declared_violations"))
    return dates.best_zones(judged).join(declared, "feed", "left").select("feed", "zone_name", "ties", "aligned", "violations", "declared", "declared_violations")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, record_id, pos, subject): the values of each record with a packed element."""
    prepare(spark)
    records = packed.subject_records(table(spark, sf_dir, "books"), table(spark, sf_dir, "exth_headers"))
    return packed.unpack(records, table(spark, sf_dir, "subject_terms"))


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p3_found": p3_found}
ORACLE: dict[str, str] = {}
