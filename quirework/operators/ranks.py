"""A number for every row of a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import stored


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Adds a row number from 0 by the order, which has to tell all rows apart.

    Rows are cut into ranges and numbered in each; how many come before a range is the sum of
    the counts of those below it, of which there is one row a range."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(before, "__part").withColumn(name, own + F.col("__before")).drop("__part", "__before")


def _ranged(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """rows cut into ranges of group and order, with the range's number: a group of most rows is in many ranges."""
    return stored(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def running_sum(rows: DataFrame, group: str, *order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of the values up to each row of its group, itself included.

    Each range sums its own rows; the sums of the ranges before, a row per range and group, are
    added. order has to tell the rows of a group apart. Groups of null are one group."""
    ranged = _ranged(rows, group, order)
    sums = ranged.groupBy("__part", F.col(group).alias("__g")).agg(F.sum(value).alias("__s"))
    before = sums.select("__part", "__g", (F.sum("__s").over(Window.partitionBy("__g").orderBy("__part")) - F.col("__s")).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = ranged.alias("r").join(before.alias("b"), (F.col("r.__part") == F.col("b.__part")) & F.col(f"r.{group}").eqNullSafe(F.col("b.__g")))
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("r.__part").alias("__part"), "__before").withColumn(name, own + F.coalesce("__before", F.lit(0))).drop("__part", "__before")


def last_value(rows: DataFrame, group: str, *order: str, value: str, name: str) -> DataFrame:
    """Adds the last value that isn't null up to each row of its group, by ranges as running_sum."""
    ranged = _ranged(rows, group, order)
    at = F.struct(*order)
    lasts = ranged.where(F.col(value).isNotNull()).groupBy("__part", F.col(group).alias("__g")).agg(F.max_by(value, at).alias("__v"))
    there = ranged.select("__part", F.col(group).alias("__g")).distinct()
    every = there.join(lasts.withColumnsRenamed({"__g": "__h", "__part": "__p"}), F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p")), "left").select("__part", "__g", "__v")
    before = every.select("__part", "__g", F.last("__v", ignorenulls=True).over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = ranged.alias("r").join(before.alias("b"), (F.col("r.__part") == F.col("b.__part")) & F.col(f"r.{group}").eqNullSafe(F.col("b.__g")))
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("r.__part").alias("__part"), "__before").withColumn(name, F.coalesce(own, "__before")).drop("__part", "__before")
