"""Lists with an index of positions: ranges of the newest-first order with their row counts, so any page is a jump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslake.operators.browse import newest_first


def _order() -> list[Column]:
    return [F.desc("processed_at"), F.asc("url")]


def write_index(df: DataFrame, path: str, ranges: int) -> None:
    """Write a list in newest-first order as `ranges` folders of neighbouring rows, and how many rows each holds.

    The counts are one row for each range. Choose `ranges` so that a range is a task's worth of rows.
    """
    placed = df.repartitionByRange(ranges, *_order()).withColumn("range", F.spark_partition_id())
    placed.sortWithinPartitions(*_order()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    kept = df.sparkSession.read.parquet(f"{path}/rows")
    kept.groupBy("range").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, page: int = 1, size: int = 10) -> DataFrame:
    """Page `page` of the list, as `browse_page` of all its rows; only ranges that hold rows of the page are read."""
    rows = spark.read.parquet(f"{path}/rows")
    first, before, chosen, skip = (page - 1) * size, 0, [], 0
    for r in spark.read.parquet(f"{path}/counts").orderBy("range").collect():
        if before < first + size and before + r["n"] > first:
            skip = first - before if not chosen else skip
            chosen.append(r["range"])
        before += r["n"]
    held = rows.where(F.col("range").isin(chosen)) if chosen else rows.limit(0)
    return newest_first(held.drop("range")).offset(max(skip, 0)).limit(size)


def page_numbers(spark: SparkSession, path: str, size: int = 10) -> DataFrame:
    """One row: rows and pages of the list, from the counts alone."""
    return spark.read.parquet(f"{path}/counts").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).withColumn("pages", F.ceil(F.col("rows") / size))
