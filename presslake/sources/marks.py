"""Incremental loads: each batch reads the folders landed since the batch before, and a batch that runs again reads its own."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from presslake.sources.readers import path_exists

MARKS = "batch_id string, low string, high string"


class Span(NamedTuple):
    """Landing folders after `low` (None: from the first) up to `high`; nothing if `high` is None."""

    low: str | None
    high: str | None


def landed_folders(spark: SparkSession, path: str, column: str = "landed") -> list[str]:
    """Values of the landing folders below `path`, ascending. They are named so that text order is time order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}=*")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return sorted(names.unescapePathName(e.getPath().getName().split("=", 1)[1]) for e in (fs.globStatus(target) or []))


def _marks(spark: SparkSession, marks: str) -> DataFrame:
    return spark.read.schema(MARKS).parquet(marks) if path_exists(spark, f"{marks}/*") else spark.createDataFrame([], MARKS)


def span_of(spark: SparkSession, path: str, marks: str, batch_id: str, column: str = "landed") -> Span:
    """What batch `batch_id` is to read: the span it was given before, else all folders after the highest mark of the other batches."""
    known = _marks(spark, marks)
    own = known.where(F.col("batch_id") == batch_id).head()
    if own is not None:
        return Span(own["low"], own["high"])
    low = known.agg(F.max("high")).head()[0]
    fresh = [f for f in landed_folders(spark, path, column) if low is None or f > low]
    return Span(low, fresh[-1] if fresh else None)


def read_span(spark: SparkSession, path: str, span: Span, schema, column: str = "landed") -> DataFrame:
    """Rows of the folders in `span`; other folders are neither listed nor read, however many have landed before."""
    landed = [] if span.high is None else landed_folders(spark, path, column)
    asked = [f for f in landed if f <= span.high and (span.low is None or f > span.low)]
    if not asked:
        return spark.createDataFrame([], schema)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folders = [path] if len(asked) == len(landed) else [f"{path}/{column}={names.escapePathName(f)}" for f in asked]
    rows = spark.read.schema(f"{_ddl(schema)}, `{column}` string").option("basePath", path).parquet(*folders).where(F.col(column) <= span.high)
    rows = rows if span.low is None else rows.where(F.col(column) > span.low)
    return rows.drop(column)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def save_mark(spark: SparkSession, marks: str, batch_id: str, span: Span) -> None:
    """Remember what a batch has read, after its rows are stored. Writing it again changes nothing; an empty span leaves no mark."""
    if span.high is not None:
        spark.createDataFrame([(batch_id, span.low, span.high)], MARKS).coalesce(1).write.mode("overwrite").parquet(f"{marks}/of={batch_id}")
