"""What batches keep up to date beside their tables: article counts, distinct sketches, and the mark of an incremental load."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presslake.operators import rollup, sketches
from presslake.plans.batch import BatchConfig, run_batch
from presslake.schemas import FEED, STORED
from presslake.session import staged
from presslake.sources import marks, readers, store

#: Columns of the articles whose distinct values are kept.
DISTINCT = ["domain", "url"]
COUNTED = T.StructType([T.StructField("day", T.DateType()), *[T.StructField(c, T.StringType()) for c in rollup.GROUPS[1:]],
                        *[T.StructField(c, T.LongType()) for c in rollup.COUNTS], T.StructField("batch_id", T.StringType())])
SKETCHED = T.StructType([T.StructField("day", T.DateType()), T.StructField("rows", T.LongType()),
                         *[T.StructField(c, T.BinaryType()) for c in DISTINCT], T.StructField("batch_id", T.StringType())])


def write_upkeep(spark: SparkSession, root: str, config: BatchConfig) -> None:
    """Signed counts and sketches of what batch `config.batch_id` has stored. Doing it again replaces them; the last batch may be done again.

    Of the history only rows are looked at whose address the batch stores; what retention has dropped before is not read.
    """
    since = config.as_of - dt.timedelta(days=config.retention_days)
    rows = readers.read_table(spark, f"{root}/processed", STORED, since=since)
    own = staged(rows.where(F.col("batch_id") == config.batch_id).select("url", "processed_at", "ai_topic_detected", *rollup.GROUPS[1:]))
    old = rows.where(F.col("batch_id") != config.batch_id).join(own.select("url"), "url", "left_semi")
    before = store.latest(old, "url", store.written_order("processed_at")).select(*own.columns)
    named = lambda df: df.withColumn("batch_id", F.lit(config.batch_id))
    store.append_batch(named(rollup.changes(before, own)), f"{root}/article_counts", batch_id=config.batch_id, day="day")
    store.append_batch(named(sketches.day_sketches(own, DISTINCT)), f"{root}/article_sketches", batch_id=config.batch_id, day="day")
    for table in ("article_counts", "article_sketches"):
        store.drop_expired(spark, f"{root}/{table}", config.as_of, config.retention_days)


def article_counts(spark: SparkSession, root: str, as_of: dt.datetime | None = None, days: int = 30) -> DataFrame:
    """Articles by `rollup.GROUPS`, from the kept counts alone; with `as_of`, of the days that retention keeps."""
    rows = readers.read_table(spark, f"{root}/article_counts", COUNTED, since=as_of and as_of - dt.timedelta(days=days))
    return rollup.merged(rows.drop("batch_id"))


def article_sketches(spark: SparkSession, root: str) -> DataFrame:
    """A row per day with a sketch of each column of `DISTINCT`, for `sketches.distinct_between` and `distinct_trailing`.

    A replaced article still counts in the sketches of the day that first had it.
    """
    return sketches.united(readers.read_table(spark, f"{root}/article_sketches", SKETCHED).drop("batch_id"))


def run_kept(spark: SparkSession, feed: DataFrame, pages: DataFrame, root: str, config: BatchConfig, **inputs) -> dict:
    """`run_batch`, and then the counts and sketches of what it stored."""
    counters = run_batch(spark, feed, pages, root, config, **inputs)
    write_upkeep(spark, root, config)
    return counters


def run_landed(spark: SparkSession, landed: str, pages: DataFrame, root: str, config: BatchConfig, schema: T.StructType = FEED,
               column: str = "landed", **inputs) -> dict:
    """A batch of the feed folders landed since the batch before; one that runs again reads the folders that it read before.

    The mark is saved once all is stored, so folders of a failed batch are read by the next one. Each row is read once:
    give a `look_back_hours` that no landing outlasts, or None.
    """
    span = marks.span_of(spark, landed, f"{root}/marks", config.batch_id, column)
    counters = run_kept(spark, marks.read_span(spark, landed, span, schema, column), pages, root, config, **inputs)
    marks.save_mark(spark, f"{root}/marks", config.batch_id, span)
    return counters
