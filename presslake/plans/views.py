"""The stored tables as SQL views, under the names and columns that monitoring SQL expects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presslake.operators.analytics import daily_statistics
from presslake.schemas import RUN_EVENT, STORED, STORED_REJECTED, conform
from presslake.sources import keyed, readers, store

VIEWS = ["processed_articles", "rejected_articles", "pipeline_runs", "daily_statistics"]


def current_rows(spark: SparkSession, path: str, schema: T.StructType, time: str, since: dt.datetime | None = None) -> DataFrame:
    """The last written row per address; without a shuffle where the table is bucketed by it."""
    if keyed.layout(spark, path) is not None:
        return conform(keyed.current(spark, path, time, since), schema)
    return store.latest(readers.read_table(spark, path, schema, since=since), "url", store.written_order(time))


def stored_tables(spark: SparkSession, root: str, as_of: dt.datetime | None = None, days: int = 30) -> dict[str, DataFrame]:
    """Current state of the tables below `root`: the last written row per address and per run.

    With `as_of`, articles and runs older than `days` are left out to the second, and day folders of articles before that
    are not read.
    """
    since = as_of - dt.timedelta(days=days) if as_of else None
    articles = current_rows(spark, f"{root}/processed", STORED, "processed_at", since)
    rejected = current_rows(spark, f"{root}/rejected", STORED_REJECTED, "rejected_at")
    runs = store.runs_current(readers.read_table(spark, f"{root}/runs", RUN_EVENT))
    if as_of:
        articles = store.retained(articles, as_of, days)
        runs = store.retained(runs, as_of, days, "started_at")
    return {
        "processed_articles": articles,
        "rejected_articles": rejected,
        "pipeline_runs": runs.select(
            F.col("run_id").alias("id"), F.col("started_at").alias("run_started_at"),
            F.col("completed_at").alias("run_completed_at"), F.col("fetched").alias("articles_fetched"),
            F.col("validated").alias("articles_processed"), F.col("stored").alias("articles_stored"), "ai_topic_count",
            F.col("seconds").alias("processing_time_seconds"), "status", F.col("error").alias("error_message"),
        ),
        "daily_statistics": daily_statistics(articles, runs),
    }


def register_views(spark: SparkSession, root: str, as_of: dt.datetime | None = None, days: int = 30) -> None:
    for name, table in stored_tables(spark, root, as_of, days).items():
        table.createOrReplaceTempView(name)
