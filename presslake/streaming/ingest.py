"""The same monitoring on a live feed, with Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from presslake.functions.times import parse_time
from presslake.plans.batch import BatchConfig, run_batch
from presslake.schemas import FEED
from presslake.sources.store import latest


def feed_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = FEED,
                max_files: int | None = None) -> DataFrame:
    """Feed files as they land. `max_files` bounds a micro-batch, also when a backlog is worked off."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def with_seen_time(feed: DataFrame) -> DataFrame:
    return feed.withColumn("seen_at", parse_time("seendate"))


def unique_urls(feed: DataFrame, late: str = "2 hours") -> DataFrame:
    """First row per address. State is kept only as long as the watermark allows a repeat to arrive."""
    timed = feed if "seen_at" in feed.columns else with_seen_time(feed)
    return timed.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["url"])


def window_counts(events: DataFrame, time: str = "seen_at", size: str = "1 hour", slide: str | None = None,
                  late: str | None = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Counts per tumbling (or, with `slide`, sliding) window; also works on a batch DataFrame."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return (
        rows.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *(by or []))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "n")
    )


def failure_totals(failures: DataFrame) -> DataFrame:
    """Failures per domain so far; run it in update mode."""
    return failures.groupBy("domain").agg(F.count(F.lit(1)).alias("failures"), F.max("at").alias("last_failure_at"))


def _start(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def write_totals(counts: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep a windowed or keyed count in a parquet table: each trigger adds the rows that it changed; see `read_totals`.

    Every micro-batch writes a folder of its own, so readers never meet a half-written table, a repeated
    micro-batch replaces its own rows, and windows behind the watermark leave the state.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return _start(counts.writeStream.outputMode("update").foreachBatch(add), checkpoint, interval)


def read_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current count of every key in a table kept by `write_totals`."""
    return latest(spark.read.parquet(path), keys, ["version"]).drop("version")


def merge_totals(spark: SparkSession, path: str, keys: list[str]) -> int | None:
    """Fold the versions of a table kept by `write_totals` into the newest of them; returns its number, or None with fewer than two.

    The folded rows are written beside the newest version first and the others go afterwards. If it is cut short, rows stand in two
    versions, of which the newer counts, and it can run again. Run it while the stream is stopped or between two of its triggers.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {int(str(e.getPath()).rsplit("=", 1)[1]): e.getPath() for e in (fs.globStatus(target) or [])}
    if len(held) < 2:
        return None
    newest = max(held)
    old = latest(spark.read.parquet(path).where(F.col("version") < newest), keys, ["version"]).drop("version")
    current = spark.read.parquet(f"{path}/version={newest}").select(*keys)
    old.join(current, keys, "left_anti").write.mode("append").parquet(f"{path}/version={newest}")
    for number, folder in held.items():
        if number != newest:
            fs.delete(folder, True)
    return newest


def progress_rates(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per recent micro-batch of a stream: rows read, rows per second in and through, seconds taken.

    Spark keeps as many as `spark.sql.streaming.numRecentProgressUpdates` says, so this is a bounded report.
    """
    rows = [(p.batchId, p.timestamp, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond,
             p.durationMs.get("triggerExecution", 0) / 1000) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, started_at string, input_rows long, input_per_second double, "
                                       "processed_per_second double, seconds double")


def append_rows(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append finished rows to a parquet table, exactly once."""
    return _start(rows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, interval)


def ingest(feed: DataFrame, pages: Callable[[SparkSession], DataFrame], root: str, config: BatchConfig,
           checkpoint: str, interval: str | None = None, position: str = "position",
           as_of: Callable[[], dt.datetime] | None = None,
           responses: Callable[[SparkSession], DataFrame] | None = None,
           scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
           translator: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> StreamingQuery:
    """Run the whole batch on every micro-batch of a feed stream.

    `interval=None` works off what has landed and stops. The micro-batch number names the batch, so a
    micro-batch that is repeated after a failure replaces its own output. The source gives each row once, so there is no
    look-back: a backlog is stored whole. The time of a micro-batch comes from `as_of`, by default the clock of
    the driver in UTC, never from the rows; rows dated after it are stored as rejected, and retention follows it.
    `pages` and `responses` (landed classifier answers) are read anew for each micro-batch. Rows whose page has not landed
    wait for it in `pending` and are tried again with every later micro-batch that brings rows.
    """
    clock = as_of or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        settings = replace(config, as_of=clock(), batch_id=f"stream-{number:012d}", look_back_hours=None)
        run_batch(spark, batch, pages(spark), root, settings, responses(spark) if responses else None, position, scorer, translator)

    return _start(feed.writeStream.foreachBatch(run), checkpoint, interval)
