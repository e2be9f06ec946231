"""Stored tables and batch files.

Tables are append-only parquet, partitioned by day and batch. An "upsert" appends, and readers take the
latest row of a key, so a batch never rewrites what is already stored. Writing a batch again under its id replaces
exactly its own partitions, which makes a re-run after a failure harmless. Retention drops whole days. A table whose rows
spread over very many days may be created with a folder for each month, year or decade instead; what is said of days holds for these.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from presslake.functions.times import instant
from presslake.schemas import RUN_EVENT
from presslake.sources.readers import (
    LAYOUT, MERGED, MERGED_BATCH, PERIODS, batch_folders, layout, path_exists, period_of, period_start, read_table,
)


#: Stored bytes for which a merged day gets a file of its own.
FILE_BYTES = 256 << 20


def written_order(time: str | None = None) -> list[Column]:
    """When a row was written: by its time, then by batch id, of which a longer one is later (`b10` after `b9`)."""
    return [*([F.col(time)] if time else []), F.length("batch_id"), F.col("batch_id")]


def latest(df: DataFrame, key: str | list[str], order: list[str | Column]) -> DataFrame:
    """The last written row per key. One shuffle, and copies combine before it."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "url", order: list[str | Column] | None = None) -> DataFrame:
    """Stored and incoming rows, the last written row per key; without `order` by batch id."""
    return latest(stored.unionByName(incoming, allowMissingColumns=True), key, order or written_order())


def retained(df: DataFrame, as_of: dt.datetime, days: int = 30, column: str = "processed_at") -> DataFrame:
    """Rows not older than `days` before `as_of`."""
    return df.filter(F.col(column) >= instant(as_of - dt.timedelta(days=days)))


def _drop_batch(spark: SparkSession, path: str, batch_id: str, levels: str = "") -> None:
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch_id)
    fs, target = _file_system(spark, f"{path}/{levels}batch_id={name}")
    for entry in fs.globStatus(target) or []:
        fs.delete(entry.getPath(), True)
    # Rows of the batch in merged folders are outdated from now on, which a folder of its own says, even an empty one.
    for folder in (fs.globStatus(_file_system(spark, f"{path}/{levels}batch_id={MERGED}*")[1]) or []) if levels else []:
        fs.create(_file_system(spark, f"{folder.getPath().getParent()}/batch_id={name}/_replaced")[1], True).close()


def write_layout(spark: SparkSession, path: str, said: dict) -> None:
    if said["period"] not in PERIODS:
        raise ValueError(f"period {said['period']!r} is none of {PERIODS}")
    fs, target = _file_system(spark, f"{path}/{LAYOUT}")
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()


def create(spark: SparkSession, path: str, period: str = "day") -> None:
    """Lay out an empty table with a folder for each `period`; a table that is there keeps its layout.

    Every folder costs several file operations of the driver, so choose the period by the days that a write brings: `day` for
    batches of a day or a few, `year` for rows of many years, `decade` where a year has few. Without this call a table has a folder for each day.
    """
    if layout(spark, path) is None and not path_exists(spark, f"{path}/*"):
        write_layout(spark, path, {"period": period})


def folder_day(time: str | Column, period: str) -> Column:
    """The day folder of a row."""
    if period == "decade":
        return F.make_date(F.floor(F.year(time) / 10).cast("int") * 10, F.lit(1), F.lit(1))
    return F.to_date(time) if period == "day" else F.trunc(F.to_date(time), period)


def append_batch(df: DataFrame, path: str, day: str = "processed_at", files_per_partition: int | None = None,
                 batch_id: str | None = None) -> None:
    """Write the rows of a batch below `day=…/batch_id=…`, replacing earlier output of the same batch.

    Given `batch_id`, all earlier output of that batch goes first, also on days that it no longer has; without
    it only the partitions that are written anew are replaced. Rows are dealt by folder, so a folder gets a file for each
    advisory partition size of its rows, however many tasks bring them.
    """
    if batch_id is not None:
        _drop_batch(df.sparkSession, path, batch_id, "day=*/")
    out = df.withColumn("day", folder_day(day, period_of(df.sparkSession, path)))
    out = out.repartition(files_per_partition) if files_per_partition else out.hint("rebalance", "day", "batch_id")
    (
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch_id").parquet(path)
    )


def write_batch_json(df: DataFrame, path: str, batch_id: str | None = None) -> None:
    """JSON lines below `batch_id=…`; times are ISO text and non-ASCII text stays as it is.

    Given `batch_id`, earlier output of that batch goes first, also if it now has no rows.
    """
    if batch_id is not None:
        _drop_batch(df.sparkSession, path, batch_id)
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
        .partitionBy("batch_id").json(path)
    )


def batch_manifest(valid: DataFrame, rejected: DataFrame, written_at: Column, base_path: str = "") -> DataFrame:
    """One row per batch and file type: how many rows were to be written, where, and when.

    A write stores all rows or fails the batch, so there is no failed row to list: `failed_articles` is empty.
    """
    none = F.array().cast("array<struct<index:bigint,title:string,error:string>>")
    names = lambda kind: F.concat(F.lit(f"{base_path}{kind}/batch_id="), F.col("batch_id"))
    kinds = [("valid_articles", "articles_json", valid), ("rejected_articles", "rejected_json", rejected)]
    first, second = (
        df.select("batch_id", F.lit(file_type).alias("file_type"), names(folder).alias("filename"))
        for file_type, folder, df in kinds
    )
    return (
        first.unionByName(second).groupBy("batch_id", "file_type", "filename")
        .agg(F.count(F.lit(1)).alias("total_articles"))
        .select(
            "batch_id", "file_type", "filename", "total_articles", F.col("total_articles").alias("stored_count"),
            F.lit(0).cast("bigint").alias("failed_count"), none.alias("failed_articles"), written_at.alias("written_at"),
        )
    )


def run_event(spark: SparkSession, run_id: str, at: dt.datetime, status: str, counters: dict | None = None,
              seconds: float | None = None, error: str | None = None) -> DataFrame:
    """One row for the run log: `running` at the start, `completed` or `failed` at the end."""
    c = counters or {}
    counts = [int(c.get(k, 0)) for k in ("fetched", "validated", "stored", "rejected", "ai_topic_count")]
    row = (run_id, None, status, *counts, seconds, error)
    return spark.createDataFrame([row], RUN_EVENT).withColumn("at", instant(at))


def append_run_event(event: DataFrame, path: str) -> None:
    """Append to the run log; the same run and status replace their earlier row."""
    append_batch(event.withColumn("batch_id", F.concat("run_id", F.lit("-"), "status")), path, "at")


def runs_current(events: DataFrame) -> DataFrame:
    """State of every run: its start, its end if it ended, and the values of its latest event."""
    values = ["fetched", "validated", "stored", "rejected", "ai_topic_count", "seconds", "error", "status"]
    started = F.min(F.when(F.col("status") == "running", F.col("at")))
    ended = F.max(F.when(F.col("status") != "running", F.col("at")))
    order = F.struct("at", F.col("status") != "running", "status")
    return (
        events.groupBy("run_id")
        .agg(started.alias("started_at"), ended.alias("completed_at"),
             F.max_by(F.struct(*values), order).alias("__last"))
        .select(
            "run_id", "started_at",
            F.when(F.col("__last.status") != "running", F.col("completed_at")).alias("completed_at"),
            *[F.col(f"__last.{v}").alias(v) for v in values],
        )
    )


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_expired(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 30) -> list[str]:
    """Delete the day partitions that lie wholly before the retention limit; returns their names.

    Rows of the limit day (month, year) itself are left to `retained`, which batches and views apply.
    """
    if not path_exists(spark, path):
        return []
    limit = period_start((as_of - dt.timedelta(days=days)).date(), period_of(spark, path))
    fs, root = _file_system(spark, path)
    dropped = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("day=") and name[4:] < limit.isoformat():
            fs.delete(entry.getPath(), True)
            dropped.append(name)
    return sorted(dropped)


def compact(spark: SparkSession, path: str, schema: T.StructType, before: dt.date, files: int | None = None) -> list[str]:
    """Merge the batch folders of every day before `before` into one folder per day; returns the days.

    Every row stays, under its batch id. The merged folder is written first and the folders that it covers go afterwards;
    readers skip whichever of the two is not needed, so a merge may be cut short at any point and run again. Run it
    when no batch is being written for those days. `files` is the number of files per day; without it one for each FILE_BYTES of the day.
    """
    fs, root = _file_system(spark, path)
    if not path_exists(spark, path):
        return []
    before = period_start(before, period_of(spark, path))
    own = [f for f in schema.fields if f.name not in ("batch_id", "day")]
    placed = T.StructType([*own, T.StructField("batch_id", T.StringType()), T.StructField("day", T.DateType())])
    days = sorted(n[4:] for n in (e.getPath().getName() for e in fs.listStatus(root)) if n.startswith("day=") and n[4:] < before.isoformat())
    done = []
    for day in days:
        covered = batch_folders(spark, path, day).get(day, {})
        if len(covered) < 2:
            continue
        start = dt.datetime.fromisoformat(day)
        rows = read_table(spark, path, placed, since=start)
        rows = rows.where(F.col("day") == F.lit(start.date())).withColumnRenamed("batch_id", MERGED_BATCH).drop("day")
        number = 1 + max([int(n.removeprefix(MERGED)) for n in covered if n.startswith(MERGED)], default=0)
        size = fs.getContentSummary(_file_system(spark, f"{path}/day={day}")[1]).getLength()
        rows.repartition(files or max(1, -(-size // FILE_BYTES))).write.mode("overwrite").parquet(f"{path}/day={day}/batch_id={MERGED}{number:09d}")
        names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for name in covered:
            fs.delete(_file_system(spark, f"{path}/day={day}/batch_id={names.escapePathName(name)}")[1], True)
        done.append(day)
    return done


def clear_all(spark: SparkSession, paths: list[str]) -> None:
    """Remove all data below the given table folders, with their layout, and make sure that nothing is left."""
    for path in paths:
        fs, target = _file_system(spark, path)
        fs.delete(target, True)
    remaining = [p for p in paths if path_exists(spark, f"{p}/*")]
    if remaining:
        raise RuntimeError(f"not cleared: {remaining}")
