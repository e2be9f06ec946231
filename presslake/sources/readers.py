"""Readers for landed feeds, pages, stored tables and files of the older JSON layout."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presslake.schemas import COLUMN_DEFAULTS, FEED, PAGE, SUMMARY_CACHE, conform


#: Name of folders that hold the rows of many batches of a day, and the column that keeps a row's own batch id in them.
MERGED = "__merged-"
MERGED_BATCH = "merged_batch_id"


#: Says how a table is laid out; a table without it has a folder for each day.
LAYOUT = "_layout.json"
#: What a day folder of a table may hold; it is named by the first day.
PERIODS = ("day", "month", "year", "decade")


def layout(spark: SparkSession, path: str) -> dict | None:
    """How the table at `path` is laid out, if it says so."""
    if not path_exists(spark, f"{path}/{LAYOUT}"):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def period_of(spark: SparkSession, path: str) -> str:
    return (layout(spark, path) or {}).get("period", "day")


def period_start(day: dt.date, period: str) -> dt.date:
    """The name of the day folder that holds `day`."""
    if period == "decade":
        return dt.date(day.year // 10 * 10, 1, 1)
    return day.replace(month=1, day=1) if period == "year" else day.replace(day=1) if period == "month" else day


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches `path`, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_feed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return conform(spark.read.format(fmt).schema(FEED).load(path), FEED, {"language": "en"})


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", since: dt.datetime | None = None,
               until: dt.datetime | None = None) -> DataFrame:
    """Landed pages. With bounds the pages lie in folders `landed=YYYY-MM-DD`, and only those of days from `since` to `until` are read.

    Give a batch the days in which its candidates can have landed: its look-back, or the retention where rows wait for their page.
    """
    if since is None and until is None:
        return spark.read.format(fmt).schema(PAGE).load(path)
    rows = spark.read.format(fmt).schema(T.StructType([*PAGE.fields, T.StructField("landed", T.DateType())])).load(path)
    if since is not None:
        rows = rows.where(F.col("landed") >= F.lit(since.date()))
    if until is not None:
        rows = rows.where(F.col("landed") <= F.lit(until.date()))
    return rows.drop("landed")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages landed as one file each; the file path stands in for the address."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               since: dt.datetime | None = None) -> DataFrame:
    """A stored table in today's schema; a table that was never written is empty.

    The schema is given to the reader, so columns an old file lacks are null and partition values such as
    `batch_id=007` stay text. `since` prunes the day folders that lie wholly before it; rows of its own day (month, year) all stay.
    Rows of merged folders (see `store.compact`) come with the batch id that they were written under.
    """
    if not path_exists(spark, f"{path}/*"):
        return spark.createDataFrame([], schema)
    merged = path_exists(spark, f"{path}/day=*/batch_id={MERGED}*")
    added = [T.StructField("day", T.DateType())] * (merged or since is not None) + [T.StructField(MERGED_BATCH, T.StringType())] * merged
    rows = spark.read.format(fmt).schema(T.StructType([*schema.fields, *added])).load(path)
    if since is not None:
        rows = rows.where(F.col("day") >= F.lit(period_start(since.date(), period_of(spark, path))))
    rows = conform(valid_batches(rows, path) if merged else rows, schema)
    return rows.fillna({k: v for k, v in COLUMN_DEFAULTS.items() if k in rows.columns})


def batch_folders(spark: SparkSession, path: str, day: str = "*") -> dict[str, dict[str, bool]]:
    """Per day that has merged folders (or the given one): its batch folders, and whether they were written whole."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    of_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = of_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    holders = fs.globStatus(of_path(f"{path}/day={day}/batch_id={MERGED if day == '*' else ''}*")) or []
    found: dict[str, dict[str, bool]] = {}
    for folder in {str(e.getPath().getParent()) for e in holders}:
        entries = found.setdefault(folder.rsplit("day=", 1)[1], {})
        for e in fs.listStatus(of_path(folder)):
            name = names.unescapePathName(e.getPath().getName().removeprefix("batch_id="))
            entries[name] = not name.startswith(MERGED) or fs.exists(of_path(f"{e.getPath()}/_SUCCESS"))
    return found


def valid_batches(rows: DataFrame, path: str) -> DataFrame:
    """`rows` of a table with merged folders, each row once and under its own batch id.

    Of the merged folders of a day the newest whole one counts, and a batch that still (or again) has a folder of its own is
    read from there. Both lists of what to skip are empty unless a merge was cut short or an old batch ran again.
    """
    stale, replaced = [], []
    for day, entries in batch_folders(rows.sparkSession, path).items():
        whole = [n for n, done in entries.items() if n.startswith(MERGED) and done]
        stale += [f"{day}/{n}" for n in entries if n.startswith(MERGED) and n != max(whole, default=None)]
        replaced += [f"{day}/{n}" for n in entries if not n.startswith(MERGED)]
    place = lambda name: F.concat_ws("/", F.col("day").cast("string"), F.col(name))
    if stale:
        rows = rows.where(~place("batch_id").isin(stale))
    if replaced:
        rows = rows.where(F.col(MERGED_BATCH).isNull() | ~place(MERGED_BATCH).isin(replaced))
    return rows.withColumn("batch_id", F.coalesce(MERGED_BATCH, "batch_id"))


def read_summary_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """`(cache_key, summary)` from JSON object files; a missing or unreadable file gives no rows.

    Older caches are one indented object per file. `lines=True` reads one object per line, which splits.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], SUMMARY_CACHE)
    pairs = F.from_json("value", "map<string,string>")
    return (
        spark.read.text(path, wholetext=not lines)
        .select(F.explode(pairs).alias("cache_key", "summary"))
    )


def read_batch_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Batch files: one indented JSON array each, or with `lines` one object per line, as batches write them now."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def latest_batch_time(spark: SparkSession, path: str) -> DataFrame:
    """When the newest batch file below `path` was written; one row, null without files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return files.load(path).agg(F.max("modificationTime").alias("last_update"))
