"""Tables stored by a hash of their key: the last row of each key is found bucket by bucket, without a shuffle.

The layout is that of `store` (day=…/batch_id=…), and each folder holds a file per bucket. A batch appends delta files to the buckets; a
merge folds base and deltas of each bucket into a new base. Whatever reads the plain layout reads these
folders too. How a folder is bucketed is written beside it, so that every session finds it again.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presslake.schemas import COLUMN_DEFAULTS, conform
from presslake.sources import readers
from presslake.sources.readers import period_start
from presslake.sources.store import _drop_batch, _file_system, folder_day, latest, write_layout, written_order

#: Batch ids of merged folders: what is left of all batches up to the merge.
BASE = "__base-"


def layout(spark: SparkSession, path: str) -> dict | None:
    """By which column, in how many buckets, in which columns and in which periods the table at `path` is stored; None if it has no buckets."""
    said = readers.layout(spark, path)
    return said if said and "buckets" in said else None


def create(spark: SparkSession, path: str, schema: T.StructType, key: str = "url", buckets: int = 64,
           period: str = "day") -> None:
    """Lay out an empty table of `schema`, which has a batch_id, at `path`; a table that is there keeps its layout.

    `buckets` is for good: choose it so that a bucket of all kept days is a task's worth of rows. So is `period`, see `store.create`.
    """
    if layout(spark, path) is not None:
        return
    if readers.layout(spark, path) is not None:
        period = readers.period_of(spark, path)
    fields = [f for f in schema.fields if f.name not in ("day", "batch_id")]
    write_layout(spark, path, {"key": key, "buckets": buckets, "schema": T.StructType(fields).jsonValue(), "period": period})


def _registered(spark: SparkSession, path: str, synced: bool = True) -> str:
    """The catalogue's name of the table at `path` in this session, with the folders that are there now.

    Without `synced` the folders are not looked for: a write replaces its own and adds them to the catalogue whatever it lists.
    """
    said = layout(spark, path)
    name = f"keyed_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        fields = T.StructType.fromJson(said["schema"]).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}, day DATE, batch_id STRING) USING parquet LOCATION '{path}' "
                  f"PARTITIONED BY (day, batch_id) CLUSTERED BY (`{said['key']}`) INTO {said['buckets']} BUCKETS")
    if synced:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    return name


def append(df: DataFrame, path: str, day: str = "processed_at", batch_id: str | None = None) -> None:
    """Add the rows of batches as delta files for each day and bucket; earlier output of the same batch goes.

    Given `batch_id`, all earlier output of that batch goes first, also on days that it no longer has. Rows are dealt by the file
    they go to, over as many tasks as the rows need, so few buckets do not bound the tasks that write.
    """
    spark = df.sparkSession
    said = layout(spark, path)
    if batch_id is not None:
        _drop_batch(spark, path, batch_id, "day=*/")
    name = _registered(spark, path, synced=False)
    fields = T.StructType.fromJson(said["schema"])
    rows = conform(df.withColumn("day", folder_day(day, said.get("period", "day"))), T.StructType([*fields.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.StringType())]))
    # The hash that places buckets: a bucket's rows of a day are one file, or one for each advisory partition size.
    bucket = F.pmod(F.hash(said["key"]), F.lit(said["buckets"]))
    _insert(rows.withColumn("__bucket", bucket).hint("rebalance", "day", "batch_id", "__bucket").drop("__bucket"), name)


def _insert(rows: DataFrame, name: str) -> None:
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read(spark: SparkSession, path: str, since: dt.datetime | None = None) -> DataFrame:
    """All rows, base and deltas, with `day` (of the folder) and `batch_id`; day folders wholly before `since` are not read."""
    rows = spark.table(_registered(spark, path))
    if since is not None:
        rows = rows.where(F.col("day") >= F.lit(period_start(since.date(), readers.period_of(spark, path))))
    return rows.fillna({k: v for k, v in COLUMN_DEFAULTS.items() if k in rows.columns})


def current(spark: SparkSession, path: str, time: str = "processed_at", since: dt.datetime | None = None) -> DataFrame:
    """The last written row of each key, found within each bucket: base rows come before the deltas of their time."""
    rows = read(spark, path, since)
    base = F.when(F.col("batch_id").startswith(BASE), 0).otherwise(1)
    return latest(rows, layout(spark, path)["key"], [F.col(time), base, *written_order()]).drop("day")


def merge(spark: SparkSession, path: str, time: str = "processed_at") -> str | None:
    """Fold base and deltas into a new base, bucket by bucket; returns its batch id, or None if there is nothing to fold.

    The new base is written first, under a later number, and the folders that it holds go afterwards. A merge that is cut short leaves rows
    twice, of which readers take one, and runs again. Run it while no batch is being written. Batches that ran before
    it cannot be taken back by their id.
    """
    fs, root = _file_system(spark, path)
    held = [str(e.getPath()) for e in (fs.globStatus(_file_system(spark, f"{path}/day=*/batch_id=*")[1]) or [])]
    names = {p.rsplit("batch_id=", 1)[1] for p in held}
    if len(names) < 2 and all(n.startswith(BASE) for n in names):
        return None
    number = 1 + max([int(n.removeprefix(BASE)) for n in names if n.startswith(BASE)], default=0)
    batch_id = f"{BASE}{number:09d}"
    rows = current(spark, path, time).withColumn("day", folder_day(time, readers.period_of(spark, path))).withColumn("batch_id", F.lit(batch_id))
    name = _registered(spark, path, synced=False)
    _insert(rows.select(*spark.table(name).columns), name)
    for folder in held:
        fs.delete(_file_system(spark, folder)[1], True)
    return batch_id
