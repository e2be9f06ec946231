"""Membership filters beside stored tables: which days may hold a key, known without reading the days.

Each batch leaves a Bloom filter of its keys for each day it writes to, as rows (words, block, mask): a key sets BITS bits of one 64-bit word.
Filters of one number of words merge by bitwise or, which is done for the batches of a day; numbers are powers of two, so there are few of
them however many days are kept. A probe meets the words of all days at its place in one row, and only keys that a day may hold are
looked up exactly, in those days. A filter never misses a key that it was given, so nothing is lost.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from presslake.operators.skew import anti_join
from presslake.session import staged
from presslake.sources.readers import MERGED_BATCH, path_exists, period_of, period_start, read_table
from presslake.sources.store import _file_system, append_batch, create, drop_expired, folder_day

#: Keys of a word, and bits that each sets: about one key in a hundred that is not there passes.
KEYS_PER_WORD, BITS = 4, 5
FILTER = T.StructType([T.StructField("words", T.LongType()), T.StructField("block", T.LongType()), T.StructField("mask", T.LongType()),
                       T.StructField("batch_id", T.StringType())])


def filter_path(path: str) -> str:
    return f"{path}__members"


def _mask(key: str) -> Column:
    """The bits of a key within its word."""
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(1, `{key}`), {6 * i}) & 63 AS INT))") for i in range(BITS)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def _block(key: str, words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), words)


def _filters(rows: DataFrame, key: str) -> DataFrame:
    """(day, batch_id, words, block, mask) of the keys of rows with a day and a batch. Null keys are in no filter."""
    keyed = rows.where(F.col(key).isNotNull()).select("day", "batch_id", key)
    # Repeated keys only make the filter larger than it need be.
    sizes = keyed.groupBy("day", "batch_id").agg(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / KEYS_PER_WORD))))).cast("long").alias("words"))
    sized = keyed.join(F.broadcast(sizes), ["day", "batch_id"])
    return sized.groupBy("day", "batch_id", "words", _block(key, F.col("words")).alias("block")).agg(F.bit_or(_mask(key)).alias("mask"))


def _laid_out(spark: SparkSession, path: str) -> str:
    """The period of the table at `path`, which its filters get too: one for each folder of the table."""
    period = period_of(spark, path)
    if period != "day":
        create(spark, filter_path(path), period)
    return period


def write(df: DataFrame, path: str, key: str = "url", day: str = "processed_at", batch_id: str | None = None) -> None:
    """Leave the filters of what `store.append_batch` writes with the same arguments. Write them before the rows: a filter may know too much, never too little."""
    rows = df.select(key, "batch_id", folder_day(day, _laid_out(df.sparkSession, path)).alias("day"))
    if batch_id is None:
        found = _filters(rows, key)
    else:
        found = _filters(rows.withColumn("batch_id", F.lit(batch_id)), key)
    append_batch(found.withColumnRenamed("day", "__day"), filter_path(path), "__day", batch_id=batch_id)


def _folders(spark: SparkSession, path: str) -> set[tuple[str, str]]:
    fs, target = _file_system(spark, f"{path}/day=*/batch_id=*")
    parts = [str(e.getPath()).rsplit("/", 2) for e in (fs.globStatus(target) or [])]
    return {(d.removeprefix("day="), b.removeprefix("batch_id=")) for _, d, b in parts}


def build(spark: SparkSession, path: str, schema: T.StructType, key: str = "url") -> list[str]:
    """Filters for the day folders that have batch folders without one (older tables, merged days); returns the days. Only these are read."""
    _laid_out(spark, path)
    missing = sorted({d for d, b in _folders(spark, path) - _folders(spark, filter_path(path))})
    own = T.StructType([f for f in schema.fields if f.name not in ("day", "batch_id", MERGED_BATCH)])
    for day in missing:
        # Folder by folder as stored, so that every name of a batch folder gets its filter.
        rows = spark.read.schema(T.StructType([*own, T.StructField("batch_id", T.StringType()), T.StructField("day", T.DateType())])).parquet(path)
        found = _filters(rows.where(F.col("day") == F.lit(dt.date.fromisoformat(day))), key)
        append_batch(found.withColumnRenamed("day", "__day"), filter_path(path), "__day")
    return missing


def drop_expired_filters(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 30) -> list[str]:
    return drop_expired(spark, filter_path(path), as_of, days)


def _read(spark: SparkSession, path: str, since: dt.datetime | None) -> DataFrame:
    rows = spark.read.schema(T.StructType([*FILTER.fields, T.StructField("day", T.DateType())])).parquet(filter_path(path))
    return rows if since is None else rows.where(F.col("day") >= F.lit(period_start(since.date(), period_of(spark, path))))


def _sized(keys: DataFrame, key: str, words: list[int]) -> DataFrame:
    """Each key with its word in filters of each size."""
    each = keys.select(key, F.explode(F.array(*[F.lit(w).cast("long") for w in words])).alias("words"))
    return each.select(key, "words", _block(key, F.col("words")).alias("block"), _mask(key).alias("own"))


def maybe_held(keys: DataFrame, path: str, key: str = "url", since: dt.datetime | None = None) -> tuple[DataFrame, list[dt.date]]:
    """The distinct keys that a filter of the table at `path` holds, and the days whose filters hold one of them."""
    spark = keys.sparkSession
    if not path_exists(spark, f"{filter_path(path)}/day=*"):
        return keys.limit(0), []
    filters = _read(spark, path, since)
    # Powers of two: at most one for each bit of a number.
    words = sorted(r["words"] for r in filters.select("words").distinct().collect())
    if not words:
        return keys.limit(0), []
    # The words at one place, merged over the batches of a day: one for each kept day at most.
    places = filters.groupBy("words", "block", "day").agg(F.bit_or("mask").alias("mask")).groupBy("words", "block").agg(
        F.collect_list(F.struct("day", "mask")).alias("places"))
    met = F.transform(F.filter("places", lambda p: p["mask"].bitwiseAND(F.col("own")) == F.col("own")), lambda p: p["day"])
    found = staged(_sized(keys, key, words).join(places, ["words", "block"]).select(key, met.alias("days")).where("size(days) > 0"))
    days = found.select(F.explode("days").alias("day")).distinct().collect()
    return found.select(key).distinct(), sorted(r["day"] for r in days)


def known_keys(rows: DataFrame, path: str, schema: T.StructType, key: str = "url", since: dt.datetime | None = None,
               where: Column | None = None) -> DataFrame:
    """The keys of `rows` that the table at `path` holds, exactly; of the table, only days are read whose filters hold one of them.

    Folders without a filter count as holding every key, so their days are read. `where` is what a stored row must
    satisfy to count. Null keys are not held.
    """
    spark = rows.sparkSession
    keys = rows.select(key).dropna().distinct()
    held, days = maybe_held(keys, path, key, since)
    bare = {dt.date.fromisoformat(d) for d, _ in _folders(spark, path) - _folders(spark, filter_path(path))}
    if since is not None:
        bare = {d for d in bare if d >= period_start(since.date(), period_of(spark, path))}
    asked = keys if bare else held
    days = sorted({*days, *bare})
    if not days:
        return keys.limit(0)
    table = read_table(spark, path, T.StructType([*schema.fields, T.StructField("day", T.DateType())]), since=since)
    table = table.where(F.col("day").isin(days))
    if where is not None:
        table = table.where(where)
    return asked.join(table.select(key).distinct(), key, "left_semi")


def new_rows(rows: DataFrame, path: str, schema: T.StructType, key: str = "url", row_id: str = "ingest_rank", **limits) -> DataFrame:
    """Rows whose key the table at `path` does not hold; rows without a key pass."""
    return anti_join(rows, known_keys(rows, path, schema, key, **limits), [key], [row_id])
