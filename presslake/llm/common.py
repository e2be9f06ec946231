"""Column expressions and distributed helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.session import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII digits, lower-case ASCII letters and anything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; letters beyond ASCII stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, pattern: str) -> Column:
    """Every word in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    """As many partitions as the session shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """`df` with `before`: the sum of `value` over the rows of the same `group` that come earlier in `order`.

    Rows are range-sorted by (group, order), so a group of any size spreads over many tasks. Each task keeps one running
    sum; the sums of whole partitions, a row for each pair of partition and group, give the offsets. The sorted rows are
    written once by `stage`, because the borders of a range sort may differ when it is computed again. `group` may be null.
    Rows equal in `order` are told apart by the sort itself; give a total order for results that do not vary.
    """
    keys = [F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    schema = df.withColumn("pid", F.lit(0)).withColumn("local_before", F.lit(0).cast("long")).schema
    fields = list(schema)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for rows in batches:
            if not rows.num_rows:
                continue
            groups = rows.column(group)
            codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            values = rows.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(values) - values
            starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
            before -= np.repeat(before[starts], np.diff(starts, append=len(codes)))
            if groups[0].as_py() == last:
                before[: starts[1] if len(starts) > 1 else len(codes)] += total
            last, total = groups[-1].as_py(), int(before[-1] + values[-1])
            columns = [before if f.name == "local_before" else rows.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [f.name for f in fields])

    ordered = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    done = stage(ordered.mapInArrow(running, schema))
    totals = done.groupBy("pid", group).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"))
    earlier = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pid", F.col(group).alias("_offset_group"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_offset"))
    found = done.join(offsets, (done["pid"] == offsets["pid"]) & done[group].eqNullSafe(offsets["_offset_group"]))
    return found.drop(offsets["pid"]).withColumn("before", F.col("local_before") + F.col("_offset")).drop("pid", "_offset_group", "_offset", "local_before")
