"""Articles per hour, day, week, month and year, with empty buckets shown as zero."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from presslake import dims
from presslake.functions.times import instant


def _period(unit: str, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "hour":
        return day, day + dt.timedelta(days=1)
    if unit == "day":
        monday = day - dt.timedelta(days=day.weekday())
        return monday, monday + dt.timedelta(days=7)
    if unit == "week":
        first = day.replace(day=1)
        return first, (first + dt.timedelta(days=32)).replace(day=1)
    first = day.replace(month=1, day=1)
    return first, first.replace(year=first.year + 1)


def _bucket(unit: str, time: str):
    c = F.col(time)
    return {
        "hour": F.hour(c),
        "day": F.weekday(c) + 1,
        # Four labels cover a month: days 1-7, 8-14, 15-21 and the rest.
        "week": F.least(F.lit(4), F.floor((F.dayofmonth(c) - 1) / 7) + 1),
        "month": F.month(c),
        "year": F.year(c),
    }[unit].cast("int")


LABELS = {"day": dims.DAY_LABELS, "week": dims.WEEK_LABELS, "month": dims.MONTH_LABELS}


def trend(df: DataFrame, unit: str, as_of: dt.datetime, lang: str = "en", years: int = 5,
          time: str = "processed_at") -> DataFrame:
    """Article counts for the current period of `as_of`: `(bucket, label, n)`.

    `hour`: the day, by hour. `day`: the week, by weekday. `week`: the month, by week. `month`: the year, by
    month. `year`: the last `years` years. The period is a range filter that reaches the scan; the counts are
    at most 24 rows when they meet the calendar.
    """
    start, end = _period(unit, as_of)
    buckets = {"hour": range(24), "day": range(1, 8), "week": range(1, 5), "month": range(1, 13)}.get(unit)
    if unit == "year":
        start = start.replace(year=start.year - years + 1)
        buckets = range(start.year, end.year)
    names = LABELS.get(unit)
    if names:
        labels = [names[b - 1][1 if lang == "en" else 2] for b in buckets]
    else:
        labels = [f"{b:02d}:00" if unit == "hour" else str(b) for b in buckets]
    calendar = df.sparkSession.createDataFrame(list(zip(buckets, labels)), "bucket INT, label STRING")
    counts = (
        df.filter((F.col(time) >= instant(start)) & (F.col(time) < instant(end)))
        .groupBy(_bucket(unit, time).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return calendar.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def time_rollup(df: DataFrame, units: list[str], start: dt.datetime | None = None, end: dt.datetime | None = None,
                time: str = "processed_at") -> DataFrame:
    """Counts per bucket over any range, or all time, with subtotals: a rollup over truncated times, largest unit first."""
    levels = [F.date_trunc(u, time).alias(u) for u in units]
    rows = df if start is None else df.filter(F.col(time) >= instant(start))
    rows = rows if end is None else rows.filter(F.col(time) < instant(end))
    return (
        rows.filter(F.col(time).isNotNull())
        .select(*levels).rollup(*units).agg(F.count(F.lit(1)).alias("n"))
    )
