"""Tolerant time parsing and display."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from presslake.functions.text import _col

COMPACT = "yyyyMMdd'T'HHmmssX"


def instant(t: dt.datetime) -> Column:
    """A fixed time as a literal. A time without a zone is UTC, whatever zone the driver runs in."""
    return F.lit(t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc))


def parse_time(c: Column | str) -> Column:
    """Compact feed form (`20240101T101500Z`) or ISO text to a timestamp; null when neither fits."""
    c = _col(c)
    return F.coalesce(F.try_to_timestamp(c, F.lit(COMPACT)), F.try_to_timestamp(c))


def display_time(c: Column | str) -> Column:
    """`yyyy-MM-dd HH:mm` in the text's own offset; text that cannot be read is shown as it is."""
    c = _col(c)
    wall = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    read = F.coalesce(F.try_to_timestamp(wall, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(wall))
    return F.when(c.contains("T"), F.coalesce(F.date_format(read, "yyyy-MM-dd HH:mm"), c)).otherwise(c)
