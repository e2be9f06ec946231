"""A table of article counts by day, category, topic, language and domain, kept up to date by what each batch changes.

A batch adds signed counts: what it stores counts up, and the rows it replaces count down in the groups that they were in. Sums of
these give every distribution without reading articles. Retention drops whole days of it, like those of the articles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

#: Columns that articles are counted by, and what is counted.
GROUPS = ["day", "domain_category", "ai_topic", "language", "domain"]
COUNTS = ["articles", "ai_articles"]


def _shaped(articles: DataFrame, day: str) -> DataFrame:
    return articles.select(F.to_date(day).alias("day"), *GROUPS[1:], F.coalesce("ai_topic_detected", F.lit(False)).cast("int").alias("ai"))


def counted(articles: DataFrame, sign: int = 1, day: str = "processed_at") -> DataFrame:
    """The groups of articles with their signed counts."""
    return _shaped(articles, day).groupBy(*GROUPS).agg((sign * F.count(F.lit(1))).alias("articles"), (sign * F.sum("ai")).alias("ai_articles"))


def changes(before: DataFrame, incoming: DataFrame, key: str = "url", day: str = "processed_at") -> DataFrame:
    """What storing `incoming` changes: its groups up, those of the rows of `before` that it replaces down; groups without change are left out.

    Both sides have one row per key; `before` is the current state of the stored table.
    """
    replaced = before.join(incoming.select(key), key, "left_semi")
    return merged(counted(incoming, 1, day), counted(replaced, -1, day))


def removed(before: DataFrame, keys: DataFrame, key: str = "url", day: str = "processed_at") -> DataFrame:
    """What deleting the rows of `keys` changes."""
    return counted(before.join(keys.select(key).distinct(), key, "left_semi"), -1, day)


def merged(*parts: DataFrame) -> DataFrame:
    """The sum of several tables of counts; groups that come to nothing are left out."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    total = every.groupBy(*GROUPS).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return total.where(" or ".join(f"{c} <> 0" for c in COUNTS))


def kept_days(rollup: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Counts of the days that retention keeps whole."""
    return rollup.where(F.col("day") >= F.lit((as_of - dt.timedelta(days=days)).date()))


def distribution(rollup: DataFrame, *by: str) -> DataFrame:
    """Articles and AI articles by any of GROUPS; without columns, one row of totals."""
    return rollup.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).where("articles <> 0")
