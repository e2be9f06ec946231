"""Reading lists: newest rows, filters and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake.operators.enrich import category_or_other, topic_or_other

RECENT_COLUMNS = ["url", "title", "domain", "domain_category", "language", "processed_at"]
RECENT_AI_COLUMNS = [
    "url", "title", "domain", "domain_category", "language", "source_country", "processed_at", "ai_topic_detected",
    "summary_en", "summary_da", "ai_topic", "ai_confidence", "ai_keywords", "published_at",
]


def newest_first(df: DataFrame) -> DataFrame:
    """The order of all article lists: by time, the newest first, then by address."""
    return df.orderBy(F.desc("processed_at"), "url")


def recent_articles(df: DataFrame, limit: int = 10) -> DataFrame:
    """Newest articles; order and limit become one top-k step per partition."""
    return newest_first(df.select(*RECENT_COLUMNS)).limit(limit)


def recent_ai_articles(df: DataFrame, limit: int = 10) -> DataFrame:
    return newest_first(df.filter("ai_topic_detected").select(*RECENT_AI_COLUMNS)).limit(limit)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return (
        runs.select("run_id", "started_at", "completed_at", "stored", "seconds", "status")
        .orderBy(F.desc("started_at"), "run_id").limit(limit)
    )


def _choice(value: Column, chosen: str) -> Column:
    if chosen == "all":
        return F.lit(True)
    return F.lower(value) == "other" if chosen == "other" else value == chosen


def browse(df: DataFrame, category: str = "all", topic: str = "all") -> DataFrame:
    """Rows of one category and topic; 'all' does not filter, 'other' takes rows without a value."""
    return df.filter(_choice(category_or_other("domain_category"), category) & _choice(topic_or_other("ai_topic"), topic))


def browse_page(df: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """One page of the newest-first list, by position."""
    return newest_first(df).offset((page - 1) * size).limit(size)


def browse_after(df: DataFrame, processed_at: object, url: str, size: int = 10) -> DataFrame:
    """The page that follows a given row. Deep pages cost no more than the first: earlier rows are filtered
    out in the scan instead of being sorted and skipped."""
    at = F.lit(processed_at)
    return newest_first(
        df.filter((F.col("processed_at") < at) | ((F.col("processed_at") == at) & (F.col("url") > url)))
    ).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.ceil(n / size).alias("pages"))
