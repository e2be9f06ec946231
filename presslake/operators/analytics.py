"""Monitoring questions over the stored tables: totals, distributions, rates and statistics.

Every aggregate combines on the map side first. Row limits exist only as parameters of the two
distribution reports, as they do in the dashboards these stand for; the default is the whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.times import instant
from presslake.operators.dedup import canonical_articles
from presslake.operators.enrich import category_or_other, topic_or_other, with_label


def _rows() -> Column:
    return F.count(F.lit(1))


def since(df: DataFrame, as_of: dt.datetime, days: int, column: str = "processed_at") -> DataFrame:
    """Rows of the last `days` before `as_of`; a plain comparison, so it reaches the scan."""
    return df.filter(F.col(column) >= instant(as_of - dt.timedelta(days=days)))


def ai_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ai_topic_detected"))


def _percent(hits: Column, rows: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), rows.cast("double")) * 100, F.lit(0.0))


def dashboard_stats(df: DataFrame, as_of: dt.datetime, days: int = 7, approximate: bool = False) -> DataFrame:
    """One row: recent articles, distinct domains and the share of hits in percent, in one pass."""
    distinct = F.approx_count_distinct("domain") if approximate else F.count_distinct("domain")
    return since(df, as_of, days).agg(
        _rows().alias("recent_articles"),
        distinct.alias("unique_domains"),
        F.round(_percent(F.count_if("ai_topic_detected"), _rows()), 2).alias("ai_topic_percentage"),
        F.lit(days).cast("bigint").alias("days_analyzed"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(_rows().alias("n")).orderBy(F.desc("n"), column)


def totals(df: DataFrame) -> DataFrame:
    return df.agg(_rows().alias("total_articles"), F.count_if("ai_topic_detected").alias("ai_articles"))


def high_water_mark(df: DataFrame) -> DataFrame:
    """Latest processing time: where an incremental load continues."""
    return df.agg(F.max("processed_at").alias("last_processed_at"))


def last_update(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'completed'").agg(F.max("completed_at").alias("last_update"))


def newest(df: DataFrame, limit: int | None) -> DataFrame:
    """The `limit` newest rows, all rows for None."""
    return df if limit is None else df.orderBy(F.desc("processed_at"), "url").limit(limit)


def topic_distribution(df: DataFrame, lang: str = "da", limit: int | None = None) -> DataFrame:
    """Hits per topic label, one per canonical article, without those that have no topic."""
    known = canonical_articles(newest(ai_only(df), limit)).filter(topic_or_other("ai_topic") != "other")
    # Grouped by the raw topic first: the label join then sees one row per topic instead of one per article.
    counts = known.groupBy("ai_topic").agg(_rows().alias("n"))
    return with_label(counts, "ai_topic", "topic", lang, "label").groupBy("label").agg(F.sum("n").alias("n"))


def category_distribution(df: DataFrame, lang: str = "da", limit: int | None = None,
                          fix_missing: bool = False) -> DataFrame:
    """Hits per category label; duplicates and 'Other' are counted."""
    counts = newest(ai_only(df), limit).groupBy("domain_category").agg(_rows().alias("n"))
    labelled = with_label(counts, "domain_category", "category", lang, "label", fix_missing)
    return labelled.groupBy("label").agg(F.sum("n").alias("n"))


def topic_counts(df: DataFrame) -> DataFrame:
    """Hits per topic, of all hits that have one.

    Works on the `analysis` struct of a classified batch.
    """
    hits = F.coalesce(F.col("analysis.is_ai_topic"), F.lit(False))
    return (
        df.filter(hits & (F.coalesce("analysis.topic", F.lit("")) != ""))
        .groupBy(F.col("analysis.topic").alias("topic")).agg(_rows().alias("n"))
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """One row: articles, hits and the share of hits in a classified batch."""
    hits = F.count_if(F.coalesce(F.col("analysis.is_ai_topic"), F.lit(False)))
    return df.agg(_rows().alias("total_articles"), hits.alias("ai_articles"), _percent(hits, _rows()).alias("ai_percentage"))


def top_keywords(df: DataFrame, k: int = 10) -> DataFrame:
    """The `k` most frequent keywords of hits; equal counts are ordered by keyword."""
    return (
        df.filter("analysis.is_ai_topic")
        .select(F.explode("analysis.keywords").alias("keyword"))
        .groupBy("keyword").agg(_rows().alias("n"))
        .orderBy(F.desc("n"), "keyword").limit(k)
    )


def run_counters(tagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a batch from rows tagged with `stage`, the last step each row reached.

    Stages: fetch_failed, processing_failed, rejected, duplicate, storage_failed, stored. Hits are stored rows
    with `is_ai_topic`.
    """
    at = lambda *names: F.count_if(F.col("stage").isin(*names))
    return tagged.groupBy(*(by or [])).agg(
        F.count_if(F.col("stage") != "fetch_failed").alias("fetched"),
        at("duplicate", "stored", "storage_failed").alias("validated"),
        at("stored").alias("stored"),
        at("rejected", "processing_failed").alias("rejected"),
        at("fetch_failed").alias("failed_fetching"),
        at("processing_failed").alias("failed_processing"),
        at("rejected").alias("failed_validation"),
        at("storage_failed").alias("failed_storage"),
        F.count_if((F.col("stage") == "stored") & F.coalesce("is_ai_topic", F.lit(False))).alias("ai_topic_count"),
    )


def daily_statistics(df: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per day: articles, distinct domains, languages and countries, share of hits, mean run time."""
    per_day = df.groupBy(F.to_date("processed_at").alias("date")).agg(
        _rows().alias("total_articles"),
        F.count_distinct("domain").alias("unique_domains"),
        F.count_distinct("language").alias("languages_count"),
        F.count_distinct("source_country").alias("countries_count"),
        _percent(F.count_if("ai_topic_detected"), _rows()).alias("ai_topic_percentage"),
    )
    run_time = runs.groupBy(F.to_date("started_at").alias("date")).agg(F.avg("seconds").alias("mean"))
    # Both sides are one row per day.
    return per_day.join(run_time, "date", "left").select(
        *per_day.columns, F.coalesce("mean", F.lit(0.0)).alias("processing_time_avg")
    )


def run_rates(runs: DataFrame) -> DataFrame:
    """One row over completed runs: articles per hour, stored and rejected share of fetched, share of hits."""
    done = runs.filter("status = 'completed'").agg(
        _rows().alias("runs"), *[F.sum(c).alias(c) for c in ("fetched", "stored", "rejected", "ai_topic_count", "seconds")]
    )
    share = lambda a, b: _percent(F.col(a), F.col(b))
    return done.select(
        "runs",
        F.try_divide(F.col("stored").cast("double"), F.col("seconds") / 3600).alias("articles_per_hour"),
        share("stored", "fetched").alias("success_rate"),
        share("rejected", "fetched").alias("rejection_rate"),
        share("ai_topic_count", "stored").alias("detection_rate"),
    )


def facets(df: DataFrame) -> DataFrame:
    """Distinct categories and topics of a set of articles, ordered; topics leave out empty values."""
    categories = df.select(F.lit("category").alias("facet"), category_or_other("domain_category").alias("value"))
    topics = df.filter(F.coalesce("ai_topic", F.lit("")) != "").select(
        F.lit("topic").alias("facet"), topic_or_other("ai_topic").alias("value")
    )
    return categories.distinct().unionByName(topics.distinct()).orderBy("facet", "value")
