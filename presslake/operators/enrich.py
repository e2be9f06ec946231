"""Projections between the stages: store-time values, dashboard cards and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake import dims
from presslake.functions.text import _col, content_hash, is_empty, nfkc, or_null, utf8_clean


def process_articles(df: DataFrame, processed_at: Column, normalize_unicode: bool = False) -> DataFrame:
    """Repair the encoding of every text column, add the content hash and the processing time."""
    fix = lambda c: nfkc(utf8_clean(c)) if normalize_unicode else utf8_clean(c)
    kinds = dict(df.dtypes)
    out = df.select(*[fix(c).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns])
    return out.withColumns({"content_hash": content_hash("text"), "processed_at": processed_at})


def store_projection(df: DataFrame, now: Column, file_stored_in: Column | None = None) -> DataFrame:
    """Values as they are stored: empty fields fall back to the analysis, times to the download time.

    Zero counts as empty for the confidence and an empty list for the keywords.
    """
    a = F.col("analysis")
    summary_en = F.coalesce(or_null("summary_en"), a["explanation"], F.lit(""))
    confidence = F.when(F.coalesce("ai_confidence", F.lit(0.0)) != 0.0, F.col("ai_confidence"))
    keywords = F.when(F.size(F.coalesce("ai_keywords", F.array())) > 0, F.col("ai_keywords"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        blank("url").alias("url"), blank("title").alias("title"), blank("domain").alias("domain"),
        F.coalesce("domain_category", F.lit("unknown")).alias("domain_category"),
        blank("language").alias("language"), blank("source_country").alias("source_country"),
        F.coalesce("processed_at", "downloaded_at", now).alias("processed_at"),
        blank("gdelt_id").alias("gdelt_id"), blank("extraction_method").alias("extraction_method"),
        F.coalesce(a["is_ai_topic"], F.lit(False)).alias("ai_topic_detected"),
        summary_en.alias("summary_en"),
        F.coalesce(or_null("summary_da"), summary_en).alias("summary_da"),
        F.coalesce(or_null("ai_topic"), a["topic"]).alias("ai_topic"),
        F.coalesce(confidence, a["confidence"]).alias("ai_confidence"),
        F.coalesce(keywords, a["keywords"], F.array().cast("array<string>")).alias("ai_keywords"),
        "published_at",
        (F.lit(None).cast("string") if file_stored_in is None else file_stored_in).alias("file_stored_in"),
        "batch_id",
    )


def reject_projection(df: DataFrame, file_stored_in: Column | None = None) -> DataFrame:
    """Rejected rows as they are stored."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select(
        blank("url"), blank("title"), blank("domain"),
        F.coalesce("domain_category", F.lit("unknown")).alias("domain_category"),
        blank("language"), blank("source_country"), F.col("downloaded_at").alias("rejected_at"),
        blank("gdelt_id"), blank("extraction_method"),
        F.coalesce(or_null("rejection_reason"), F.lit("unknown")).alias("rejection_reason"),
        (F.lit(None).cast("string") if file_stored_in is None else file_stored_in).alias("file_stored_in"),
        "batch_id",
    )


def category_or_other(c: Column | str) -> Column:
    c = _col(c)
    return F.when(is_empty(c) | (F.lower(c) == "unknown"), "other").otherwise(c)


def topic_or_other(c: Column | str) -> Column:
    c = _col(c)
    return F.when(is_empty(c) | F.lower(c).isin(dims.EMPTY_TOPICS), "other").otherwise(c)


def _without_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^" + dims.EXPLANATION_PREFIX, "")


def article_cards(df: DataFrame, lang: str = "en") -> DataFrame:
    """Stored rows as the reader sees them: default texts, normalised category and topic, parsed keywords.

    Confidence and keywords may be native or text; text that cannot be read becomes 0.0 and an empty list.
    """
    summary_en = _without_prefix(F.coalesce(or_null("summary_en"), F.lit("No AI explanation available")))
    summary_da = _without_prefix(F.coalesce(or_null("summary_da"), summary_en))
    words = F.col("ai_keywords")
    if dict(df.dtypes)["ai_keywords"] == "string":
        words = F.from_json(words, "array<string>")
    first, second = (summary_da, summary_en) if lang == "da" else (summary_en, summary_da)
    return df.select(
        F.coalesce("title", F.lit("No title")).alias("title"),
        summary_en.alias("summary_en"),
        summary_da.alias("summary_da"),
        F.coalesce(first, second, F.lit("No summary available")).alias("summary"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("domain", F.lit("Unknown")).alias("domain"),
        F.coalesce("published_at", F.lit("")).alias("published_date"),
        "processed_at",
        F.coalesce("language", F.lit("Unknown")).alias("language"),
        category_or_other("domain_category").alias("domain_category"),
        topic_or_other("ai_topic").alias("ai_topic"),
        F.coalesce(F.col("ai_confidence").try_cast("double"), F.lit(0.0)).alias("ai_confidence"),
        F.coalesce(words, F.array().cast("array<string>")).alias("ai_keywords"),
    )


def with_label(df: DataFrame, value: str, kind: str, lang: str, out: str, fix_missing: bool = False) -> DataFrame:
    """Display label of a topic or category: a broadcast join with a fixed label list, else the 'Other' label."""
    key = F.lower(category_or_other(value)) if kind == "category" else topic_or_other(value)
    labels = dims.label_table(df.sparkSession, kind, lang, fix_missing).select(
        F.col("key").alias("__key"), F.col("label").alias("__label")
    )
    return (
        df.withColumn("__key", key)
        .join(F.broadcast(labels), "__key", "left")
        .withColumn(out, F.coalesce("__label", F.lit(dims.OTHER_LABEL[lang])))
        .drop("__key", "__label")
    )
