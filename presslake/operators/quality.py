"""Row validation with reasons, and failure tracking per domain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.text import is_empty, strip
from presslake.functions.times import instant
from presslake.functions.urls import url_host

MIN_ARTICLE_LENGTH = 700
MAX_FAILURES = 5


def with_placeholder(df: DataFrame) -> DataFrame:
    """Rows without text get the stand-in sentence that names their domain and title."""
    # The sentence is a fixed value.
    sentence = F.concat(
        F.lit("Article from "), F.coalesce("domain", F.lit("unknown domain")),
        F.lit(". Full text extraction failed. This is a metadata-only article with title: "),
        F.coalesce("title", F.lit("No title")),
        F.lit(". The complete article content can be accessed at the provided URL."),
    )
    return df.withColumn("text", F.when(is_empty("text"), sentence).otherwise(F.col("text")))


def reject_reason(min_length: int = MIN_ARTICLE_LENGTH, date: str = "published_at") -> Column:
    """The first rule a row breaks; null for a valid row. Expects placeholder text to be filled in."""
    blank = lambda c: is_empty(strip(c))
    return (
        F.when(blank("url"), "missing_url")
        .when(blank("title"), "missing_title")
        .when(blank(date), "missing_date")
        .when(blank("text"), "blank_text")
        .when(F.length("text") < min_length, "text_too_short")
        .when(~(F.col("url").startswith("http://") | F.col("url").startswith("https://")), "invalid_url")
    )


def validate(df: DataFrame, min_length: int = MIN_ARTICLE_LENGTH, date: str = "published_at") -> DataFrame:
    """Add `reject_reason` (null = valid) and the coarse `rejection_reason`, in one pass over the rows."""
    out = with_placeholder(df).withColumn("reject_reason", reject_reason(min_length, date))
    return out.withColumn(
        "rejection_reason", F.when(F.col("reject_reason").isNotNull(), F.lit("validation_failed"))
    )


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNull()).drop("reject_reason", "rejection_reason")


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNotNull())


def rejects_by_reason(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def long_enough(df: DataFrame, min_length: int = MIN_ARTICLE_LENGTH) -> DataFrame:
    """Rows whose extracted text, before any cleaning, has at least `min_length` characters."""
    return df.filter(F.length("text") >= min_length)


def extraction_failures(df: DataFrame, at: Column, batch_id: str, min_length: int = MIN_ARTICLE_LENGTH) -> DataFrame:
    """A FAILURE row for each row without usable text."""
    reason = F.when(is_empty("text"), "text_extraction_failed").when(
        F.length("text") < min_length, "text_too_short_before_processing"
    )
    return df.select(
        url_host("url").alias("domain"), reason.alias("reason"), at.alias("at"), F.lit(batch_id).alias("batch_id")
    ).dropna(subset=["reason"])


def empty_scans(expected: DataFrame, feed: DataFrame, articles: DataFrame, at: Column, batch_id: str) -> DataFrame:
    """A FAILURE row for each expected domain without feed rows, or with feed rows but no article."""
    seen = feed.select("domain").distinct().withColumn("__seen", F.lit(True))
    good = articles.select("domain").distinct().withColumn("__good", F.lit(True))
    reason = F.when(F.col("__seen").isNull(), "no_articles_found").when(F.col("__good").isNull(), "no_valid_articles")
    return (
        expected.select("domain").join(seen, "domain", "left").join(good, "domain", "left")
        .select("domain", reason.alias("reason"), at.alias("at"), F.lit(batch_id).alias("batch_id"))
        .dropna(subset=["reason"])
    )


def domain_failures(failures: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Failures per domain with the kinds of reason and the blacklist flag.

    The text after ':' in a reason is free, so reasons are counted by kind first, each under its own name. What is then gathered per
    domain is one pair per kind, however many failures it has; kinds are few, because code names them. For reasons
    whose first part is free as well there is `failures_by_kind`, which gathers nothing.
    """
    kind = F.substring_index(F.coalesce("reason", F.lit("text_extraction_failed")), ":", 1)
    return (
        failures.groupBy("domain", kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
        .groupBy("domain")
        .agg(
            F.sum("n").alias("failures"),
            F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("reasons"),
            F.max("at").alias("last_failure_at"),
        )
        .withColumn("is_failed", F.col("failures") >= max_failures)
    )


def failures_by_kind(failures: DataFrame) -> DataFrame:
    """One row per domain and kind of reason, every kind under its own name."""
    kind = F.substring_index(F.coalesce("reason", F.lit("text_extraction_failed")), ":", 1)
    return failures.groupBy("domain", kind.alias("kind")).agg(F.count(F.lit(1)).alias("failures"), F.max("at").alias("last_failure_at"))


def failed_domains(failures: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """The blacklist: one row per domain with at least `max_failures` failures."""
    return (
        failures.groupBy("domain").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= max_failures)
    )


def failure_report(failures: DataFrame, batch_start: dt.datetime | None = None,
                   max_failures: int = MAX_FAILURES) -> DataFrame:
    """One row: tracked and failed domains, all failures, and the seconds from batch start to the last one."""
    per_domain = failures.groupBy("domain").agg(
        F.count(F.lit(1)).alias("failures"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    start = instant(batch_start) if batch_start else F.min("first_at")
    return per_domain.agg(
        F.count(F.lit(1)).alias("tracked_domains"),
        F.count_if(F.col("failures") >= max_failures).alias("failed_domains"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("total_failures"),
        (F.max("last_at").cast("double") - start.cast("double")).alias("batch_seconds"),
    )
