"""From landed feed rows to article candidates: window, filters, domain gate and record shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from presslake import dims
from presslake.functions.text import is_empty, or_null
from presslake.functions.times import instant, parse_time
from presslake.functions.urls import host_contains, host_matches, host_of, url_authority, url_host
from presslake.operators.skew import anti_join, lookup_join

# Added to the position of every non-Danish row, so that all Danish rows come first.
OTHER_SCAN = 1 << 62


def feed_window(df: DataFrame, as_of: dt.datetime, hours: float = 2, compact: bool = False) -> DataFrame:
    """Feed rows seen in the `hours` before `as_of`.

    `compact=True` states that every `seendate` has the form `20240101T101500Z`. Such text sorts like time,
    so the bounds are compared as text and reach the parquet scan.
    """
    start = as_of - dt.timedelta(hours=hours)
    if compact:
        return df.filter(F.col("seendate").between(*(f"{t:%Y%m%dT%H%M%SZ}" for t in (start, as_of))))
    return df.filter(parse_time("seendate").between(instant(start), instant(as_of)))


def seen_after(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Feed rows that claim to be seen after `as_of`, which cannot be."""
    return df.filter(parse_time("seendate") > instant(as_of))


def seen_by(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """All other feed rows, however old; rows whose time cannot be read stay."""
    return df.filter(F.coalesce(parse_time("seendate") <= instant(as_of), F.lit(True)))


def feed_required(df: DataFrame) -> DataFrame:
    return df.filter(~is_empty("url") & ~is_empty("title") & ~is_empty("seendate"))


def accepted_language(domain: str = "domain", language: str = "language",
                      accepted: list[str] = dims.ACCEPTED_LANGUAGES) -> Column:
    """Danish domains pass with any language; others must carry a listed, case-sensitive language."""
    return F.coalesce(F.lower(domain).contains(".dk"), F.lit(False)) | F.coalesce(language, F.lit("en")).isin(accepted)


def language_filter(df: DataFrame, accepted: list[str] = dims.ACCEPTED_LANGUAGES) -> DataFrame:
    return df.filter(accepted_language(accepted=accepted))


def is_danish(domain: str = "domain", language: str = "language",
              danish: list[str] = dims.DANISH_DOMAINS) -> Column:
    return F.coalesce(F.lower(domain).isin(danish), F.lit(False)) | F.coalesce(
        F.lower(language) == "da", F.lit(False)
    )


def with_ingest_rank(df: DataFrame, position: str, domain: str = "domain") -> DataFrame:
    """The order in which duplicates are settled: the Danish scan first, then by `position` (a unique column)."""
    other = ~F.coalesce(F.col(domain).contains(".dk"), F.lit(False))
    return df.withColumn(
        "ingest_rank", F.col(position).cast("bigint") + F.when(other, F.lit(OTHER_SCAN)).otherwise(F.lit(0))
    )


def gate_reason(host: Column, failed: Column, reliable: list[str], problematic: list[str], japanese: list[str],
                strict: bool = True) -> Column:
    """Why a host is kept (`reliable`) or dropped; the first rule that fits names the reason."""
    return (
        F.when(failed, "failed_domain")
        .when(host_contains(host, problematic), "problematic")
        .when(host_contains(host, japanese), "japanese")
        .when(host_matches(host, reliable, strict), "reliable")
        .otherwise("not_listed")
    )


def domain_gate(df: DataFrame, failed: DataFrame | None = None, reliable: list[str] = dims.RELIABLE_DOMAINS,
                problematic: list[str] = dims.PROBLEMATIC_DOMAINS, japanese: list[str] = dims.JAPANESE_DOMAINS,
                strict: bool = True, row_id: str | None = None) -> DataFrame:
    """Add `host` and `gate_reason`; keep rows with `gate_reason = 'reliable'` to apply the gate.

    `failed` holds one row per blacklisted host in column `domain`.
    """
    df = df.withColumn("host", url_host("url"))
    is_failed = F.lit(False)
    if failed is not None:
        flags = failed.select(F.col("domain").alias("host")).distinct().withColumn("__failed", F.lit(True))
        df = lookup_join(df, flags, ["host"], [row_id] if row_id else ["url"])
        is_failed = F.coalesce("__failed", F.lit(False))
    df = df.withColumn("gate_reason", gate_reason(F.col("host"), is_failed, reliable, problematic, japanese, strict))
    return df.drop("__failed")


def drop_failed_domains(df: DataFrame, failed: DataFrame, row_id: str | None = None) -> DataFrame:
    """Drop rows without an address and rows whose host is blacklisted."""
    hosts = failed.select(F.col("domain").alias("__host"))
    rows = df.filter(~is_empty("url")).withColumn("__host", url_host("url"))
    return anti_join(rows, hosts, ["__host"], [row_id] if row_id else ["url"]).select(*df.columns)


def with_domain_category(df: DataFrame, rows: list[tuple[str, str]] = dims.DOMAIN_CATEGORY, domain: str = "domain",
                         out: str = "domain_category") -> DataFrame:
    """Category of a domain: its own entry, else the first listed entry it is a subdomain of, else 'Other'.

    One broadcast equi-join per label count found in the list, instead of a comparison with every entry:
    no row is multiplied and no shuffle is needed. The list is a parameter held by the driver, so its size
    is known to be small.
    """
    table = dims.domain_category_table(df.sparkSession, rows)
    candidates = []
    joined = df.withColumn("__host", host_of(F.coalesce(domain, F.lit(""))))
    for depth in sorted({d.count(".") + 1 for d, _ in rows}):
        level = table.filter(F.col("depth") == depth).select(
            F.col("domain").alias(f"__suffix{depth}"),
            F.struct("ord", "category").alias(f"__hit{depth}"),
        )
        suffix = F.substring_index("__host", ".", -depth)
        joined = joined.withColumn(f"__suffix{depth}", suffix).join(F.broadcast(level), f"__suffix{depth}", "left")
        hit = F.col(f"__hit{depth}")
        exact = F.col("__host") == F.col(f"__suffix{depth}")
        candidates.append(F.when(hit.isNotNull(), F.struct((~exact).alias("sub"), hit["ord"], hit["category"])))
    best = F.least(*candidates) if len(candidates) > 1 else candidates[0]
    kept = [F.col(c) for c in df.columns if c != out]
    return joined.select(*kept, F.coalesce(best["category"], F.lit("Other")).alias(out))


def article_record(df: DataFrame, downloaded_at: dt.datetime | Column,
                   categories: list[tuple[str, str]] = dims.DOMAIN_CATEGORY) -> DataFrame:
    """Feed columns (and `text` when present) in article shape; other columns are kept as they are."""
    when = downloaded_at if isinstance(downloaded_at, Column) else instant(downloaded_at)
    consumed = {"seendate", "sourcecountry", "domain", "language", "title", "url", "text"}
    shaped = df.select(
        "url",
        "title",
        *(["text"] if "text" in df.columns else [F.lit("").alias("text")]),
        F.coalesce(or_null("domain"), url_authority("url")).alias("domain"),
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("sourcecountry", F.lit("")).alias("source_country"),
        F.col("seendate").alias("published_at"),
        when.alias("downloaded_at"),
        F.col("url").alias("gdelt_id"),
        F.lit("basic_text_extraction").alias("extraction_method"),
        *[c for c in df.columns if c not in consumed and c not in {"extraction_method"}],
    )
    return with_domain_category(shaped, categories)


def quota_gap(df: DataFrame, target: int, danish: Column | None = None) -> DataFrame:
    """One row: Danish and other rows at hand and how many are missing from an even split of `target`."""
    danish = is_danish() if danish is None else danish
    target_danish, target_other = target // 2, target - target // 2
    have = df.agg(F.count_if(danish).alias("have_danish"), F.count_if(~danish).alias("have_other"))
    short = F.col("have_danish") + F.col("have_other") < target
    return have.select(
        "have_danish",
        "have_other",
        F.when(short, F.greatest(F.lit(0), F.lit(target_danish) - F.col("have_danish"))).otherwise(0)
        .cast("bigint").alias("missing_danish"),
        F.when(short, F.greatest(F.lit(0), F.lit(target_other) - F.col("have_other"))).otherwise(0)
        .cast("bigint").alias("missing_other"),
    )
