"""One monitoring batch, from landed feed rows and pages to stored tables."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presslake import dims
from presslake.functions.times import instant
from presslake.functions.urls import url_host
from presslake.operators import classify, dedup, enrich, extract, feed as feeds, quality
from presslake.operators.analytics import run_counters
from presslake.operators.skew import anti_join, semi_join
from presslake.schemas import ANSWER, ARTICLE, FAILURE, FEED, PENDING, REJECTED, STORED, STORED_ANSWER, STORED_REJECTED, SUMMARY_TABLE, conform
from presslake.session import dropping_stages, staged
from presslake.sources import keyed, members, readers, store


@dataclass(frozen=True)
class BatchConfig:
    """Everything a batch depends on. There is no hidden clock: the same inputs give the same tables.

    With `look_back_hours=None` every feed row up to `as_of` counts, however old, and rows that claim a later time are
    stored as rejected; that is for feeds which give each row once.
    """

    as_of: dt.datetime
    batch_id: str
    look_back_hours: float | None = 2
    min_length: int = quality.MIN_ARTICLE_LENGTH
    max_failures: int = quality.MAX_FAILURES
    retention_days: int = 30
    reliable: list[str] = field(default_factory=lambda: dims.RELIABLE_DOMAINS)
    problematic: list[str] = field(default_factory=lambda: dims.PROBLEMATIC_DOMAINS)
    japanese: list[str] = field(default_factory=lambda: dims.JAPANESE_DOMAINS)
    languages: list[str] = field(default_factory=lambda: dims.ACCEPTED_LANGUAGES)
    categories: list[tuple[str, str]] = field(default_factory=lambda: dims.DOMAIN_CATEGORY)
    classifier: dict = field(default_factory=dict)
    #: States that every `seendate` reads like `20240101T101500Z`, so that the look-back reaches the scan as text bounds.
    compact_dates: bool = False
    #: Days for which a failure counts against its domain; None: for ever.
    failure_days: int | None = None
    #: Domains of which each batch must bring a feed row and an article; a miss is a failure of the domain.
    expected_domains: list[str] = field(default_factory=list)
    #: Buckets of the article tables, by a hash of the address; None: plain tables. A table keeps the number it was made with.
    key_buckets: int | None = None
    #: Leave membership filters beside the article tables, and read only the days of history that they ask for.
    member_filters: bool = False


def select_candidates(feed: DataFrame, config: BatchConfig, known: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
                      failed: DataFrame | None = None, position: str = "position") -> DataFrame:
    """Feed rows worth extracting, in ingest order. All native filters come before any page is read.

    `known` holds the stored addresses, or tells which of the given rows' addresses are stored.
    """
    if config.look_back_hours is None:
        rows = feeds.feed_required(feeds.seen_by(feed, config.as_of))
    else:
        rows = feeds.feed_required(feeds.feed_window(feed, config.as_of, config.look_back_hours, config.compact_dates))
    rows = feeds.with_ingest_rank(feeds.language_filter(rows, config.languages), position)
    gated = feeds.domain_gate(rows, failed, config.reliable, config.problematic, config.japanese,
                              row_id="ingest_rank").filter("gate_reason = 'reliable'")
    if callable(known):
        gated = staged(gated)
        known = known(gated)
    return gated if known is None else dedup.new_urls(gated, known)


def append_articles(df: DataFrame, path: str, schema: T.StructType, config: BatchConfig, day: str) -> None:
    """Write the rows of a batch to an article table, in the layout that the batch asks for."""
    if config.member_filters:
        members.write(df, path, "url", day, config.batch_id)
    if config.key_buckets:
        keyed.create(df.sparkSession, path, schema, "url", config.key_buckets)
    if keyed.layout(df.sparkSession, path) is not None:
        keyed.append(df, path, day, config.batch_id)
    else:
        store.append_batch(df, path, day, batch_id=config.batch_id)


def known_by_filters(spark: SparkSession, processed: str, rejected: str, config: BatchConfig) -> Callable[[DataFrame], DataFrame]:
    """Which addresses of some rows are stored, exactly, by way of the membership filters of both tables."""
    others, since = F.col("batch_id") != config.batch_id, config.as_of - dt.timedelta(days=config.retention_days)

    def known(rows: DataFrame) -> DataFrame:
        kept = others & (F.col("processed_at") >= instant(since))
        return members.known_keys(rows, processed, STORED, since=since, where=kept).unionByName(
            members.known_keys(rows, rejected, STORED_REJECTED, where=others)).distinct()

    return known


def page_texts(candidates: DataFrame, pages: DataFrame, min_region: int = extract.MIN_REGION) -> DataFrame:
    """(url, text) of every candidate whose page has landed; the text is null where none can be read.

    An entry of an overview page is read from its own block, any other page as a whole. Of a page landed more than once the
    longest text counts.
    """
    landed = pages.select("url", "html").join(candidates.select("url").distinct(), "url", "left_semi")
    marked = landed.withColumn("entry", F.when(extract.is_overview_entry(url_host("url")), F.col("html")))
    marked = marked.withColumn("html", F.when(~extract.is_overview_entry(url_host("url")), F.col("html")))
    read = extract.entry_text(extract.page_text(marked, min_region=min_region), "entry", "url", "entry_text")
    read = read.select("url", F.coalesce("text", "entry_text").alias("text"))
    return read.groupBy("url").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))


def extract_articles(candidates: DataFrame, pages: DataFrame, config: BatchConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unique articles with text, failure rows, candidates whose page has not landed).

    Every page is read once however often the feed lists it. Only landed pages can fail. Titles that merely name the site are
    replaced by the heading of the page. Duplicates are settled on feed columns, and the text joins
    afterwards, when addresses are unique.
    """
    texts = staged(page_texts(candidates, pages))
    waiting = anti_join(candidates, texts, ["url"], ["ingest_rank"])
    failures = quality.extraction_failures(texts, instant(config.as_of), config.batch_id, config.min_length)
    usable = quality.long_enough(texts, config.min_length)
    readable = staged(semi_join(candidates, usable, ["url"], ["ingest_rank"]))
    # Pages are read for headings only when a title asks for it.
    if not readable.where(extract.is_generic_title()).isEmpty():
        readable = staged(extract.title_repair(readable, pages, row_id="ingest_rank").drop("title_repaired"))
    unique = dedup.dedup_batch(readable)
    articles = extract.cleaned(unique.join(usable, "url"))
    return feeds.article_record(articles, config.as_of, config.categories), failures, waiting


#: First rank of rows that waited for their page: before all new rows of the same scan.
WAITED = -(1 << 61)


def pending_rows(waiting: DataFrame, carried: DataFrame, config: BatchConfig) -> DataFrame:
    """What the batch writes about waiting candidates: those that wait now, and those that waited before and are settled."""
    waits = conform(waiting, FEED).groupBy("url").agg(F.min(F.struct(*[c for c in FEED.names if c != "url"])).alias("row"))
    waits = waits.select("url", *[F.col(f"row.{c}").alias(c) for c in FEED.names if c != "url"], F.lit(True).alias("waits"))
    settled = conform(carried, FEED).join(waits.select("url"), "url", "left_anti").withColumn("waits", F.lit(False))
    return waits.unionByName(settled).withColumns({"batch_id": F.lit(config.batch_id), "at": instant(config.as_of)})


def carried_rows(pending: DataFrame, position: str, config: BatchConfig) -> DataFrame:
    """Feed rows of earlier batches that still wait for their page, ranked before the new rows of their scan."""
    recent = store.retained(pending, config.as_of, config.retention_days, "at")
    last = store.latest(recent, "url", store.written_order("at")).where("waits")
    return last.select(*FEED.names, (F.pmod(F.xxhash64("url"), F.lit(1 << 60)) + F.lit(WAITED)).alias(position))


def ahead_of_time(feed: DataFrame, config: BatchConfig) -> DataFrame:
    """Feed rows dated after `as_of` as rejected articles, one per address; their pages are not read."""
    rows = feeds.feed_required(feeds.seen_after(feed, config.as_of)).drop("text")
    named = [c for c in rows.columns if c != "url"]
    one = rows.groupBy("url").agg(F.min(F.struct(*named)).alias("__row")).select("url", *[F.col(f"__row.{c}").alias(c) for c in named])
    return feeds.article_record(one, config.as_of, config.categories).withColumns(
        {"reject_reason": F.lit("date_in_future"), "rejection_reason": F.lit("validation_failed")}
    )


def classify_articles(valid: DataFrame, cache: DataFrame, config: BatchConfig,
                      responses: DataFrame | None = None,
                      translator: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Analysis, flat columns and both summaries; what the cache does not hold comes from `translator`, where there is one."""
    if responses is None:
        scored = classify.classify_keywords(valid, **config.classifier)
    else:
        scored = classify.classify_mixed(valid, responses, **config.classifier)
    flat = classify.flatten_analysis(scored, keep=True)
    if translator is not None:
        # Both the work-list and the result read the classified rows; translations are asked for once.
        flat = staged(flat)
        cache = classify.merge_cache(cache, staged(classify.translate_missing(flat, cache, translator)))
    return classify.fill_summaries(flat, cache, unique_urls=True).drop("from_cache", "parsed_as")


@dropping_stages
def run_batch(spark: SparkSession, feed: DataFrame, pages: DataFrame, root: str, config: BatchConfig,
              responses: DataFrame | None = None, position: str = "position",
              scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
              translator: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> dict:
    """Run one batch against the tables below `root` and return its counters.

    Candidates whose page has not landed wait in the table `pending` and join later batches until it has, for
    `retention_days`. `scorer` (rows of url, title and text in, `url, response_text` out) answers for articles without a
    landed answer; its answers and the errors of batches that it could not answer are kept in `responses`. `translator` (rows of
    cache_key, url and summary_en in, `cache_key, summary` out) gives the second-language summaries that the cache lacks.

    Writing is idempotent per `batch_id`; history is read without the batch's own rows, so running a batch
    again after a failure stores the same rows.
    """
    begun = time.monotonic()
    paths = {name: f"{root}/{name}" for name in
             ("processed", "rejected", "failures", "runs", "summary_cache", "pending", "responses", "articles_json", "rejected_json", "manifest")}
    store.append_run_event(store.run_event(spark, config.batch_id, config.as_of, "running"), paths["runs"])
    try:
        others = F.col("batch_id") != config.batch_id
        kept_since = config.as_of - dt.timedelta(days=config.retention_days)
        processed = store.retained(
            readers.read_table(spark, paths["processed"], STORED, since=kept_since).filter(others), config.as_of, config.retention_days
        )
        rejected = readers.read_table(spark, paths["rejected"], STORED_REJECTED).filter(others)
        cache = store.latest(
            readers.read_table(spark, paths["summary_cache"], SUMMARY_TABLE).filter(others), "cache_key", store.written_order("at")
        )
        failed_since = None if config.failure_days is None else config.as_of - dt.timedelta(days=config.failure_days)
        failures = readers.read_table(spark, paths["failures"], FAILURE, since=failed_since).filter(others)
        known = known_by_filters(spark, paths["processed"], paths["rejected"], config) if config.member_filters else dedup.known_urls(processed, rejected)
        counted = failures if config.failure_days is None else store.retained(failures, config.as_of, config.failure_days, "at")
        failed = quality.failed_domains(counted, config.max_failures)

        pending = readers.read_table(spark, paths["pending"], PENDING, since=kept_since).filter(others)
        carried = staged(carried_rows(pending, position, config))
        fresh_rows = select_candidates(feed, config, known, failed, position)
        # A row that waited has passed the look-back before; the other filters apply again.
        waited = select_candidates(carried, replace(config, look_back_hours=None), known, failed, position)
        candidates = staged(fresh_rows.unionByName(waited, allowMissingColumns=True))
        articles, new_failures, waiting = extract_articles(candidates, pages, config)
        new_failures = staged(new_failures)
        waiting = staged(waiting)
        validated = staged(quality.validate(articles, config.min_length))
        valid = enrich.process_articles(quality.valid_rows(validated), instant(config.as_of))
        fresh = dedup.dedup_cross_run(valid, None, processed)
        if scorer is not None:
            fresh = staged(fresh)
            # Answers of earlier runs count, also those of this batch, so a re-run pays for what is missing.
            stored_answers = readers.read_table(spark, paths["responses"], STORED_ANSWER).filter("scorer_error IS NULL")
            landed = stored_answers.select("url", "response_text")
            if responses is not None:
                landed = responses.unionByName(landed, allowMissingColumns=True)
            answers = staged(classify.score_missing(fresh.select("url", "title", "text"), landed, scorer, ANSWER))
            own = stored_answers.filter(~others).select(*answers.columns)
            kept_answers = staged(answers.unionByName(own).withColumns({"batch_id": F.lit(config.batch_id), "at": instant(config.as_of)}))
            good_answers = answers.select("url", "response_text").dropna()
            responses = staged(landed.unionByName(good_answers, allowMissingColumns=True))
            store.append_batch(kept_answers, paths["responses"], "at", batch_id=config.batch_id)
        scored = classify_articles(fresh, cache, config, responses, translator).withColumn("batch_id", F.lit(config.batch_id))
        accepted = staged(scored)
        turned_down = quality.rejected_rows(validated)
        if config.look_back_hours is None:
            turned_down = turned_down.unionByName(ahead_of_time(feed, config), allowMissingColumns=True)
        refused = turned_down.withColumns(
            {"batch_id": F.lit(config.batch_id), "rejected_at": F.col("downloaded_at")}
        )

        store.write_batch_json(conform(accepted, ARTICLE), paths["articles_json"], config.batch_id)
        store.write_batch_json(conform(refused, REJECTED), paths["rejected_json"], config.batch_id)
        stored = enrich.store_projection(accepted, instant(config.as_of),
                                         F.lit(f"{paths['articles_json']}/batch_id={config.batch_id}"))
        append_articles(stored, paths["processed"], STORED, config, "processed_at")
        refusals = enrich.reject_projection(refused, F.lit(f"{paths['rejected_json']}/batch_id={config.batch_id}"))
        append_articles(refusals, paths["rejected"], STORED_REJECTED, config, "rejected_at")
        of_domains = conform(new_failures, FAILURE)
        if config.expected_domains:
            expected = spark.createDataFrame([(d,) for d in config.expected_domains], "domain string")
            seen = feeds.feed_required(feed).select(url_host("url").alias("domain"))
            good = quality.valid_rows(validated).select(url_host("url").alias("domain"))
            missed = quality.empty_scans(expected, seen, good, instant(config.as_of), config.batch_id)
            of_domains = of_domains.unionByName(conform(missed, FAILURE))
        store.append_batch(of_domains, paths["failures"], "at", batch_id=config.batch_id)
        store.append_batch(pending_rows(waiting, carried, config), paths["pending"], "at", batch_id=config.batch_id)
        filled = accepted.filter(F.col("ai_topic_detected") & (F.col("summary_da") != "")).select(
            classify.cache_key().alias("cache_key"), F.col("summary_da").alias("summary"),
            F.lit(config.batch_id).alias("batch_id"), instant(config.as_of).alias("at"),
        )
        new_entries = filled.join(cache.select("cache_key"), "cache_key", "left_anti")
        store.append_batch(new_entries, paths["summary_cache"], "at", batch_id=config.batch_id)
        manifest = store.batch_manifest(accepted, refused, instant(config.as_of), f"{root}/")
        store.append_batch(manifest, paths["manifest"], "written_at", batch_id=config.batch_id)

        tagged = (
            validated.select("url", F.when(F.col("reject_reason").isNotNull(), "rejected").alias("stage"))
            .join(accepted.select("url", F.col("ai_topic_detected").alias("is_ai_topic")), "url", "left")
            .select(
                F.coalesce("stage", F.when(F.col("is_ai_topic").isNotNull(), "stored"), F.lit("duplicate")).alias("stage"),
                "is_ai_topic",
            )
            .unionByName(new_failures.select(F.lit("fetch_failed").alias("stage"), F.lit(None).cast("boolean").alias("is_ai_topic")))
        )
        counters = run_counters(tagged).first().asDict()
    except Exception as error:
        store.append_run_event(
            store.run_event(spark, config.batch_id, config.as_of, "failed", seconds=time.monotonic() - begun,
                            error=str(error)), paths["runs"])
        raise
    seconds = time.monotonic() - begun
    store.append_run_event(
        store.run_event(spark, config.batch_id, config.as_of, "completed", counters, seconds), paths["runs"]
    )
    for table in ("processed", "runs", "pending"):
        store.drop_expired(spark, paths[table], config.as_of, config.retention_days)
    members.drop_expired_filters(spark, paths["processed"], config.as_of, config.retention_days)
    return {**counters, "seconds": seconds}

