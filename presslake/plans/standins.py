"""The given tables in the shapes this library works on: feed, articles, runs, failures and responses.

Everything is computed from whole tables. Times come from ids, so results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslake.functions import urls
from presslake.operators import classify, dedup, extract, feed

START = 1704067200  # 2024-01-01 00:00:00 UTC
CATEGORIES = [
    ("src0.example.com", "journalism, news and media"),
    ("src1.example.com", "journalism, news and media"),
    ("src2.example.com", "photography"),
    ("src3.example.com", "graphic design and visual communication"),
    ("src4.example.com", "web and UX design"),
    ("src5.example.com", "film and TV production"),
    ("src6.example.com", "strategic communication and PR"),
    ("src7.example.com", "unknown"),
]
PAGE_CATEGORIES = [
    ("example.com", "journalism, news and media"),
    ("example.net", "film and TV production"),
    ("tionsh.example.net", "photography"),
    ("ththin.example.com", "digital media and content creation"),
    ("blog.ththan.example.net", "advertising and commercial"),
]
TERMS = ["the", "and", "that", "with", "der", "und", "que", "les"]
RULES = [("AI Language Models and NLP", ["der", "und"]), ("AI Business and Industry", ["que", "les"])]
CLASSIFIER = {"core": TERMS, "keywords": TERMS, "rules": RULES}
RELIABLE = ["example.com", "example.net"]
PROBLEMATIC = ["cheap-pills", "free-bets", "adult-x", "casino-win"]
JAPANESE = ["ththre", "ththed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd'T'HHmmss'Z'")


def show_time(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: title = first line, one article per hour."""
    at = F.timestamp_seconds(F.lit(START) + F.col("doc_id") * 3600)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.col("lang").alias("language"),
        F.upper("lang").alias("source_country"),
        at.alias("processed_at"),
        compact(at).alias("published_at"),
        F.col("doc_id").alias("ingest_rank"),
    )


def site_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles spread over five base domains."""
    site = F.concat(F.lit(".site"), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit(".com"))
    return articles(spark, sf_dir).withColumn("domain", F.concat(F.substring_index("domain", ".", 1), site))


def chained_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of several sites; then a row for each that shares its address only; then one that shares only that row's title."""
    rows = site_articles(spark, sf_dir).select("doc_id", "url", "domain", "title")
    own = F.concat(F.lit("Copy "), F.col("doc_id").cast("string"))
    parts = [
        rows, rows.withColumn("title", own),
        rows.withColumns({"title": own, "url": F.concat("url", F.lit("#again"))}),
    ]
    ranked = [p.select((F.col("doc_id") + F.lit(k << 40)).alias("ingest_rank"), "url", "domain", "title") for k, p in enumerate(parts)]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_keywords(articles(spark, sf_dir), **CLASSIFIER)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as they are stored: classified, flattened, with a domain category and no text."""
    flat = classify.flatten_analysis(classified(spark, sf_dir)).withColumn("summary_da", F.col("summary_en"))
    return feed.with_domain_category(flat.drop("text"), CATEGORIES)


def labelled(spark: SparkSession, sf_dir: str, toxic: int | None = None) -> DataFrame:
    """Articles that have a label, the stand-in for what earlier runs stored."""
    labels = table(spark, sf_dir, "labels")
    ids = labels if toxic is None else labels.filter(F.col("toxic") == toxic)
    return articles(spark, sf_dir).join(ids.select("doc_id"), "doc_id", "left_semi")


def own_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under addresses of their own: some share one with another page, and there each page is an article."""
    own = F.concat("url", F.lit("#page-"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").withColumn("url", own)


def given_address(url: str) -> Column:
    """The address that `own_addresses` has made one of a page's own."""
    return F.regexp_replace(url, "#page-[0-9]+$", "")


def page_feed(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Pages as feed rows with their source, one per minute."""
    return extract.page_title(table(spark, sf_dir, "pages") if pages is None else pages).select(
        "page_id", "url", "title",
        compact(F.timestamp_seconds(F.lit(START) + F.col("page_id") * 60)).alias("seendate"),
        urls.url_authority("url").alias("domain"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"),
        F.lit("").alias("sourcecountry"),
        "html",
        F.col("page_id").alias("ingest_rank"),
    )


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_text(page_feed(spark, sf_dir))


def mixed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, then documents, as one list of (ingest_rank, url, domain, title)."""
    columns = ["ingest_rank", "url", "domain", "title"]
    later = articles(spark, sf_dir).withColumn("ingest_rank", F.col("ingest_rank") + F.lit(1 << 40))
    return page_feed(spark, sf_dir).select(*columns).unionByName(later.select(*columns))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = (
        F.when(F.col("value") < 5, "text_extraction_failed")
        .when(F.col("value") < 10, "text_too_short_before_processing")
        .otherwise(F.concat(F.lit("fetch_error: "), "props"))
    )
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"),
        reason.alias("reason"),
        F.col("ts").cast("timestamp").alias("at"),
        F.date_format("ts", "yyyyMMdd").alias("batch_id"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one run per user and day; sign-ups start it, purchases complete it, errors fail it."""
    status = F.when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "purchase", "completed")
    scaled = lambda f: F.floor(F.col("value") * f).cast("bigint")
    return table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase', 'error')").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.col("ts").cast("timestamp").alias("at"),
        status.otherwise("failed").alias("status"),
        scaled(10).alias("fetched"), scaled(8).alias("validated"), scaled(6).alias("stored"),
        (scaled(10) - scaled(8)).alias("rejected"), scaled(2).alias("ai_topic_count"),
        F.col("value").alias("seconds"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


def label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed JSON answers: one per label, wrapped in prose for toxic ones."""
    answer = F.to_json(F.struct(
        (F.col("quality") == 1).alias("is_ai_topic"),
        F.when(F.col("quality") == 1, 0.9).alias("confidence"),
        F.when(F.col("quality") == 1, "AI Computer Vision").alias("topic"),
        F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("explanation"),
        F.array(F.lit("vision"), F.lit("image")).alias("keywords"),
    ))
    text = F.when(F.col("toxic") == 1, F.concat(F.lit("Here it is: "), answer, F.lit(" Done."))).otherwise(answer)
    return table(spark, sf_dir, "labels").select("doc_id", text.alias("response_text"))


def chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed prose answers: the last assistant turn of each conversation."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("text", "turn").alias("response_text"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per article: the JSON answer where there is one, else the prose."""
    json = label_responses(spark, sf_dir)
    prose = chat_responses(spark, sf_dir).join(json, "doc_id", "left_anti")
    ids = articles(spark, sf_dir).select("doc_id", "url")
    return ids.join(json.unionByName(prose), "doc_id").select("url", "response_text")


def summary_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return articles(spark, sf_dir).join(good, "doc_id").select(
        F.col("url").alias("cache_key"), F.concat(F.lit("Resumé "), F.col("doc_id").cast("string")).alias("summary")
    )


def overview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One overview page per document, with its text nested in the block that the address names."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = lambda cls, inner: F.concat(F.lit(f'<div class="{cls}">'), inner, F.lit("</div>"))
    html = F.concat(
        F.lit('<html><body><div id="news-feed-0x"><div class="news-band__content">another entry</div></div>'),
        F.lit('<div id="news-feed-'), F.col("doc_id").cast("string"), F.lit('">'),
        block("band", F.concat(block("band__head", F.lit("head")), block("news-band__content", escaped))),
        F.lit("</div><div>tail</div></body></html>"),
    )
    return articles(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("https://journalisten.dk/nyhedsoverblik?news_band_id="), F.col("doc_id").cast("string")).alias("url"),
        F.lit("journalisten.dk").alias("domain"),
        html.alias("html"),
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.known_urls(labelled(spark, sf_dir, 0), labelled(spark, sf_dir, 1))
