import datetime as dt

import pytest
from pyspark.sql import functions as F

from presslake import dims
from presslake.operators import analytics, browse, enrich, trends

AS_OF = dt.datetime(2024, 1, 17, 15)
SCHEMA = ("url string, title string, domain string, domain_category string, language string, source_country string, "
          "processed_at timestamp, ai_topic_detected boolean, ai_topic string")


@pytest.fixture(scope="module")
def stored(spark):
    at = lambda *a: dt.datetime(2024, *a)
    rows = [
        ("u1", "A", "cnn.com", "photography", "en", "US", at(1, 17, 9), True, "AI Computer Vision"),
        ("u2", "a ", "us.cnn.com", "photography", "en", "US", at(1, 17, 10), True, "AI Computer Vision"),
        ("u3", "B", "dr.dk", "unknown", "da", "DK", at(1, 15, 9), True, "None"),
        ("u4", "C", "dr.dk", "graphic design and visual communication", "da", "DK", at(1, 1, 9), True, "AI Ethics and Regulations"),
        ("u5", "D", "bbc.com", None, "en", None, at(1, 16, 9), False, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_dashboard_stats(spark, stored):
    r = analytics.dashboard_stats(stored, AS_OF, 7).first()
    assert (r.recent_articles, r.unique_domains, r.ai_topic_percentage, r.days_analyzed) == (4, 4, 75.0, 7)
    empty = analytics.dashboard_stats(stored.limit(0), AS_OF).first()
    assert (empty.recent_articles, empty.ai_topic_percentage) == (0, 0.0)
    assert analytics.dashboard_stats(stored, AS_OF, 7, approximate=True).first().unique_domains == 4


def test_counts(spark, stored):
    assert [tuple(r) for r in analytics.count_by(stored, "language").collect()] == [("en", 3), ("da", 2)]
    assert tuple(analytics.totals(stored).first()) == (5, 4)
    assert analytics.high_water_mark(stored).first()[0] == dt.datetime(2024, 1, 17, 10)


def test_distributions(spark, stored):
    assert as_dict(analytics.topic_distribution(stored, "en")) == {"Computer Vision": 1, "Ethics and Regulations": 1}
    assert as_dict(analytics.topic_distribution(stored, "da", limit=2)) == {"Computervision": 1}
    assert as_dict(analytics.category_distribution(stored, "en")) == {"Photography": 2, "Other": 2}
    fixed = as_dict(analytics.category_distribution(stored, "da", fix_missing=True))
    assert fixed == {"Fotografi": 2, "Andet": 1, "Grafisk design og visuel kommunikation": 1}


def test_facets_and_browse(spark, stored):
    got = [tuple(r) for r in analytics.facets(stored).collect()]
    assert got == [("category", "graphic design and visual communication"), ("category", "other"), ("category", "photography"),
                   ("topic", "AI Computer Vision"), ("topic", "AI Ethics and Regulations"), ("topic", "other")]
    urls = lambda df: sorted(r.url for r in df.collect())
    assert urls(browse.browse(stored)) == ["u1", "u2", "u3", "u4", "u5"]
    assert urls(browse.browse(stored, "other")) == ["u3", "u5"]
    assert urls(browse.browse(stored, "photography", "AI Computer Vision")) == ["u1", "u2"]
    assert urls(browse.browse(stored, topic="other")) == ["u3", "u5"]


def test_lists_and_pages(spark, stored):
    order = ["u2", "u1", "u5", "u3", "u4"]
    assert [r.url for r in browse.recent_articles(stored, 3).collect()] == order[:3]
    assert [r.url for r in browse.browse_page(stored, 2, 2).collect()] == order[2:4]
    last = browse.browse_page(stored, 1, 2).collect()[-1]
    assert [r.url for r in browse.browse_after(stored, last.processed_at.replace(tzinfo=dt.timezone.utc), last.url, 2).collect()] == order[2:4]
    assert tuple(browse.page_count(stored, 2).first()) == (5, 3)
    plan = browse.recent_articles(stored)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_trends(spark, stored):
    hour = {r.bucket: r.n for r in trends.trend(stored, "hour", AS_OF).collect()}
    assert len(hour) == 24 and hour[9] == hour[10] == 1 and sum(hour.values()) == 2
    day = {r.label: r.n for r in trends.trend(stored, "day", AS_OF, "da").collect()}
    assert day["Mandag"] == 1 and day["Tirsdag"] == 1 and day["Onsdag"] == 2 and len(day) == 7
    week = {r.label: r.n for r in trends.trend(stored, "week", AS_OF, "en").collect()}
    assert week == {"Week 1": 1, "Week 2": 0, "Week 3": 4, "Week 4": 0}
    month = {r.label: r.n for r in trends.trend(stored, "month", AS_OF, "da").collect()}
    assert month["Januar"] == 5 and len(month) == 12
    assert [(r.label, r.n) for r in trends.trend(stored, "year", AS_OF, years=2).orderBy("bucket").collect()] == [("2023", 0), ("2024", 5)]
    rolled = trends.time_rollup(stored, ["month", "day"], dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))
    assert rolled.filter("month IS NULL AND day IS NULL").first().n == 5 and rolled.count() == 1 + 1 + 4


def test_daily_statistics_and_rates(spark, stored):
    runs = spark.createDataFrame(
        [("r1", dt.datetime(2024, 1, 17, 1), "completed", 10, 8, 2, 4, 3600.0), ("r2", dt.datetime(2024, 1, 17, 3), "running", 0, 0, 0, 0, 100.0)],
        "run_id string, started_at timestamp, status string, fetched long, stored long, rejected long, ai_topic_count long, seconds double")
    got = {str(r.date): r for r in analytics.daily_statistics(stored, runs).collect()}
    r = got["2024-01-17"]
    assert (r.total_articles, r.unique_domains, r.languages_count, r.countries_count) == (2, 2, 1, 1)
    assert r.ai_topic_percentage == 100.0 and r.processing_time_avg == 1850.0 and got["2024-01-16"].processing_time_avg == 0.0
    rates = analytics.run_rates(runs).first()
    assert (rates.runs, rates.articles_per_hour, rates.success_rate, rates.rejection_rate, rates.detection_rate) == (1, 8.0, 80.0, 20.0, 50.0)


def test_batch_summary_and_keywords(spark):
    df = spark.createDataFrame(
        [(True, "A", ["x", "y"]), (True, None, ["y", "z"]), (False, "A", ["x", "x"]), (None, None, None)],
        "is_ai_topic boolean, topic string, keywords array<string>").select(F.struct("*").alias("analysis"))
    assert as_dict(analytics.topic_counts(df)) == {"A": 1}
    assert tuple(analytics.batch_summary(df).first()) == (4, 2, 50.0)
    assert [tuple(r) for r in analytics.top_keywords(df, 2).collect()] == [("y", 2), ("x", 1)]


def test_run_counters(spark):
    stages = ["fetch_failed", "processing_failed", "rejected", "rejected", "duplicate", "stored", "stored", "storage_failed"]
    df = spark.createDataFrame([(s, i == 5) for i, s in enumerate(stages)], "stage string, is_ai_topic boolean")
    r = analytics.run_counters(df).first()
    assert (r.fetched, r.validated, r.stored, r.rejected, r.ai_topic_count) == (7, 4, 2, 3, 1)
    assert (r.failed_fetching, r.failed_processing, r.failed_validation, r.failed_storage) == (1, 1, 2, 1)


def test_cards(spark):
    rows = [("T", None, "", "u", "d", None, "0.5", '["a","b"]', "unknown", "Null", "en"),
            (None, "OpenAI: why", "OpenAI: hvorfor", None, None, "p", "bad", "{oops", "x", "AI Computer Vision", None)]
    df = spark.createDataFrame(rows, "title string, summary_en string, summary_da string, url string, domain string, published_at string, "
                               "ai_confidence string, ai_keywords string, domain_category string, ai_topic string, language string")
    df = df.withColumn("processed_at", F.lit("x"))
    a, b = enrich.article_cards(df, "da").collect()
    assert (a.summary_en, a.summary_da, a.ai_confidence, a.ai_keywords) == ("No AI explanation available",) * 2 + (0.5, ["a", "b"])
    assert (a.domain_category, a.ai_topic) == ("other", "other")
    assert (b.title, b.url, b.domain, b.language) == ("No title", "", "Unknown", "Unknown")
    assert (b.summary_en, b.summary, b.ai_confidence, b.ai_keywords) == ("why", "hvorfor", 0.0, [])


def test_store_projection_falls_back(spark):
    analysis = "struct<is_ai_topic:boolean,confidence:double,topic:string,explanation:string,keywords:array<string>>"
    df = spark.createDataFrame([
        ("u", (True, 0.7, "T", "why", ["k"]), "", None, None, 0.0, [], None, dt.datetime(2024, 1, 1)),
        ("v", (True, 0.7, "T", "why", ["k"]), "en", "da", "own", 0.1, ["o"], dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)),
        ("w", None, None, None, None, None, None, None, None),
    ], f"url string, analysis {analysis}, summary_en string, summary_da string, ai_topic string, ai_confidence double, "
       "ai_keywords array<string>, processed_at timestamp, downloaded_at timestamp")
    for c in ("title", "domain", "domain_category", "language", "source_country", "gdelt_id", "extraction_method", "published_at", "batch_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    u, v, w = enrich.store_projection(df, F.lit(dt.datetime(2025, 1, 1))).collect()
    assert (u.summary_en, u.summary_da, u.ai_topic, u.ai_confidence, u.ai_keywords, u.processed_at.year, u.processed_at.day) == ("why", "why", "T", 0.7, ["k"], 2024, 1)
    assert (v.summary_en, v.summary_da, v.ai_topic, v.ai_confidence, v.ai_keywords, v.processed_at.day) == ("en", "da", "own", 0.1, ["o"], 2)
    assert (w.ai_topic_detected, w.summary_da, w.ai_keywords, w.processed_at.year, w.domain_category, w.title) == (False, "", [], 2025, "unknown", "")


@pytest.mark.parametrize("kind,value,lang,label", [
    ("topic", "AI Computer Vision", "da", "Computervision"), ("topic", "Unknown Topic", "en", "Other"), ("topic", "made up", "da", "Andet"),
    ("category", "strategic communication and PR", "en", "Strategic Communication and PR"), ("category", "UNKNOWN", "da", "Andet"),
    ("category", "graphic design and visual communication", "en", "Other"), ("category", None, "en", "Other"),
])
def test_labels(spark, kind, value, lang, label):
    df = spark.createDataFrame([(value,)], "v string")
    assert enrich.with_label(df, "v", kind, lang, "label").first().label == label


def test_every_topic_and_category_has_a_label(spark):
    df = spark.createDataFrame([(c,) for c in dims.CATEGORY_DOMAINS], "v string")
    assert enrich.with_label(df, "v", "category", "da", "label", fix_missing=True).filter("label = 'Andet'").count() == 0
