import datetime as dt

import pytest
from pyspark.sql import functions as F

from presslake.operators import feed, quality

AS_OF = dt.datetime(2024, 1, 1, 12)


def feed_rows(spark, rows):
    return spark.createDataFrame(rows, "id int, url string, title string, seendate string, domain string, language string")


def test_feed_window_text_and_time_agree(spark):
    seen = ["20240101T095959Z", "20240101T100000Z", "20240101T120000Z", "20240101T120001Z"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seen)], "id int, seendate string")
    for compact in (False, True):
        assert [r.id for r in feed.feed_window(df, AS_OF, compact=compact).orderBy("id").collect()] == [1, 2]
    iso = spark.createDataFrame([(0, "2024-01-01T11:00:00Z"), (1, "bad")], "id int, seendate string")
    assert [r.id for r in feed.feed_window(iso, AS_OF).collect()] == [0]


def test_compact_window_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("20240101T100000Z",)], "seendate string").write.parquet(str(tmp_path / "f"))
    plan = feed.feed_window(spark.read.parquet(str(tmp_path / "f")), AS_OF, compact=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seendate" in text


def test_required_and_language(spark):
    rows = [(1, "u", "t", "s", "a.com", "en"), (2, "", "t", "s", "a.com", "en"), (3, "u", None, "s", "a.com", "EN"),
            (4, "u", "t", "s", "a.DK", "French"), (5, "u", "t", "s", "a.com", "Danish"), (6, "u", "t", "s", "a.com", "EN"),
            (7, "u", "t", "s", "a.com", None)]
    df = feed_rows(spark, rows)
    assert [r.id for r in feed.feed_required(df).orderBy("id").collect()] == [1, 4, 5, 6, 7]
    assert [r.id for r in feed.language_filter(df).orderBy("id").collect()] == [1, 2, 4, 5, 7]


def test_ingest_rank_puts_danish_first(spark):
    df = spark.createDataFrame([(1, "a.com"), (2, "b.dk"), (3, "c.com"), (4, "d.dk")], "p int, domain string")
    got = [r.p for r in feed.with_ingest_rank(df, "p").orderBy("ingest_rank").collect()]
    assert got == [2, 4, 1, 3]


def test_domain_gate_precedence(spark):
    hosts = ["cnn.com", "us.cnn.com", "notcnn.com", "jp.reuters.com", "x.youtube.com.reuters.com", "blog.example", "failed.bbc.com"]
    df = spark.createDataFrame([(i, f"https://{h}/p") for i, h in enumerate(hosts)], "id int, url string")
    failed = spark.createDataFrame([("failed.bbc.com",), ("failed.bbc.com",)], "domain string")
    strict = {r.host: r.gate_reason for r in feed.domain_gate(df, failed).collect()}
    assert strict == {
        "cnn.com": "reliable", "us.cnn.com": "reliable", "notcnn.com": "not_listed", "jp.reuters.com": "japanese",
        "x.youtube.com.reuters.com": "problematic", "blog.example": "not_listed", "failed.bbc.com": "failed_domain",
    }
    loose = {r.host: r.gate_reason for r in feed.domain_gate(df, strict=False).collect()}
    assert loose["notcnn.com"] == "reliable" and loose["failed.bbc.com"] == "reliable"


def test_domain_category(spark):
    df = spark.createDataFrame([("bbc.com",), ("WWW.BBC.com",), ("news.bbc.com",), ("abcnews.go.com",), ("x.example",), (None,)], "domain string")
    out = feed.with_domain_category(df)
    got = [r.domain_category for r in out.collect()]
    assert got == ["journalism, news and media"] * 4 + ["Other"] * 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_domain_category_exact_before_first_listed(spark):
    rows = [("a.com", "one"), ("x.a.com", "two"), ("y.x.a.com", "three")]
    df = spark.createDataFrame([("x.a.com",), ("z.x.a.com",), ("y.x.a.com",)], "domain string")
    got = {r.domain: r.domain_category for r in feed.with_domain_category(df, rows).collect()}
    assert got == {"x.a.com": "two", "z.x.a.com": "one", "y.x.a.com": "three"}


def test_article_record_falls_back_to_the_address(spark):
    df = spark.createDataFrame([("https://www.bbc.com/1", "t", "s", "", None, None)],
                               "url string, title string, seendate string, domain string, language string, sourcecountry string")
    r = feed.article_record(df, AS_OF).first()
    assert (r.domain, r.language, r.source_country, r.gdelt_id) == ("www.bbc.com", "en", "", r.url)
    assert r.domain_category == "journalism, news and media"


def test_is_danish_and_quota(spark):
    df = spark.createDataFrame([("dr.dk", "en"), ("www.dr.dk", "en"), ("a.com", "DA"), ("a.com", None)], "domain string, language string")
    assert [r.d for r in df.select(feed.is_danish().alias("d")).collect()] == [True, False, True, False]
    gap = feed.quota_gap(df, 11).first()
    assert (gap.have_danish, gap.have_other, gap.missing_danish, gap.missing_other) == (2, 2, 3, 4)
    assert feed.quota_gap(df, 4).first().missing_danish == 0


LONG = "x" * 700


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"url": None}, "missing_url"), ({"title": "  "}, "missing_title"), ({"published_at": ""}, "missing_date"),
    ({"text": " \n"}, "blank_text"), ({"text": "x" * 699}, "text_too_short"), ({"text": "æ" * 700}, None),
    ({"url": "ftp://x"}, "invalid_url"), ({"text": ""}, "text_too_short"), ({"text": None, "title": "t" * 600}, None),
])
def test_validate(spark, change, reason):
    row = {"url": "https://a.com/1", "title": "t", "text": LONG, "published_at": "d", "domain": "a.com", **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = quality.validate(df).first()
    assert got.reject_reason == reason
    assert got.rejection_reason == ("validation_failed" if reason else None)


def test_valid_and_rejected_split_the_input(spark):
    df = spark.range(100).select(
        F.concat(F.lit("https://a.com/"), F.col("id").cast("string")).alias("url"), F.lit("t").alias("title"),
        F.repeat(F.lit("x"), F.col("id").cast("int") * 10).alias("text"), F.lit("d").alias("published_at"), F.lit("a.com").alias("domain"),
    )
    checked = quality.validate(df)
    good = {r.url for r in quality.valid_rows(checked).collect()}
    bad = {r.url for r in quality.rejected_rows(checked).collect()}
    assert not good & bad and len(good | bad) == 100 and len(good) == 30


def failure_rows(spark, counts):
    rows = [(d, "fetch_error: %d" % i if i % 2 else "no_articles_found", dt.datetime(2024, 1, 1, 0, i), "b")
            for d, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "domain string, reason string, at timestamp, batch_id string")


def test_failure_counting(spark):
    rows = failure_rows(spark, {"four.com": 4, "five.com": 5})
    got = {r.domain: r for r in quality.domain_failures(rows).collect()}
    assert not got["four.com"].is_failed and got["five.com"].is_failed
    assert [(x.kind, x.n) for x in got["five.com"].reasons] == [("fetch_error", 2), ("no_articles_found", 3)]
    assert [r.domain for r in quality.failed_domains(rows).collect()] == ["five.com"]
    odd = spark.createDataFrame([("a.com", "dns_timeout: x", dt.datetime(2024, 1, 1), "b"), ("a.com", None, dt.datetime(2024, 1, 2), "b")], rows.schema)
    assert [(x.kind, x.n) for x in quality.domain_failures(odd).first().reasons] == [("dns_timeout", 1), ("text_extraction_failed", 1)]
    report = quality.failure_report(rows).first()
    assert (report.tracked_domains, report.failed_domains, report.total_failures, report.batch_seconds) == (2, 1, 9, 240.0)


def test_failure_sources(spark):
    at = F.lit(AS_OF)
    pages = spark.createDataFrame([("https://a.com/1", None), ("https://b.com/1", "x" * 10), ("https://c.com/1", LONG)], "url string, text string")
    got = {r.domain: r.reason for r in quality.extraction_failures(pages, at, "b").collect()}
    assert got == {"a.com": "text_extraction_failed", "b.com": "text_too_short_before_processing"}
    names = lambda *d: spark.createDataFrame([(x,) for x in d], "domain string")
    got = {r.domain: r.reason for r in quality.empty_scans(names("a", "b", "c"), names("b", "c", "c"), names("c"), at, "b").collect()}
    assert got == {"a": "no_articles_found", "b": "no_valid_articles"}


def test_drop_failed_domains(spark):
    df = spark.createDataFrame([(1, "https://a.com/1"), (2, ""), (3, "https://b.com/1"), (4, "nonsense")], "id int, url string")
    failed = spark.createDataFrame([("b.com",)], "domain string")
    assert sorted(r.id for r in feed.drop_failed_domains(df, failed, "id").collect()) == [1, 4]
