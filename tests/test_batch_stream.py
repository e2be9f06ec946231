import datetime as dt

import pytest
from pyspark.sql import functions as F

from presslake import schemas
from presslake.operators import dedup
from presslake.plans.batch import BatchConfig, run_batch
from presslake.sources import readers, store
from presslake.streaming import ingest

AS_OF = dt.datetime(2024, 1, 1, 12)
AI = "Machine learning, deep learning and a neural network by openai. "
FEED = "position long, url string, title string, seendate string, domain string, language string, sourcecountry string"


def html(text, title="Head"):
    return f"<html><body><article><h1>{title}</h1><p>{text}</p></article></body></html>"


def inputs(spark, start=0):
    seen = "20240101T113000Z"
    feed = [
        ("https://www.bbc.com/ai", "AI story", seen, "bbc.com", "English", "GB"),
        ("https://news.bbc.com/ai", " ai STORY", seen, "news.bbc.com", "en", "GB"),
        ("https://dr.dk/vejr", "Vejret", seen, "dr.dk", "whatever", "DK"),
        ("https://cnn.com/short", "Short", seen, "cnn.com", "en", "US"),
        ("https://cnn.com/none", "No page", seen, "cnn.com", "en", "US"),
        ("https://cnn.com/blank", "  ", seen, "cnn.com", "en", "US"),
        ("https://cnn.com/fr", "French", seen, "cnn.com", "French", "US"),
        ("https://unknown.example/x", "Unlisted", seen, "unknown.example", "en", "US"),
        ("https://cnn.com/old", "Old", "20240101T090000Z", "cnn.com", "en", "US"),
        ("https://dr.dk/vejr", "Vejret igen", seen, "dr.dk", "da", "DK"),
    ]
    pages = [
        ("https://www.bbc.com/ai", html(AI * 20)), ("https://news.bbc.com/ai", html(AI * 20)),
        ("https://dr.dk/vejr", html("sol og regn " * 80)), ("https://cnn.com/short", html("x " * 100)),
        ("https://cnn.com/blank", html(AI * 20)), ("https://cnn.com/fr", html(AI * 20)), ("https://cnn.com/old", html(AI * 20)),
    ]
    return (spark.createDataFrame([(start + i, *r) for i, r in enumerate(feed)], FEED),
            spark.createDataFrame(pages, "url string, html string"))


def tables(spark, root):
    read = lambda n, s: readers.read_table(spark, f"{root}/{n}", s)
    return {"processed": read("processed", schemas.STORED), "rejected": read("rejected", schemas.STORED_REJECTED),
            "failures": read("failures", schemas.FAILURE), "runs": store.runs_current(read("runs", schemas.RUN_EVENT))}


def contents(spark, root):
    t = tables(spark, root)
    return (sorted(tuple(r) for r in t["processed"].select("url", "title", "ai_topic_detected", "summary_da", "batch_id").collect()),
            sorted(r.url for r in t["rejected"].collect()), sorted((r.domain, r.reason) for r in t["failures"].collect()))


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    feed, pages = inputs(spark)
    return root, run_batch(spark, feed, pages, root, BatchConfig(AS_OF, "0001"))


def test_one_batch(spark, first):
    root, counters = first
    assert (counters["fetched"], counters["validated"], counters["stored"], counters["rejected"], counters["ai_topic_count"]) == (3, 2, 2, 1, 1)
    t = tables(spark, root)
    got = {r.url: r for r in t["processed"].collect()}
    assert set(got) == {"https://www.bbc.com/ai", "https://dr.dk/vejr"}
    story = got["https://www.bbc.com/ai"]
    assert story.ai_topic == "AI Business and Industry" and story.ai_topic_detected and story.domain_category == "journalism, news and media"
    assert story.summary_en == "Fallback classification: 4 AI terms found" == story.summary_da
    assert got["https://dr.dk/vejr"].title == "Vejret"
    assert [r.url for r in t["rejected"].collect()] == ["https://cnn.com/blank"]
    # A page that has not landed is no failure.
    assert sorted((r.domain, r.reason) for r in t["failures"].collect()) == [("cnn.com", "text_too_short_before_processing")]
    assert counters["failed_fetching"] == 1
    assert [r.url for r in readers.read_table(spark, f"{root}/pending", schemas.PENDING).filter("waits").collect()] == ["https://cnn.com/none"]
    run = t["runs"].first()
    assert (run.run_id, run.status, run.stored) == ("0001", "completed", 2)
    stored_json = spark.read.json(f"{root}/articles_json")
    assert stored_json.count() == 2 and stored_json.filter("length(text) >= 700 AND analysis.keywords IS NOT NULL").count() == 2


def test_the_same_batch_again_changes_nothing(spark, first):
    root, counters = first
    before = contents(spark, root)
    feed, pages = inputs(spark)
    again = run_batch(spark, feed, pages, root, BatchConfig(AS_OF, "0001"))
    assert contents(spark, root) == before
    assert {k: v for k, v in again.items() if k != "seconds"} == {k: v for k, v in counters.items() if k != "seconds"}


def test_the_next_batch_skips_what_is_known(spark, first):
    root, _ = first
    before = contents(spark, root)
    feed, pages = inputs(spark)
    extra = spark.createDataFrame([(99, "https://edition.bbc.com/ai2", "AI STORY", "20240101T113000Z", "edition.bbc.com", "en", "GB")], FEED)
    more = spark.createDataFrame([("https://edition.bbc.com/ai2", html(AI * 30))], "url string, html string")
    counters = run_batch(spark, feed.union(extra), pages.union(more), root, BatchConfig(AS_OF, "0002"))
    assert counters["stored"] == 0 and counters["rejected"] == 0
    assert contents(spark, root)[:2] == before[:2]


def test_a_batch_leaves_no_stages(spark, tmp_path):
    from pathlib import Path

    from presslake.session import shared_dir

    stages = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("presslake/*/stage-*")}
    before = stages()
    feed, pages = inputs(spark)
    assert run_batch(spark, feed, pages, str(tmp_path), BatchConfig(AS_OF, "0001"))["stored"] == 2
    assert stages() == before
    with pytest.raises(Exception):
        run_batch(spark, feed.drop("url"), pages, str(tmp_path), BatchConfig(AS_OF, "0002"))
    assert stages() == before


def test_a_failed_batch_is_logged(spark, tmp_path):
    feed, _ = inputs(spark)
    with pytest.raises(Exception):
        run_batch(spark, feed, spark.createDataFrame([(1,)], "no_url int"), str(tmp_path), BatchConfig(AS_OF, "0009"))
    run = tables(spark, str(tmp_path))["runs"].first()
    assert run.status == "failed" and "url" in run.error


def test_blacklisted_domain_is_skipped(spark, tmp_path):
    feed, pages = inputs(spark)
    past = spark.createDataFrame([("bbc.com", "no_articles_found", "0000")] * 5, "domain string, reason string, batch_id string")
    store.append_batch(past.withColumn("at", F.lit(AS_OF)), f"{tmp_path}/failures", "at")
    counters = run_batch(spark, feed, pages, str(tmp_path), BatchConfig(AS_OF, "0001"))
    kept = {r.url for r in tables(spark, str(tmp_path))["processed"].collect()}
    assert kept == {"https://news.bbc.com/ai", "https://dr.dk/vejr"} and counters["stored"] == 2


def test_a_late_page_is_stored_when_it_lands(spark, tmp_path):
    feed, pages = inputs(spark)
    run_batch(spark, feed, pages, str(tmp_path), BatchConfig(AS_OF, "0001"))
    later, none = AS_OF + dt.timedelta(hours=9), feed.limit(0)
    late = pages.union(spark.createDataFrame([("https://cnn.com/none", html("late words " * 90))], "url string, html string"))
    for batch, landed, stored in (("0002", pages, 0), ("0003", late, 1), ("0004", late, 0), ("0003", late, 1)):
        assert run_batch(spark, none, landed, str(tmp_path), BatchConfig(later, batch))["stored"] == stored
    assert "https://cnn.com/none" in {r.url for r in tables(spark, str(tmp_path))["processed"].collect()}


def test_titles_entries_answers_and_silent_domains(spark, tmp_path):
    seen, entry = "20240101T113000Z", "https://journalisten.dk/nyhedsoverblik?news_band_id=7"
    rows = [
        (1, "https://deadline.com/a", "Deadline", seen, "deadline.com", "en", "US"),
        (2, entry, "Kort nyt", seen, "journalisten.dk", "da", "DK"),
        (3, "https://cnn.com/x", "Plain", seen, "cnn.com", "en", "US"),
    ]
    block = f'<div id="news-feed-7"><div class="news-band__content">{"ord " * 200}</div></div>'
    pages = spark.createDataFrame([
        (rows[0][1], html("film words " * 90, "A real heading")), (rows[0][1], html("film")),
        (entry, f"<html><body><article>{'other ' * 400}</article>{block}</body></html>"), (rows[2][1], html("plain words " * 90)),
    ], "url string, html string")

    def scorer(batch):
        if (batch["url"] == "https://cnn.com/x").any():
            raise RuntimeError("down")
        return batch.assign(response_text='{"is_ai_topic": true, "confidence": 0.6, "topic": "T"}')[["url", "response_text"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        config = BatchConfig(AS_OF, "0001", expected_domains=["cnn.com", "bbc.com"])
        feed = spark.createDataFrame(rows, FEED)
        counters = run_batch(spark, feed, pages, str(tmp_path), config, scorer=scorer)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert counters["stored"] == 3
    t = tables(spark, str(tmp_path))
    got = {r.url: r for r in t["processed"].collect()}
    assert got["https://deadline.com/a"].title == "A real heading" and got["https://deadline.com/a"].ai_confidence == 0.6
    assert got["https://cnn.com/x"].ai_topic_detected is False
    text = spark.read.json(f"{tmp_path}/articles_json").filter(F.col("url") == entry).first().text
    assert text.startswith("ord ord") and "other" not in text
    assert [(r.domain, r.reason) for r in t["failures"].collect()] == [("bbc.com", "no_articles_found")]
    answers = readers.read_table(spark, f"{tmp_path}/responses", schemas.STORED_ANSWER)
    assert [r.scorer_error for r in answers.filter("scorer_error IS NOT NULL").collect()] == ["RuntimeError: down"]
    # A re-run asks only for what is missing and keeps the answers that it has.
    asked = lambda b: b.assign(response_text='{"is_ai_topic": true, "confidence": 0.9}')[["url", "response_text"]]
    run_batch(spark, feed, pages, str(tmp_path), config, scorer=asked)
    again = {r.url: r.ai_confidence for r in tables(spark, str(tmp_path))["processed"].collect()}
    assert again["https://deadline.com/a"] == 0.6 and again["https://cnn.com/x"] == 0.9


def land(spark, df, path, *filters):
    for i, f in enumerate(filters):
        df.filter(f).coalesce(1).write.mode("append").parquet(path)


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    feed, pages = inputs(spark)
    land(spark, feed, f"{tmp_path}/feed", "position < 3", "position >= 3")
    stream = ingest.feed_stream(spark, f"{tmp_path}/feed", schema=feed.schema, max_files=1)
    config = BatchConfig(AS_OF, "-")
    for _ in range(2):  # the second start finds nothing new
        ingest.ingest(stream, lambda s: pages, f"{tmp_path}/root", config, f"{tmp_path}/state", as_of=lambda: AS_OF).awaitTermination()
    whole = f"{tmp_path}/whole"
    run_batch(spark, feed, pages, whole, BatchConfig(AS_OF, "0001", look_back_hours=None))
    strip = lambda c: [r[:-1] for r in c[0]]
    assert strip(contents(spark, f"{tmp_path}/root")) == strip(contents(spark, whole))
    assert contents(spark, f"{tmp_path}/root")[1] == contents(spark, whole)[1]
    assert tables(spark, f"{tmp_path}/root")["runs"].filter("status = 'completed'").count() == 2


def test_stream_keeps_a_backlog_and_survives_a_future_date(spark, tmp_path):
    rows = [
        (1, "https://cnn.com/early", "Early", "20240101T050000Z", "cnn.com", "en", "US"),
        (2, "https://cnn.com/late", "Late", "20240101T113000Z", "cnn.com", "en", "US"),
        (3, "https://cnn.com/never", "Never", "20990101T000000Z", "cnn.com", "en", "US"),
    ]
    feed = spark.createDataFrame(rows, FEED)
    pages = spark.createDataFrame([(r[1], html(AI * 20)) for r in rows], "url string, html string")
    answers = [("https://cnn.com/early", '{"is_ai_topic": false, "confidence": 0.9}', 1), ("https://cnn.com/early", '{"is_ai_topic": true, "confidence": 0.7}', 2)]
    landed = spark.createDataFrame(answers, "url string, response_text string, landed_at int")
    land(spark, feed, f"{tmp_path}/feed", "position < 3", "position = 3")
    stream = ingest.feed_stream(spark, f"{tmp_path}/feed", schema=feed.schema, max_files=1)
    ingest.ingest(stream, lambda s: pages, f"{tmp_path}/root", BatchConfig(AS_OF, "-"), f"{tmp_path}/state", as_of=lambda: AS_OF,
                  responses=lambda s: landed).awaitTermination()
    t = tables(spark, f"{tmp_path}/root")
    assert {r.url: r.ai_confidence for r in t["processed"].collect()}["https://cnn.com/early"] == 0.7
    assert sorted(r.url for r in t["processed"].collect()) == ["https://cnn.com/early", "https://cnn.com/late"]
    assert [r.url for r in t["rejected"].collect()] == ["https://cnn.com/never"]


def test_unique_urls_and_late_rows(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "url string, seendate string")
    path = f"{tmp_path}/feed"
    rows(("u1", "20240101T100000Z"), ("u1", "20240101T101000Z"), ("u2", "20240101T100000Z")).coalesce(1).write.parquet(path)

    def run():
        stream = ingest.feed_stream(spark, path, schema=rows(("x", "y")).schema)
        ingest.append_rows(ingest.unique_urls(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["u1", "u2"]
    rows(("u1", "20240101T110000Z"), ("u3", "20240101T180000Z")).coalesce(1).write.mode("append").parquet(path)
    assert run() == ["u1", "u2", "u3"]
    rows(("u4", "20240101T100000Z"), ("u5", "20240101T181000Z")).coalesce(1).write.mode("append").parquet(path)
    assert run() == ["u1", "u2", "u3", "u5"], "u4 is older than the watermark"


def test_windows_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(minutes=13 * i), "ab"[i % 2]) for i in range(60)], "seen_at timestamp, kind string")
    land(spark, df, f"{tmp_path}/in", "kind = 'a'", "kind = 'b'")
    stream = ingest.feed_stream(spark, f"{tmp_path}/in", schema=df.schema, max_files=1)
    for name, size, slide in (("t", "1 hour", None), ("s", "2 hours", "1 hour")):
        counts = ingest.window_counts(stream, size=size, slide=slide, late=None, by=["kind"])
        ingest.write_totals(counts, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
        want = ingest.window_counts(df, size=size, slide=slide, by=["kind"])
        rows = lambda d: sorted(tuple(r) for r in d.collect())
        assert rows(ingest.read_totals(spark, f"{tmp_path}/{name}", ["window_start", "window_end", "kind"])) == rows(want)


def test_failure_totals_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", AS_OF), ("a", AS_OF), ("b", AS_OF)], "domain string, at timestamp")
    land(spark, df, f"{tmp_path}/in", "domain = 'a'", "domain = 'b'")
    stream = ingest.feed_stream(spark, f"{tmp_path}/in", schema=df.schema, max_files=1)
    ingest.write_totals(ingest.failure_totals(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.domain: r.failures for r in ingest.read_totals(spark, f"{tmp_path}/out", ["domain"]).collect()} == {"a": 2, "b": 1}


def test_totals_change_over_runs(spark, tmp_path):
    df = spark.createDataFrame([("a", AS_OF), ("a", AS_OF), ("b", AS_OF)], "domain string, at timestamp")
    for n in range(2):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.feed_stream(spark, f"{tmp_path}/in", schema=df.schema)
        query = ingest.write_totals(ingest.failure_totals(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    assert {r.domain: r.failures for r in ingest.read_totals(spark, f"{tmp_path}/out", ["domain"]).collect()} == {"a": 4, "b": 2}
    rates = ingest.progress_rates(spark, query).collect()
    assert sum(r.input_rows for r in rates) == 3 and all(r.seconds >= 0 for r in rates)


def test_a_view_of_recent_days_reads_only_their_folders(spark, first):
    from presslake.plans.views import stored_tables

    recent = stored_tables(spark, first[0], AS_OF, 7)["processed_articles"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and recent.count() == 2
    assert stored_tables(spark, first[0], AS_OF + dt.timedelta(days=40), 7)["processed_articles"].count() == 0


def test_views_answer_monitoring_sql(spark, first):
    from presslake.plans.views import VIEWS, register_views

    register_views(spark, first[0])
    rows = spark.sql("SELECT domain_category, COUNT(*) AS n FROM processed_articles WHERE ai_topic_detected GROUP BY domain_category").collect()
    assert [tuple(r) for r in rows] == [("journalism, news and media", 1)]
    assert spark.sql("SELECT COUNT(DISTINCT url) FROM processed_articles WHERE processed_at >= timestamp'2024-01-01' - INTERVAL 7 DAYS").first()[0] == 2
    run = spark.sql("SELECT * FROM pipeline_runs ORDER BY run_started_at DESC, id LIMIT 1").first()
    assert (run.id, run.status, run.articles_stored) == ("0001", "completed", 2)
    assert spark.sql("SELECT total_articles FROM daily_statistics").first()[0] == 2
    assert all(spark.table(v).columns for v in VIEWS)
    register_views(spark, first[0], AS_OF + dt.timedelta(days=31))
    assert spark.table("processed_articles").count() == 0 == spark.table("pipeline_runs").count()


def test_keyed_tables_and_filters_store_the_same(spark, tmp_path):
    """Three batches, the second one repeated, in plain tables and in bucketed ones with filters; views show the same rows."""
    from presslake.plans.views import stored_tables

    feed, pages = inputs(spark)
    extra = spark.createDataFrame([(99, "https://edition.bbc.com/new", "Another", "20240101T113000Z", "edition.bbc.com", "en", "GB")], FEED)
    more = spark.createDataFrame([("https://edition.bbc.com/new", html(AI * 30))], "url string, html string")
    shown = []
    for name, layout in (("plain", {}), ("keyed", {"key_buckets": 3, "member_filters": True})):
        root = str(tmp_path / name)
        counters = [run_batch(spark, f, p, root, BatchConfig(AS_OF, b, **layout)) for b, f, p in (
            ("0001", feed, pages), ("0002", feed.union(extra), pages.union(more)), ("0002", feed.union(extra), pages.union(more)), ("0003", feed, pages))]
        views = stored_tables(spark, root, AS_OF)
        articles = views["processed_articles"]
        assert ("Bucketed: true" in articles._jdf.queryExecution().executedPlan().toString()) == (name == "keyed")
        shown.append((contents(spark, root), sorted(tuple(map(str, r)) for r in articles.drop("file_stored_in").collect()),
                      [{k: v for k, v in c.items() if k != "seconds"} for c in counters]))
    assert shown[0] == shown[1] and [c["stored"] for c in shown[0][2]] == [2, 1, 1, 0]


def test_translations_are_asked_for_once_and_kept(spark, tmp_path):
    feed, pages = inputs(spark)
    said = str(tmp_path / "said")

    def translator(batch):
        with open(said, "a") as out:
            out.writelines(f"{k}\n" for k in batch["cache_key"])
        return batch.assign(summary="Dansk: " + batch["summary_en"])[["cache_key", "summary"]]

    def broken(batch):
        raise OSError("no service")

    root = str(tmp_path / "store")
    run_batch(spark, feed, pages, root, BatchConfig(AS_OF, "0001"), translator=translator)
    got = {r.url: r.summary_da for r in tables(spark, root)["processed"].collect()}
    assert got["https://www.bbc.com/ai"] == "Dansk: Fallback classification: 4 AI terms found"
    assert not got["https://dr.dk/vejr"].startswith("Dansk")
    run_batch(spark, feed, pages, root, BatchConfig(AS_OF, "0002"), translator=translator)
    assert open(said).read().split() == ["https://www.bbc.com/ai"]
    cache = readers.read_table(spark, f"{root}/summary_cache", schemas.SUMMARY_TABLE)
    assert [(r.cache_key, r.summary) for r in cache.collect()] == [("https://www.bbc.com/ai", got["https://www.bbc.com/ai"])]
    from presslake.operators import classify

    hits = spark.createDataFrame([("u1", True, "One"), ("u2", True, "Two"), ("u3", False, "Three"), ("u4", True, "")], "url string, ai_topic_detected boolean, summary_en string")
    none = cache.select("cache_key", "summary").limit(0)
    told = classify.translate_missing(hits, none, broken, backoff=0.0).collect()
    assert sorted(map(tuple, told)) == [("u1", "One"), ("u2", "Two")]
    half = lambda batch: batch.assign(summary=[" Et " if k == "u1" else "  " for k in batch["cache_key"]])[["cache_key", "summary"]]
    assert sorted(map(tuple, classify.translate_missing(hits, none, half).collect())) == [("u1", "Et"), ("u2", "Two")]


@pytest.mark.parametrize("layout", [{}])
def test_batches_of_landed_folders_keep_counts_and_sketches(spark, tmp_path, layout):
    """A row that outlived its retention by hours is replaced, a batch runs again, and each folder is read by one batch only."""
    from presslake.operators import rollup, sketches
    from presslake.plans import upkeep, views

    root, landed = str(tmp_path / "store"), str(tmp_path / "feed")
    feed, pages = inputs(spark)
    early = AS_OF - dt.timedelta(days=30, hours=6)
    extra = spark.createDataFrame([(99, "https://edition.bbc.com/new", "Another", "20240101T113000Z", "edition.bbc.com", "en", "GB")], FEED)
    more = pages.union(spark.createDataFrame([("https://edition.bbc.com/new", html(AI * 30))], "url string, html string"))
    land = lambda rows, at: rows.write.parquet(f"{landed}/landed={at}")
    run = lambda at, b: upkeep.run_landed(spark, landed, more, root, BatchConfig(at, b, None, **layout), schema=feed.schema)["stored"]

    def plain(df):
        return sorted(tuple(map(str, r)) for r in df.collect())

    def direct():
        return plain(rollup.counted(views.stored_tables(spark, root)["processed_articles"]))

    land(feed.withColumn("seendate", F.lit("20231202T053000Z")), "a")
    assert run(early, "0001") > 0
    assert {r[0] for r in direct()} == {str(early.date())} and direct() == plain(upkeep.article_counts(spark, root))
    land(feed, "b")
    assert run(AS_OF, "0002") > 0
    assert {r[0] for r in direct()} == {str(AS_OF.date())} and direct() == plain(upkeep.article_counts(spark, root))
    land(extra, "c")
    assert run(AS_OF, "0003") == 1 and run(AS_OF, "0003") == 1 and run(AS_OF, "0004") == 0
    assert direct() == plain(upkeep.article_counts(spark, root, AS_OF))
    total = rollup.distribution(upkeep.article_counts(spark, root)).first()
    assert total["articles"] == views.stored_tables(spark, root)["processed_articles"].count()
    found = sketches.distinct_between(upkeep.article_sketches(spark, root), AS_OF.date(), AS_OF.date()).first()
    assert found["rows"] == found["url"] == total["articles"]
