import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from presslake import schemas
from presslake.session import build_session, shared_dir
from presslake.sources import readers, store

AS_OF = dt.datetime(2024, 2, 10, 12)


def test_conform_adds_casts_and_orders(spark):
    df = spark.createDataFrame([("1", "u", "x")], "ai_confidence string, url string, extra string")
    out = schemas.conform(df, schemas.STORED)
    assert out.schema.names == schemas.STORED.names
    r = out.first()
    assert (r.ai_confidence, r.url, r.domain_category, r.title) == (1.0, "u", "unknown", None)


def test_reading_a_table_of_an_older_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("u", "t")], "url string, title string").write.parquet(path)
    r = readers.read_table(spark, path, schemas.STORED).first()
    assert (r.url, r.title, r.domain_category, r.summary_en) == ("u", "t", "unknown", None)
    assert readers.read_table(spark, str(tmp_path / "none"), schemas.STORED).count() == 0


def test_partition_values_stay_text(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("u", "007")], "url string, batch_id string").withColumn("processed_at", F.lit(AS_OF))
    store.append_batch(df, path)
    assert readers.read_table(spark, path, schemas.STORED).first().batch_id == "007"


def test_upsert_takes_the_last_write(spark):
    old = spark.createDataFrame([("u1", "a", "b1"), ("u2", "b", "b1")], "url string, title string, batch_id string")
    new = spark.createDataFrame([("u1", "new", "b2"), ("u3", "c", "b2")], "url string, title string, batch_id string")
    got = {r.url: r.title for r in store.upsert(old, new).collect()}
    assert got == {"u1": "new", "u2": "b", "u3": "c"}
    assert {r.url: r.title for r in store.upsert(new, old).collect()} == got


def test_writing_a_batch_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda b, *u: spark.createDataFrame([(x, b) for x in u], "url string, batch_id string").withColumn("at", F.lit(AS_OF))
    store.append_batch(rows("b1", "u1", "u2"), path, "at")
    store.append_batch(rows("b2", "u3"), path, "at")
    store.append_batch(rows("b1", "u1"), path, "at")
    assert sorted(r.url for r in spark.read.parquet(path).collect()) == ["u1", "u3"]


def test_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [dt.datetime(2024, 1, d, h) for d, h in ((9, 0), (11, 11), (11, 12), (12, 0))]
    df = spark.createDataFrame([(f"u{i}", "b", d) for i, d in enumerate(days)], "url string, batch_id string, processed_at timestamp")
    store.append_batch(df, path)
    assert store.drop_expired(spark, path, AS_OF, 30) == ["day=2024-01-09"]
    left = store.retained(spark.read.parquet(path), AS_OF, 30)
    assert sorted(r.url for r in left.collect()) == ["u2", "u3"]
    assert store.drop_expired(spark, str(tmp_path / "none"), AS_OF) == []


def test_clear_all(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("a", "b")]
    for p in paths:
        spark.range(3).write.parquet(p)
    store.clear_all(spark, paths + [str(tmp_path / "never")])
    assert all(readers.read_table(spark, p, schemas.STORED).count() == 0 for p in paths)


def test_batch_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "j")
    df = spark.createDataFrame([("u", "æ \"q\"\nline", None, ["k"], AS_OF, "b1")],
                               "url string, text string, title string, keywords array<string>, at timestamp, batch_id string")
    store.write_batch_json(df, path)
    back = spark.read.schema(df.schema).json(path)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    line = next(p.read_text(encoding="utf-8") for p in (tmp_path / "j").rglob("*.json"))
    assert "æ" in line and json.loads(line)["title"] is None and json.loads(line)["at"].startswith("2024-02-10T12:00:00")
    assert readers.latest_batch_time(spark, path).first().last_update is not None


def test_older_layouts(spark, tmp_path):
    (tmp_path / "articles_1.json").write_text(json.dumps([{"url": "u1", "title": "a"}, {"url": "u2", "title": "b"}], indent=2))
    got = readers.read_batch_json(spark, str(tmp_path / "articles_*.json"))
    assert sorted(r.url for r in got.collect()) == ["u1", "u2"]
    (tmp_path / "cache.json").write_text(json.dumps({"u1": "én", "u2": "to"}, ensure_ascii=False, indent=2), encoding="utf-8")
    cache = readers.read_summary_cache(spark, str(tmp_path / "cache.json"))
    assert {r.cache_key: r.summary for r in cache.collect()} == {"u1": "én", "u2": "to"}
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.read_summary_cache(spark, str(tmp_path / "bad.json")).count() == 0
    assert readers.read_summary_cache(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "p.html").write_text("<html>\n<body>x</body>")
    page = readers.read_page_files(spark, str(tmp_path / "*.html")).first()
    assert page.html == "<html>\n<body>x</body>" and page.url.endswith("p.html")


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for event in [("r1", t(0), "running", None), ("r1", t(5), "completed", {"stored": 3}), ("r2", t(6), "running", None),
                  ("r3", t(7), "running", None), ("r3", t(9), "failed", None)]:
        store.append_run_event(store.run_event(spark, *event, error="boom" if event[2] == "failed" else None), path)
    got = {r.run_id: r for r in store.runs_current(readers.read_table(spark, path, schemas.RUN_EVENT)).collect()}
    assert (got["r1"].status, got["r1"].stored, got["r1"].started_at, got["r1"].completed_at) == ("completed", 3, t(0), t(5))
    assert (got["r2"].status, got["r2"].completed_at) == ("running", None)
    assert (got["r3"].status, got["r3"].error, got["r3"].completed_at) == ("failed", "boom", t(9))


def test_manifest(spark):
    rows = lambda n, b: spark.createDataFrame([(b,)] * n, "batch_id string")
    got = {(r.batch_id, r.file_type): (r.total_articles, r.stored_count, r.failed_count, r.filename)
           for r in store.batch_manifest(rows(2, "b1"), rows(1, "b1"), F.lit(AS_OF)).collect()}
    assert got == {("b1", "valid_articles"): (2, 2, 0, "articles_json/batch_id=b1"),
                   ("b1", "rejected_articles"): (1, 1, 0, "rejected_json/batch_id=b1")}


def test_shared_dir_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert build_session().sparkContext is spark.sparkContext


def test_landed_feed_and_pages(spark, tmp_path):
    feed = [{"url": "u", "title": "t", "seendate": "s"}, {"url": "v", "language": "da"}]
    (tmp_path / "feed.json").write_text("\n".join(json.dumps(r) for r in feed))
    got = {r.url: r for r in readers.read_feed(spark, str(tmp_path / "feed.json"), "json").collect()}
    assert got["u"].domain is None and got["v"].language == "da"
    spark.createDataFrame([("u", "<p>", 1)], "url string, html string, extra int").write.parquet(str(tmp_path / "pages"))
    assert readers.read_pages(spark, str(tmp_path / "pages")).columns == ["url", "html"]


def test_processing_step(spark):
    from presslake.operators.enrich import process_articles

    df = spark.createDataFrame([("ﬁ", 1)], "text string, n int")
    plain = process_articles(df, F.lit(AS_OF)).first()
    assert plain.text == "ﬁ" and plain.content_hash is not None and plain.processed_at == AS_OF and plain.n == 1
    assert process_articles(df, F.lit(AS_OF), normalize_unicode=True).first().text == "fi"


def test_a_shrinking_rerun_leaves_no_old_rows(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "url string, batch_id string, processed_at timestamp")
    day = dt.datetime
    path = f"{tmp_path}/t"
    store.append_batch(rows(("a", "b1", day(2024, 1, 1)), ("b", "b1", day(2024, 1, 2))), path, batch_id="b1")
    store.append_batch(rows(("c", "b2", day(2024, 1, 2))), path, batch_id="b2")
    store.append_batch(rows(("a", "b1", day(2024, 1, 1))), path, batch_id="b1")
    assert sorted(r.url for r in spark.read.parquet(path).collect()) == ["a", "c"]
    store.append_batch(rows(("x", "b1", day(2024, 1, 1))).limit(0), path, batch_id="b1")
    assert [r.url for r in spark.read.parquet(path).collect()] == ["c"]


def test_the_tenth_batch_beats_the_ninth(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "url string, title string, batch_id string")
    assert store.upsert(rows(("u", "old", "b9")), rows(("u", "new", "b10"))).first().title == "new"


def test_merged_days_keep_every_row(spark, tmp_path):
    path, schema = str(tmp_path / "t"), schemas.FAILURE
    batch = lambda b, day, *d: spark.createDataFrame(
        [(x, "r", dt.datetime(2024, 1, day, 1), b) for x in d], schema)
    now = lambda: sorted((r.domain, r.batch_id, r.at.day) for r in readers.read_table(spark, path, schema).collect())
    for b, day, domains in (("b1", 1, "aab"), ("b2", 1, "a"), ("b=3", 1, "c"), ("b4", 2, "d")):
        store.append_batch(batch(b, day, *domains), path, "at", batch_id=b)
    before = now()
    assert store.compact(spark, path, schema, dt.date(2024, 1, 3)) == ["2024-01-01"] and now() == before
    assert [p.name for p in (tmp_path / "t" / "day=2024-01-01").iterdir() if p.name.startswith("batch")] == ["batch_id=__merged-000000001"]
    since = readers.read_table(spark, path, schema, since=dt.datetime(2024, 1, 2))
    assert [r.domain for r in since.collect()] == ["d"]
    # A batch of a merged day runs again: fewer rows, then none, then another merge.
    store.append_batch(batch("b1", 1, "z"), path, "at", batch_id="b1")
    assert now() == sorted([("z", "b1", 1), *[r for r in before if r[1] != "b1"]])
    store.append_batch(batch("b1", 1, "z").limit(0), path, "at", batch_id="b1")
    rest = [r for r in before if r[1] != "b1"]
    assert now() == rest
    assert store.compact(spark, path, schema, dt.date(2024, 1, 3)) == ["2024-01-01"] and now() == rest
    # A merge that was cut short: not whole, or whole with its sources still there.
    half = batch("x", 1, "x").withColumnRenamed("batch_id", readers.MERGED_BATCH)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/day=2024-01-01/batch_id=__merged-000000009")
    assert now() == rest
    store.append_batch(batch("b5", 2, "e"), path, "at", batch_id="b5")
    both = now()
    whole = batch("b4", 2, "d").unionByName(batch("b5", 2, "e")).withColumnRenamed("batch_id", readers.MERGED_BATCH)
    whole.write.parquet(f"{path}/day=2024-01-02/batch_id=__merged-000000001")
    assert now() == both
    assert store.compact(spark, path, schema, dt.date(2024, 1, 3)) == ["2024-01-01", "2024-01-02"] and now() == both
    assert store.compact(spark, str(tmp_path / "none"), schema, dt.date(2024, 1, 3)) == []


def test_a_table_of_many_days_keeps_few_folders_and_files(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create(spark, path, "year")
    assert readers.read_table(spark, path, schemas.STORED).count() == 0
    # Four years in hours, dealt at random over many tasks.
    hours = spark.range(0, 24 * 1461, 7).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("b1").alias("batch_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("processed_at")).repartition(16)
    store.append_batch(hours, path, batch_id="b1")
    store.append_batch(hours.where("processed_at >= '2026-06-01'").withColumn("batch_id", F.lit("b2")), path, batch_id="b2")
    store.append_batch(hours, path, batch_id="b1")
    assert sorted(p.name for p in (tmp_path / "t").glob("day=*")) == [f"day={y}-01-01" for y in (2024, 2025, 2026, 2027)]
    assert len(list((tmp_path / "t").glob("*/*/*.parquet"))) == 6
    late = hours.where("processed_at >= '2026-06-01'").count()
    assert readers.read_table(spark, path, schemas.STORED).count() == hours.count() + late
    # A year that the limit lies in is kept, read from its start and left unmerged.
    since = readers.read_table(spark, path, schemas.STORED, since=dt.datetime(2026, 6, 1))
    assert since.where("processed_at >= '2026-06-01'").count() == 2 * late and since.where("processed_at < '2026-01-01'").isEmpty()
    assert store.drop_expired(spark, path, dt.datetime(2025, 7, 1), 30) == ["day=2024-01-01"]
    assert store.compact(spark, path, schemas.STORED, dt.date(2027, 5, 1)) == ["2026-01-01"]
    kept = hours.where("processed_at >= '2025-01-01'").count()
    counts = readers.read_table(spark, path, schemas.STORED).groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in counts} == {"b1": kept, "b2": late}
    store.create(spark, path, "day")
    assert readers.period_of(spark, path) == "year"
    with pytest.raises(ValueError):
        store.create(spark, str(tmp_path / "none"), "week")
