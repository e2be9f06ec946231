"""Keyed tables, membership filters, incremental loads, sketches and rollups."""

import datetime as dt
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from presslake import schemas
from presslake.operators import browse, rollup, sketches, substrings
from presslake.sources import keyed, marks, members, paged, readers, store

ROWS = "url string, title string, domain string, processed_at timestamp, batch_id string"


def rows_of(spark, ids, batch_id, day, title, hour=10):
    at = dt.datetime(2024, 1, day, hour)
    return spark.createDataFrame([(f"u{i}" if i is not None else None, title, f"d{(i or 0) % 3}.com", at, batch_id) for i in ids], ROWS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def newest(batches):
    held = {}
    for ids, batch_id, day, title in batches:
        held |= {i: (f"u{i}" if i is not None else None, title) for i in ids}
    return sorted(held.values(), key=str)


BATCHES = [(range(0, 60), "b1", 1, "one"), (range(40, 90), "b2", 2, "two"), ([*range(80, 100), None], "b3", 3, "three"), (range(0, 5), "b4", 3, "four")]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "articles")
    keyed.create(spark, path, schemas.STORED, "url", 4)
    return path


def test_current_rows_need_no_shuffle(spark, table):
    for ids, batch_id, day, title in BATCHES:
        keyed.append(rows_of(spark, ids, batch_id, day, title), table, batch_id=batch_id)
    now = keyed.current(spark, table)
    assert sorted(((r.url, r.title) for r in now.collect()), key=str) == newest(BATCHES)
    top = now.orderBy(F.desc("processed_at"), "url").limit(10)
    assert "Exchange" not in plan(top) and [r.url for r in top.collect()][:3] == [None, "u0", "u1"]
    recent = plan(keyed.current(spark, table, since=dt.datetime(2024, 1, 3)))
    assert "day#" in recent.split("PartitionFilters:")[1].split("PushedFilters")[0] and "Exchange" not in recent
    # Other readers see the same rows in the plain layout.
    plain = store.latest(readers.read_table(spark, table, schemas.STORED), "url", store.written_order("processed_at"))
    assert sorted(((r.url, r.title) for r in plain.collect()), key=str) == newest(BATCHES)


def test_merge_folds_base_and_deltas(spark, table):
    for ids, batch_id, day, title in BATCHES[:2]:
        keyed.append(rows_of(spark, ids, batch_id, day, title), table, batch_id=batch_id)
    first = keyed.merge(spark, table)
    assert first == "__base-000000001" and keyed.merge(spark, table) is None
    folders = {p.name for p in Path(table).glob("day=*/batch_id=*")}
    assert folders == {f"batch_id={first}"} and keyed.read(spark, table).count() == 90
    for ids, batch_id, day, title in BATCHES[2:]:
        keyed.append(rows_of(spark, ids, batch_id, day, title), table, batch_id=batch_id)
    assert sorted(((r.url, r.title) for r in keyed.current(spark, table).collect()), key=str) == newest(BATCHES)
    # A merge that was cut short before the old folders went leaves rows twice, of which one counts.
    shutil.copytree(table, f"{table}-before")
    keyed.merge(spark, table)
    shutil.copytree(f"{table}-before", table, dirs_exist_ok=True)
    assert sorted(((r.url, r.title) for r in keyed.current(spark, table).collect()), key=str) == newest(BATCHES)
    assert keyed.merge(spark, table) == "__base-000000003"
    assert keyed.read(spark, table).count() == len(newest(BATCHES))


def test_a_batch_again_replaces_its_rows(spark, table):
    keyed.append(rows_of(spark, range(10), "b1", 1, "one"), table, batch_id="b1")
    keyed.append(rows_of(spark, range(3), "b1", 2, "again"), table, batch_id="b1")
    assert sorted((r.url, r.title) for r in keyed.current(spark, table).collect()) == [(f"u{i}", "again") for i in range(3)]
    keyed.create(spark, table, schemas.STORED, "url", 99)
    assert keyed.layout(spark, table)["buckets"] == 4
    assert store.drop_expired(spark, table, dt.datetime(2024, 3, 1)) == ["day=2024-01-01", "day=2024-01-02"]
    assert keyed.current(spark, table).count() == 0 and keyed.merge(spark, table) is None


def history(spark, path, days=6):
    for day in range(1, days + 1):
        rows = rows_of(spark, range(1000 * day, 1000 * day + 200), f"b{day}", day, "old")
        members.write(rows, path, batch_id=f"b{day}")
        store.append_batch(rows, path, batch_id=f"b{day}")


def asked(spark, ids):
    return spark.createDataFrame([(k, f"u{i}" if i is not None else None) for k, i in enumerate(ids)], "ingest_rank long, url string")


def test_filters_miss_nothing_and_name_few_days(spark, tmp_path):
    path = str(tmp_path / "history")
    history(spark, path)
    held = [1000 * day + i for day in range(1, 7) for i in range(0, 200, 7)]
    keys = asked(spark, held)
    maybe, days = members.maybe_held(keys.select("url"), path)
    assert {r.url for r in maybe.collect()} == {f"u{i}" for i in held} and len(days) == 6
    absent = asked(spark, range(50_000, 54_000))
    maybe, _ = members.maybe_held(absent.select("url"), path)
    assert maybe.count() < 0.1 * 4000
    assert members.known_keys(absent, path, schemas.STORED).count() == 0


def test_history_is_read_only_where_filters_ask_for_it(spark, tmp_path):
    path = str(tmp_path / "history")
    history(spark, path)
    rows = asked(spark, [3005, 3006, 3006, None, 70_001])
    _, days = members.maybe_held(rows.select("url").dropna(), path)
    assert dt.date(2024, 1, 3) in days and len(days) < 6
    for day in range(1, 7):
        if dt.date(2024, 1, day) not in days:
            # What is not asked for may as well be unreadable.
            for file in Path(path).glob(f"day=2024-01-0{day}/*/*.parquet"):
                file.write_bytes(b"not parquet")
    assert [r.ingest_rank for r in members.new_rows(rows, path, schemas.STORED).orderBy("ingest_rank").collect()] == [3, 4]
    lone = asked(spark, [70_001])
    if not members.maybe_held(lone.select("url"), path)[1]:
        assert "FileScan" not in plan(members.known_keys(lone, path, schemas.STORED))


def test_folders_without_filter_are_read_and_can_get_one(spark, tmp_path):
    path = str(tmp_path / "history")
    history(spark, path, 3)
    store.append_batch(rows_of(spark, range(9000, 9010), "late", 3, "old"), path, batch_id="late")
    rows = asked(spark, [9003, 9100, 1001])
    told = lambda: sorted(r.url for r in members.known_keys(rows, path, schemas.STORED).collect())
    assert told() == ["u1001", "u9003"]
    assert members.build(spark, path, schemas.STORED) == ["2024-01-03"] and members.build(spark, path, schemas.STORED) == []
    assert told() == ["u1001", "u9003"]
    # Days merged since keep their rows; the merged folder gets a filter when asked.
    store.compact(spark, path, schemas.STORED, dt.date(2024, 1, 10))
    assert told() == ["u1001", "u9003"]
    assert members.build(spark, path, schemas.STORED) == ["2024-01-03"] and told() == ["u1001", "u9003"]
    assert members.drop_expired_filters(spark, path, dt.datetime(2024, 2, 2)) == ["day=2024-01-01", "day=2024-01-02"]
    assert members.known_keys(asked(spark, []), path, schemas.STORED).count() == 0
    assert members.known_keys(rows, str(tmp_path / "none"), schemas.STORED).count() == 0


def test_incremental_loads_read_new_folders_only(spark, tmp_path):
    feed, notes = str(tmp_path / "feed"), str(tmp_path / "marks")
    land = lambda hour, ids: spark.createDataFrame([(f"u{i}", hour) for i in ids], "url string, landed string").write.mode("append").partitionBy("landed").parquet(feed)
    schema = spark.createDataFrame([], "url string").schema
    read = lambda span: sorted(r.url for r in marks.read_span(spark, feed, span, schema).collect())
    assert marks.span_of(spark, feed, notes, "b0") == (None, None) and read(marks.Span(None, None)) == []
    land("2024010110", range(3))
    one = marks.span_of(spark, feed, notes, "b1")
    assert read(one) == ["u0", "u1", "u2"]
    marks.save_mark(spark, notes, "b1", one)
    land("2024010112", [3]), land("2024010113", [4])
    two = marks.span_of(spark, feed, notes, "b2")
    scan = marks.read_span(spark, feed, two, schema)
    assert "landed" in plan(scan).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert two == ("2024010110", "2024010113") and len(scan.inputFiles()) >= 1
    shutil.rmtree(f"{feed}/landed=2024010110")
    assert read(two) == ["u3", "u4"]
    marks.save_mark(spark, notes, "b2", two), marks.save_mark(spark, notes, "b2", two)
    land("2024010114", [5])
    # A batch that runs again reads what it read before, whatever has landed since.
    assert marks.span_of(spark, feed, notes, "b2") == two and marks.span_of(spark, feed, notes, "b3") == ("2024010113", "2024010114")


def test_a_load_lists_its_own_folders_only(spark, tmp_path):
    feed = str(tmp_path / "feed")
    rows = spark.createDataFrame([(f"u{i}", f"2024-01-01 {i:02d}:00") for i in range(20)], "url string, landed string")
    rows.write.partitionBy("landed").parquet(feed)
    schema = rows.select("url").schema
    scan = marks.read_span(spark, feed, marks.Span("2024-01-01 16:00", "2024-01-01 18:00"), schema)
    assert sorted(r.url for r in scan.collect()) == ["u17", "u18"] and len(scan.inputFiles()) == 2
    assert marks.read_span(spark, feed, marks.Span(None, "2024-01-01 19:00"), schema).count() == 20
    assert marks.read_span(spark, feed, marks.Span("2024-01-01 19:00", "2024-01-02"), schema).count() == 0



def test_sketches_of_days_add_up(spark):
    df = spark.range(40_000).select(
        F.concat(F.lit("d"), (F.col("id") % 9000).cast("string")).alias("domain"), F.when(F.col("id") % 10 > 0, (F.col("id") % 3).cast("string")).alias("language"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % 5).cast("int"))).alias("processed_at"))
    kept = sketches.united(*[sketches.day_sketches(df.where(F.col("id") % 3 == k), ["domain", "language"]) for k in range(3)])
    assert kept.count() == 5
    whole = sketches.distinct_between(kept, dt.date(2024, 1, 1), dt.date(2024, 1, 5)).first()
    assert whole["rows"] == 40_000 and abs(whole["domain"] - 9000) < 0.05 * 9000 and whole["language"] == 3
    exact = df.where("processed_at < '2024-01-03'").agg(F.count_distinct("domain")).first()[0]
    assert abs(sketches.distinct_between(kept, dt.date(2024, 1, 1), dt.date(2024, 1, 2)).first()["domain"] - exact) < 0.05 * exact
    assert tuple(sketches.distinct_between(kept, dt.date(2023, 1, 1), dt.date(2023, 1, 2)).first()) == (0, 0, 0)
    trailing = {r["day"].day: r["rows"] for r in sketches.distinct_trailing(kept, 2).collect()}
    assert trailing == {1: 8000, 2: 16000, 3: 16000, 4: 16000, 5: 16000}


ARTICLE = "url string, domain string, domain_category string, ai_topic string, language string, ai_topic_detected boolean, processed_at timestamp"


def test_rollup_equals_direct_counts_after_every_change(spark):
    rng = random.Random(2)
    one = lambda i: (f"u{i}", f"d{rng.randrange(4)}", rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice(["en", "da"]),
                     rng.choice([True, False, None]), dt.datetime(2024, 1, rng.randint(1, 9)))
    held, kept = {}, None
    frame = lambda rows: spark.createDataFrame(list(rows), ARTICLE)
    for ids in (range(60), range(40, 100), range(20)):
        batch = {i: one(i) for i in ids}
        change = rollup.changes(frame(held.values()), frame(batch.values()))
        kept = change if kept is None else rollup.merged(kept, change)
        held |= batch
    gone = [f"u{i}" for i in range(50, 70)]
    kept = rollup.merged(kept, rollup.removed(frame(held.values()), frame([(u, *held[int(u[1:])][1:]) for u in gone])))
    held = {i: r for i, r in held.items() if r[0] not in gone}
    kept = rollup.kept_days(kept, dt.datetime(2024, 2, 2), 30)
    left = frame(r for r in held.values() if r[6] >= dt.datetime(2024, 1, 3))
    for by in ([], ["domain_category"], ["ai_topic", "language"], ["domain"], ["day"]):
        got = sorted(map(tuple, rollup.distribution(kept, *by).collect()), key=str)
        direct = left.withColumn("day", F.to_date("processed_at")).groupBy(*by).agg(F.count(F.lit(1)), F.count_if("ai_topic_detected")).collect()
        assert got == sorted(map(tuple, direct), key=str)


def test_pages_are_read_from_their_ranges(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"u{i:05d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(400))) for i in range(5000)]
    df = spark.createDataFrame(rows, "url string, processed_at timestamp")
    path = str(tmp_path / "list")
    paged.write_index(df, path, 16)
    for page, size in ((1, 10), (7, 13), (321, 10), (500, 10), (501, 10), (3, 900), (9999, 10)):
        assert paged.read_page(spark, path, page, size).collect() == browse.browse_page(df, page, size).collect()
    deep = paged.read_page(spark, path, 400)
    assert "range" in plan(deep).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert tuple(paged.page_numbers(spark, path, 10).first()) == (5000, 500)


def test_long_substring_lists(spark):
    rng = random.Random(9)
    part = lambda lo, hi: "".join(rng.choice("abc.-") for _ in range(rng.randint(lo, hi)))
    texts = [(i, part(0, 30)) for i in range(300)] + [(300, None), (301, ""), (302, "ä" * 5 + "xyz")]
    listed = sorted({part(1, 9) for _ in range(400)} | {"äx", "xyz", "xyz", "z"})
    df = spark.createDataFrame(texts, "id long, text string")
    entries = spark.createDataFrame([(e,) for e in [*listed, "", None]], "entry string")
    found = substrings.matches(df, F.col("text"), entries, "id")
    assert sorted(map(tuple, found.collect())) == sorted((i, e) for i, t in texts for e in listed if t and e in t)
    told = {r.id: r.listed for r in substrings.with_listed(df, F.col("text"), entries, "id").collect()}
    assert told == {i: bool(t) and any(e in t for e in listed) for i, t in texts}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert substrings.matches(df, F.col("text"), entries.limit(0), "id").count() == 0
    # 100,000 entries: the plan does not grow with the list.
    many = spark.range(100_000).select(F.concat(F.lit("site-"), F.col("id").cast("string"), F.lit(".org")).alias("entry"))
    hosts = spark.range(0, 200_000, 1000).select("id", F.concat(F.lit("www.site-"), F.col("id").cast("string"), F.lit(".org")).alias("host"))
    assert substrings.matches(hosts, F.col("host"), many, "id").where(F.expr("entry = concat('site-', id, '.org')")).count() == 100


def test_pages_are_pruned_by_landing_day(spark, tmp_path):
    path = str(tmp_path / "pages")
    for day in range(1, 6):
        spark.createDataFrame([(f"u{day}", "<p>x</p>")], schemas.PAGE).write.parquet(f"{path}/landed=2024-01-0{day}")
    told = readers.read_pages(spark, path, since=dt.datetime(2024, 1, 2, 5), until=dt.datetime(2024, 1, 3, 1))
    assert sorted(r.url for r in told.collect()) == ["u2", "u3"] and told.columns == ["url", "html"]
    assert "landed" in plan(told).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert readers.read_pages(spark, f"{path}/landed=2024-01-04").count() == 1


@pytest.fixture
def years(spark, tmp_path):
    """A keyed table of four years, of which the second batch brings every third article again."""
    path = str(tmp_path / "years")
    keyed.create(spark, path, schemas.STORED, "url", 4, "year")
    rows = spark.range(0, 24 * 1461, 31).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("old").alias("title"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("processed_at"), "id")
    again = rows.where("id % 3 = 0").withColumns({"title": F.lit("new"), "processed_at": F.col("processed_at") + F.expr("INTERVAL 40 DAYS")})
    for batch_id, part in (("b1", rows), ("b2", again)):
        keyed.append(part.drop("id").withColumn("batch_id", F.lit(batch_id)), path, batch_id=batch_id)
    return path, rows.count(), again.count()


def test_keyed_rows_of_many_days_lie_in_few_folders(spark, years):
    path, n, again = years
    names = {"/".join(p.parts[-2:]) for p in Path(path).glob("day=*/batch_id=*")}
    assert names == {f"day={y}-01-01/batch_id={b}" for y in (2024, 2025, 2026, 2027, 2028) for b in ("b1", "b2")} - {"day=2028-01-01/batch_id=b1"}
    assert len(list(Path(path).glob("*/*/*.parquet"))) <= 9 * 4
    titles = {r["title"]: r["count"] for r in keyed.current(spark, path).groupBy("title").count().collect()}
    assert titles == {"old": n - again, "new": again}
    recent = keyed.current(spark, path, since=dt.datetime(2026, 6, 1))
    assert "Exchange" not in plan(recent) and recent.agg(F.min("processed_at")).first()[0].year == 2026


def test_a_merge_keeps_the_years(spark, years):
    path, n, again = years
    base = keyed.merge(spark, path)
    assert {"/".join(p.parts[-2:]) for p in Path(path).glob("day=*/batch_id=*")} == {f"day={y}-01-01/batch_id={base}" for y in range(2024, 2029)}
    assert keyed.read(spark, path).count() == n
    titles = {r["title"]: r["count"] for r in keyed.current(spark, path).groupBy("title").count().collect()}
    assert titles == {"old": n - again, "new": again}


def test_filters_follow_the_years_of_their_table(spark, tmp_path):
    path = str(tmp_path / "history")
    store.create(spark, path, "year")
    rows = spark.range(0, 24 * 1461, 13).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("b1").alias("batch_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("processed_at")).repartition(8)
    members.write(rows, path, batch_id="b1")
    store.append_batch(rows, path, batch_id="b1")
    years = [f"day={y}-01-01" for y in (2024, 2025, 2026, 2027)]
    for table in (path, members.filter_path(path)):
        assert sorted(p.name for p in Path(table).glob("day=*")) == years and len(list(Path(table).glob("*/*/*.parquet"))) == 4
    assert members.build(spark, path, schemas.STORED) == []
    keys = asked(spark, [0, 13, 24 * 800 - 24 * 800 % 13, 24 * 1400 - 24 * 1400 % 13, 1])
    told = lambda **limits: {r.url for r in members.known_keys(keys, path, schemas.STORED, **limits).collect()}
    assert told() == {r.url for r in keys.collect()} - {"u1"}
    # Of the year that the limit lies in, filters and rows are read; earlier years are not.
    assert told(since=dt.datetime(2026, 12, 1)) == told() - {"u0", "u13"}
    gone = members.drop_expired_filters(spark, path, dt.datetime(2026, 1, 15))
    assert gone == store.drop_expired(spark, path, dt.datetime(2026, 1, 15)) == ["day=2024-01-01"]


def test_few_buckets_do_not_bound_the_tasks_that_write(spark, salted, tmp_path):
    path = str(tmp_path / "articles")
    keyed.create(spark, path, schemas.STORED, "url", 2, "year")
    rows = spark.range(0, 24 * 1461, 31).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("b1").alias("batch_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("processed_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed.append(rows, path, batch_id="b1")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = list(Path(path).glob("*/*/*.parquet"))
    # Still one file for each folder and bucket, but written by more tasks than there are buckets.
    assert len(files) == 4 * 2 and len({f.name.split("-")[1] for f in files}) > 2
    assert "Exchange" not in plan(keyed.current(spark, path)) and keyed.current(spark, path).count() == rows.count()


def test_appending_looks_at_no_other_folders(spark, table, monkeypatch):
    for day in (1, 2, 3):
        keyed.append(rows_of(spark, range(day * 10, day * 10 + 10), "b1", day, "one"), table)
    assert keyed.read(spark, table).count() == 30
    # Another session drops two days, which this one still has in its catalogue.
    for day in (1, 2):
        shutil.rmtree(f"{table}/day=2024-01-0{day}")
    said, run = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (said.append(text), run(self, text, *a, **k))[1])
    keyed.append(rows_of(spark, range(5), "b1", 2, "two"), table, batch_id="b1")
    keyed.append(rows_of(spark, range(3), "b2", 1, "three"), table, batch_id="b2")
    assert not [s for s in said if "REPAIR" in s]
    assert sorted((r.url, r.title) for r in keyed.read(spark, table).collect()) == sorted([(f"u{i}", "two") for i in range(5)] + [(f"u{i}", "three") for i in range(3)])
    assert len([s for s in said if "REPAIR" in s]) == 1


def test_rows_of_centuries_lie_in_folders_of_decades(spark, tmp_path):
    path, plain = str(tmp_path / "keyed"), str(tmp_path / "plain")
    keyed.create(spark, path, schemas.STORED, "url", 2, "decade")
    store.create(spark, plain, "decade")
    dates = [dt.datetime(y, m, d, 12) for y in range(1999, 2041) for m, d in ((1, 1), (12, 31))]
    rows = spark.createDataFrame([(f"u{i}", "old", "d.com", at, "b1") for i, at in enumerate(dates)], ROWS)
    keyed.append(rows, path, batch_id="b1")
    store.append_batch(rows, plain, batch_id="b1")
    decades = [f"day={y}-01-01" for y in (1990, 2000, 2010, 2020, 2030, 2040)]
    for p in (path, plain):
        assert sorted(f.name for f in Path(p).glob("day=*")) == decades
    keyed.append(rows.where("url >= 'u5'").withColumns({"title": F.lit("new"), "batch_id": F.lit("b2")}), path, batch_id="b2")
    base = keyed.merge(spark, path)
    assert {"/".join(f.parts[-2:]) for f in Path(path).glob("day=*/batch_id=*")} == {f"{d}/batch_id={base}" for d in decades}
    held = {r.url: r.title for r in keyed.current(spark, path).collect()}
    assert held == {f"u{i}": "new" if f"u{i}" >= "u5" else "old" for i in range(len(dates))}
    # Of the decade that a limit lies in, all rows stay; earlier decades are pruned.
    since = dt.datetime(2029, 12, 31, 23)
    assert keyed.read(spark, path, since).agg(F.min("processed_at")).first()[0].year == 2020
    assert readers.read_table(spark, plain, schemas.STORED, since=since).agg(F.min("processed_at")).first()[0].year == 2020
    assert store.drop_expired(spark, plain, dt.datetime(2010, 1, 31)) == decades[:2]
    assert store.drop_expired(spark, plain, dt.datetime(2010, 1, 30)) == []
