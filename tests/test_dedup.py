import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as some
from pyspark.sql import functions as F

from presslake.operators import dedup, skew

SCHEMA = "ingest_rank long, url string, domain string, title string"


def base(domain):
    domain = domain.lower().strip()
    domain = domain[4:] if domain.startswith("www.") else domain
    return ".".join(domain.split(".")[-2:])


def key(row):
    title = (row[3] or "").strip().lower()
    return (base(row[2]), title) if row[2] and title else None


def in_order(rows, known=(), keys=(), check_urls=True):
    """One row after the other, as the rule is worded."""
    urls, titles, kept = set(known), set(keys), []
    for row in sorted(rows):
        if row[1] and row[1] in urls or key(row) and key(row) in titles:
            continue
        if row[1] and check_urls:
            urls.add(row[1])
        if key(row):
            titles.add(key(row))
        kept.append(row[0])
    return kept


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def ids(df):
    return sorted(r[0] for r in df.select("ingest_rank").collect())


def test_a_dropped_row_hides_nothing(spark):
    rows = [(1, "u1", "a.com", "t1"), (2, "u2", "x.a.com", " T1 "), (3, "u2", "www.a.com", "t2")]
    assert ids(dedup.dedup_batch(frame(spark, rows))) == [1, 3]


def test_rows_without_key_or_address(spark):
    rows = [(1, "u1", "a.com", ""), (2, "u2", "a.com", ""), (3, "", "a.com", " "), (4, None, "", "t"), (5, "u1", "", "t"),
            (6, "", "a.com", "t"), (7, None, "a.com", "T")]
    assert ids(dedup.dedup_batch(frame(spark, rows))) == [1, 2, 3, 4, 6]


def random_rows(seed, n, urls, titles):
    r = random.Random(seed)
    pick = lambda prefix, k, empty: r.choice(empty + [f"{prefix}{i}" for i in range(k)])
    return [(i, pick("u", urls, ["", None]) if r.random() < 0.7 else "hot", r.choice(["", "a.com", "WWW.a.com", "x.a.com", "b.org"]),
             pick("t", titles, ["", " ", None]) if r.random() < 0.7 else "Hot ") for i in range(n)]


@pytest.mark.parametrize("seed,n,urls,titles", [(1, 400, 30, 30), (2, 800, 600, 20), (3, 800, 20, 600), (4, 300, 300, 300)])
def test_batch_against_row_by_row(spark, salted, seed, n, urls, titles):
    rows = random_rows(seed, n, urls, titles)
    assert ids(dedup.dedup_batch(frame(spark, rows))) == in_order(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(some.lists(some.tuples(some.integers(0, 4), some.integers(0, 4)), min_size=1, max_size=25))
def test_batch_on_adversarial_chains(spark, pairs):
    rows = [(i, f"u{u}" if u else "", "a.com", f"t{t}" if t else "") for i, (u, t) in enumerate(pairs)]
    assert ids(dedup.dedup_batch(frame(spark, rows))) == in_order(rows)


def chain(n, start=0, ring=""):
    """Row i shares its address with the row before or its title with the one behind, in turns."""
    return [(start + i, f"{ring}u{(i + 1) // 2}", "a.com", f"{ring}t{i // 2}") for i in range(n)]


def test_long_chains_in_few_stages(spark, monkeypatch):
    made, plain = [], dedup.staged
    monkeypatch.setattr(dedup, "staged", lambda df: made.append(1) or plain(df))
    rows = chain(1000)
    assert ids(dedup.dedup_batch(frame(spark, rows))) == in_order(rows) == list(range(0, 1000, 2))
    assert len(made) <= 12


@pytest.mark.parametrize("seed", [21, 22])
def test_chains_trees_and_rivals_against_row_by_row(spark, salted, seed):
    r = random.Random(seed)
    rows = [row for k in range(12) for row in chain(r.randint(1, 40), 1000 * k, f"c{k}")]
    # Ranks dealt anew turn chains into trees of rivals; some rows tie several chains together or have only one of both keys.
    order = r.sample(range(10**6), len(rows))
    rows += [(20_000 + i, f"c{r.randrange(12)}u{r.randrange(12)}", "a.com", f"c{r.randrange(12)}t{r.randrange(12)}") for i in range(60)]
    rows = [(order[i] if seed == 22 and i < len(order) else row[0] + 10**7, *row[1:]) for i, row in enumerate(rows)]
    rows += [(2 * 10**7 + i, "" if i % 2 else f"c{i}u1", "a.com" if i % 2 else "", f"c{i}t2") for i in range(10)]
    for plain_rounds in (0, 1):
        assert ids(dedup.dedup_batch(frame(spark, rows), plain_rounds=plain_rounds)) == in_order(rows)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_result_does_not_depend_on_partitions(spark, parts):
    rows = random_rows(5, 300, 40, 40)
    once = dedup.dedup_batch(frame(spark, rows, parts))
    assert ids(once) == in_order(rows)
    assert ids(dedup.dedup_batch(once)) == ids(once)


@pytest.mark.parametrize("seed", [11, 12])
def test_cross_run_against_row_by_row(spark, salted, seed):
    rows, stored = random_rows(seed, 500, 60, 60), random_rows(seed + 100, 60, 60, 30)
    known = [r[1] for r in stored[:20] if r[1]]
    got = dedup.dedup_cross_run(frame(spark, rows), frame(spark, stored[:20]), frame(spark, stored))
    want = in_order(rows, known, {key(r) for r in stored if key(r)}, check_urls=False)
    assert ids(got) == want
    # Without titles at hand, the two anti joins agree with their definitions.
    fresh = dedup.new_urls(frame(spark, rows), frame(spark, stored[:20]))
    assert ids(fresh) == [r[0] for r in rows if not (r[1] and r[1] in known)]
    titles = {key(r) for r in stored if key(r)}
    assert ids(dedup.new_titles(frame(spark, rows), frame(spark, stored))) == [r[0] for r in rows if key(r) not in titles]
    loss = dedup.dedup_loss(frame(spark, rows), got, F.col("domain") == "b.org").first()
    assert loss.kept == len(want) and loss.removed == len(rows) - len(want) == loss.removed_danish + loss.removed_other


def test_hot_keys_are_found_and_spread(spark, salted):
    df = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k")
    ).repartition(6)
    (hot,) = skew.hot_hashes(df, ["k"])
    hashed = spark.sql("SELECT xxhash64('hot') AS h").first().h
    assert hot == {hashed: 64}
    salts = skew.with_salt(df.filter("k = 'hot'"), ["k"], hot, ["id"]).groupBy("__salt").count().collect()
    assert len(salts) == 64 and max(r["count"] for r in salts) < 9000 / 64
    right = spark.createDataFrame([("hot",), ("k1",), ("k1",), (None,)], "k string")
    assert skew.semi_join(df, right, ["k"], ["id"]).count() == 3001
    assert skew.anti_join(df, right, ["k"], ["id"]).count() == 5999
    looked = skew.lookup_join(df, right.dropna().distinct().withColumn("v", F.lit(1)), ["k"], ["id"])
    assert looked.count() == 9000 and looked.filter("v = 1").count() == 3001


@pytest.mark.parametrize("share", [100, 300, 1000])
def test_no_task_holds_a_frequent_key(spark, share):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * share))
    try:
        key = F.when(F.col("id") % share == 0, "hot").otherwise(F.col("id").cast("string"))
        df = spark.range(200_000).select("id", key.alias("k")).repartition(4)
        (hot,) = skew.hot_hashes(df, ["k"])
        assert len(hot) == 1
        largest = skew.with_salt(df, ["k"], hot, ["id"]).groupBy("k", "__salt").count().agg(F.max("count")).first()[0]
        assert largest <= 200_000 / (4 * share)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_salts_without_hot_keys(spark, salted):
    df = spark.range(5000).select("id", F.col("id").alias("k"))
    assert skew.hot_hashes(df, ["k"], ["id"]) == [{}, {}] and skew.hot_hashes(df.limit(0), ["k"]) == [{}]
    joined = skew.anti_join(df, df.filter("id > 9"), ["k"])
    assert joined.count() == 10 and "__salt" not in joined._jdf.queryExecution().analyzed().toString()


def test_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    right = spark.createDataFrame([(None,), ("a",)], "k string")
    assert [r.id for r in skew.anti_join(left, right, ["k"], ["id"]).collect()] == [1]
    assert [r.id for r in skew.semi_join(left, right, ["k"], ["id"]).collect()] == [2]


def test_canonical_articles(spark):
    rows = [("u1", "us.cnn.com", "T", "2024-01-02"), ("u2", "cnn.com", "t ", "2024-01-01"), ("u3", "cnn.com", "T", "2023-01-01"),
            ("u4", "bbc.com", None, "2024-01-01"), ("u5", "bbc.com", "", "2024-01-02")]
    df = spark.createDataFrame(rows, "url string, domain string, title string, at string").withColumn("processed_at", F.to_timestamp("at"))
    assert sorted(r.url for r in dedup.canonical_articles(df).collect()) == ["u2", "u5"]


def test_equal_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, ""), (5, None), (6, "a")], "id int, text string")
    assert [(r.copies, r.first_id) for r in dedup.duplicate_texts(df, "id").collect()] == [(3, 1)]
    assert sorted(r.id for r in dedup.keep_first_text(df, "id").collect()) == [1, 2, 4, 5]


def test_text_stays_out_of_the_key_shuffles(spark, tmp_path):
    rows = [(i, f"u{i}", "a.com", f"t{i % 5}", "x" * 50) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA + ", text string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    out = dedup.dedup_cross_run(df, None, df.limit(0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("text:string" in s for s in scans) == 1 and len(scans) >= 2
    assert ids(out) == [0, 1, 2, 3, 4]
