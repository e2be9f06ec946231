"""Failure windows with timers, and the progress log."""

import datetime as dt
import random

from pyspark.sql import functions as F

from presslake.streaming import failures, ingest, progress

SCHEMA = "domain string, at timestamp, ok boolean"
DAYS = 2


def outcomes(seed=4, n=300):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"d{rng.randrange(6)}", start + dt.timedelta(seconds=rng.randrange(10 * 86400)), rng.random() < 0.15) for _ in range(n)]
    rows += [("quiet", start + dt.timedelta(hours=1), False), ("tie", start + dt.timedelta(days=9), False), ("tie", start + dt.timedelta(days=9), True), (None, start, False), ("null", None, False)]
    return sorted(rows, key=lambda r: str(r[1]))


def run(spark, folder, rows, parts):
    """Land the rows in some files in order of time, a micro-batch each, shuffled within."""
    rng = random.Random(1)
    for k in range(parts):
        part = rows[k * len(rows) // parts:(k + 1) * len(rows) // parts]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = failures.failing_domains(ingest.feed_stream(spark, f"{folder}/in", schema=spark.createDataFrame([], SCHEMA).schema), DAYS)
        with failures.column_families(spark):
            query = ingest.write_totals(stream, f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
    return query, ingest.read_totals(spark, f"{folder}/out", ["domain"])


def test_stream_equals_replay_and_state_stays_small(spark, tmp_path):
    rows = outcomes()
    query, told = run(spark, str(tmp_path), rows, 3)
    until = max(r[1] for r in rows if r[1]) - dt.timedelta(hours=1)
    wanted = {r.domain: r.failures for r in failures.replay(spark.createDataFrame(rows, SCHEMA), DAYS, until).collect()}
    got = {r.domain: r.failures for r in told.collect()}
    assert {d: n for d, n in got.items() if n} == wanted and wanted
    # One failure long ago: it was counted and has expired, and nothing is left of it in the state.
    assert got["quiet"] == 0 and "tie" not in wanted and "null" not in got
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"] if isinstance(query.lastProgress, dict) else query.lastProgress.stateOperators[0].numRowsTotal
    # Per domain: at most a number for each day of the window, a total, what waits for the watermark, and a timer with its index.
    assert state <= 7 * (DAYS + 1 + 4) + sum(r[1] is not None and r[1] >= until for r in rows)


def test_versions_of_totals_are_merged(spark, tmp_path):
    path = str(tmp_path / "totals")
    assert ingest.merge_totals(spark, path, ["k"]) is None
    for version, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 1)], [("a", 3)]]):
        spark.createDataFrame(rows, "k string, n long").write.parquet(f"{path}/version={version}")
    told = lambda: sorted(tuple(r) for r in ingest.read_totals(spark, path, ["k"]).select("k", "n").collect())
    assert told() == [("a", 3), ("b", 2), ("c", 1)]
    assert ingest.merge_totals(spark, path, ["k"]) == 2 and told() == [("a", 3), ("b", 2), ("c", 1)]
    assert [p.name for p in (tmp_path / "totals").glob("version=*")] == ["version=2"] and ingest.merge_totals(spark, path, ["k"]) is None


def test_replay_by_hand(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [("a", day(1), False), ("a", day(2), True), ("a", day(3), False), ("a", day(4, 5), False), ("b", day(1), False), ("c", day(5), False)]
    df = spark.createDataFrame(rows, SCHEMA)
    told = lambda until: {r.domain: r.failures for r in failures.replay(df, DAYS, until).collect()}
    assert told(day(4, 6)) == {"a": 2} and told(day(1, 1)) == {"a": 1, "b": 1} and told(day(6)) == {"a": 1, "c": 1} and told(day(20)) == {}


def test_every_micro_batch_is_logged(spark, tmp_path):
    spark.range(30).repartition(6).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    log = progress.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        landed = ingest.feed_stream(spark, str(tmp_path / "in"), schema=spark.range(0).schema, max_files=1)
        query = ingest.append_rows(landed, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        log.settle()
    finally:
        spark.streams.removeListener(log)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    told = progress.logged_progress(spark, str(tmp_path / "log"))
    assert len(query.recentProgress) <= 2 and told.count() >= 6
    assert sorted(r.batch for r in told.where("input_rows > 0").collect()) == list(range(6))
    (rate,) = progress.rates(told).collect()
    assert rate.input_rows == 30 and rate.batches == told.count() and rate.late_rows == 0 and rate.rows_per_second > 0
    assert progress.logged_progress(spark, str(tmp_path / "nothing")).count() == 0


class Calls:
    """A stand-in for the state of one domain that counts the messages sent to it."""

    def __init__(self):
        self.n, self.rows, self.value, self.timers = 0, [], None, set()

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            return {"getListState": lambda *_: self, "getValueState": lambda *_: Value(self), "appendValue": self.rows.append,
                    "get": lambda: iter(self.rows), "put": lambda r: setattr(self, "rows", r), "clear": lambda: setattr(self, "rows", []),
                    "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name](*args)
        return call


class Value:
    def __init__(self, calls):
        self.calls = calls

    def get(self):
        self.calls.n += 1
        return self.calls.value

    def update(self, value):
        self.calls.n += 1
        self.calls.value = value

    def clear(self):
        self.calls.n += 1
        self.calls.value = None


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_domain_takes_few_state_messages(spark):
    state, window = Calls(), failures.FailureWindow(DAYS)
    window.init(state)
    state.n = 0
    day = failures.DAY_MS
    rows = spark.createDataFrame([(day * k // 10, k == 3) for k in range(20)], "at_ms long, ok boolean").collect()
    list(window.handleInputRows(("d",), iter(rows), None))
    assert state.timers == {0} and state.n <= 4
    state.n, state.timers = 0, set()
    told = list(window.handleExpiredTimer(("d",), Now(day), None))
    # Rows 4 to 9 have failed since the success; row 10 wakes the domain next.
    assert [(r.domain, r.failures) for r in told] == [("d", 6)] and state.timers == {day} and state.n <= 6
    state.timers = set()
    assert [r.failures for r in window.handleExpiredTimer(("d",), Now(3 * day), None)] == [10] and state.timers == {4 * day}
    state.timers = set()
    assert [r.failures for r in window.handleExpiredTimer(("d",), Now(5 * day), None)] == [0]
    assert not state.timers and not state.rows and state.value is None
