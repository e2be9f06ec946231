"""Failures per domain on a stream, with arbitrary state: they expire after some days and a success resets them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
OUTCOME = "domain string, at timestamp, ok boolean"
#: What each change of a domain gives: its failures as of `told_at`, the watermark at which they were counted.
FAILING = "domain string, failures bigint, told_at timestamp"
#: Streams with this operator need a state store with column families.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _together(rows: list[tuple[int, bool]]) -> tuple[list[int], list[bool]]:
    """Rows as one element of a list state: what one micro-batch brings of a domain."""
    return [at for at, _ in rows], [ok for _, ok in rows]


class FailureWindow(StatefulProcessor):
    """Failures of one domain since its last success, by day.

    Rows wait until the watermark has passed them and then count in order of time, so the result does not depend on how they
    arrive. State is what waits and one value: a number for each of the last `days` days with failures, what was told, and
    the moment of the one timer, which stands for what happens next: the first waiting row, or the day that expires first.
    Every access to state is a message to the JVM, so there are few: with many domains these take most of the time.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<bigint>, ok array<boolean>")
        self.counted = handle.getValueState("counted", "days array<bigint>, failures array<bigint>, told bigint, wake bigint")

    def _held(self) -> tuple[dict[int, int], int, int | None]:
        held = self.counted.get()
        if held is None:
            return {}, 0, None
        days, failures, told, wake = held
        return dict(zip(days, failures)), told, wake

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(int(r.at_ms), bool(r.ok)) for r in rows]
        self.waiting.appendValue(_together(came))
        first = min(at for at, _ in came)
        counts, told, wake = self._held()
        if wake is None or first < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first)
            self.counted.update((list(counts), list(counts.values()), told, first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        counts, told, _ = self._held()
        rows = sorted(row for ats, oks in self.waiting.get() for row in zip(ats, oks))
        for at, ok in rows:
            if at >= now:
                break
            # A success at the same moment comes after the failures: false sorts before true.
            if ok:
                counts.clear()
            else:
                counts[at // DAY_MS] = counts.get(at // DAY_MS, 0) + 1
        left = [r for r in rows if r[0] >= now]
        counts = {day: n for day, n in counts.items() if (day + self.days + 1) * DAY_MS > now}
        if len(left) < len(rows):
            self.waiting.put([_together(left)]) if left else self.waiting.clear()
        nexts = [at for at, _ in left[:1]] + [(day + self.days + 1) * DAY_MS for day in counts]
        total = sum(counts.values())
        # The timer that has gone off leaves by itself.
        if nexts:
            self.handle.registerTimer(min(nexts))
            self.counted.update((list(counts), list(counts.values()), total, min(nexts)))
        else:
            self.counted.clear()
        if total != told:
            yield Row(domain=key[0], failures=total, told_at=dt.datetime.fromtimestamp(now / 1000, dt.timezone.utc))

    def close(self) -> None:
        pass


def failing_domains(outcomes: DataFrame, days: int, late: str = "1 hour") -> DataFrame:
    """Stream of (domain, at, ok) as changes of `failures` per domain (FAILING); start it in update mode.

    A failure counts from the moment the watermark has passed it until `days` whole days after its own day, or until a success of
    its domain. Rows later than `late` are dropped. Rows without domain, time or outcome are left out.
    """
    rows = outcomes.dropna(subset=["domain", "at", "ok"]).select("domain", "at", F.unix_millis("at").alias("at_ms"), "ok")
    return rows.withWatermark("at", late).groupBy("domain").transformWithState(
        statefulProcessor=FailureWindow(days), outputStructType=FAILING, outputMode="Update", timeMode="EventTime")


def replay(outcomes: DataFrame, days: int, until: dt.datetime) -> DataFrame:
    """(domain, failures): the same count from a table, as of `until`; domains without failures are not there."""
    rows = outcomes.dropna(subset=["domain", "at", "ok"]).where(F.col("at") < F.lit(until))
    reset = F.max(F.when(F.col("ok"), F.col("at"))).over(Window.partitionBy("domain"))
    open_ = F.to_timestamp(F.date_add(F.to_date("at"), days + 1)) > F.lit(until)
    kept = rows.withColumn("reset", reset).where(~F.col("ok") & open_ & (F.col("reset").isNull() | (F.col("at") > F.col("reset"))))
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("failures"))


@contextmanager
def column_families(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside get the state store that this operator needs."""
    key, provider = STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)
