"""Progress of streams in a table: a listener lands every event, so none is lost to the bounded buffer of a query."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from presslake.sources.readers import path_exists

PROGRESS = ("query_id string, run_id string, name string, batch long, started_at string, input_rows long, "
            "input_per_second double, processed_per_second double, seconds double, state_rows long, late_rows long")


class ProgressLog(StreamingQueryListener):
    """Writes one row for each micro-batch of every query below `path`, under the run and the number of the batch.

    A micro-batch that is reported again replaces its own row. What could not be written is kept and raised by `check`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.failed: list[Exception] = []
        self._one = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond,
               p.durationMs.get("triggerExecution", 0) / 1000, sum(s.numRowsTotal for s in p.stateOperators),
               sum(s.numRowsDroppedByWatermark for s in p.stateOperators))
        try:
            with self._one:
                made = self.spark.createDataFrame([row], PROGRESS).coalesce(1)
                made.write.mode("overwrite").parquet(f"{self.path}/run={p.runId}/number={p.batchId}")
        except Exception as error:  # the bus would only log it
            self.failed.append(error)

    def settle(self) -> None:
        """Wait until all events so far have been handled, and raise what went wrong."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self._one:
            if self.failed:
                raise self.failed[0]


def logged_progress(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches that `ProgressLog` has written below `path`."""
    if not path_exists(spark, f"{path}/run=*"):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).parquet(path).select(*[c.split()[0] for c in PROGRESS.split(", ")])


def rates(progress: DataFrame) -> DataFrame:
    """Per run: micro-batches, rows, rows dropped as late, seconds, rows per second over the whole run, and the most rows of state."""
    return progress.groupBy("query_id", "run_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"),
        F.sum("seconds").alias("seconds"), (F.sum("input_rows") / F.sum("seconds")).alias("rows_per_second"), F.max("state_rows").alias("state_rows"))
