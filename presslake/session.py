"""Session defaults, and the written stages by which this library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "presslake", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution on.

    `master` and `shuffle_partitions` are left to the cluster unless given; AQE coalesces small shuffle
    partitions and splits skewed join partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder; on a cluster a machine-local folder would
    be lost with its executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        scratch = tempfile.mkdtemp(prefix="presslake-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        sc.setCheckpointDir(scratch)
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def _stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/presslake/{spark.sparkContext.applicationId}"


_own = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the stages written inside when the block ends, also after a failure.

    Gives `keep(df)`, which stages `df` like `staged` but leaves it to the surrounding block; a frame that outlives the block may
    be built on kept stages only.
    """
    outer, own = getattr(_own, "paths", None), []
    _own.paths = own

    def keep(df: DataFrame) -> DataFrame:
        inner, _own.paths = _own.paths, outer
        try:
            return staged(df)
        finally:
            _own.paths = inner

    try:
        yield keep
    finally:
        _own.paths = outer
        for path in own:
            _delete(spark, path)


def dropping_stages(job: Callable) -> Callable:
    """Delete the stages that `job(spark, …)` writes when it ends, also after a failure.

    For jobs that write their results and hand out no frame that is built on a stage.
    """
    @wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        with scratch(spark):
            return job(spark, *args, **kwargs)

    return run


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new folder for a stage, which goes with the stages of the surrounding `scratch` block."""
    path = f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder now and continue from the written rows.

    A table rather than a checkpoint, because the next steps read only some of its columns, and because its
    size is known to the planner. It survives the loss of any executor.
    """
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the stage that `staged` returned; any other frame is left alone."""
    if (path := df.__dict__.get("stage_path")) is not None:
        _delete(df.sparkSession, path)


def clear_stages(spark: SparkSession) -> None:
    """Delete the stages of this application. Frames that were built on them can no longer be read."""
    _delete(spark, _stage_root(spark))
