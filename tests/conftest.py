import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from presslake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", "presslake-tests", 2,
        **{"spark.ui.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "true",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def salted(spark):
    """Deal shuffles over many tasks, so that groups of test size are hot and the salted joins run."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
