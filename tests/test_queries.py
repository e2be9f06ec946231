import pytest

import __spark_entry__ as entry
from compare import check, connect
from presslake.plans import queries as registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry.queries().items() if name in registry.QUERIES}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    problems, rows, _ = check(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems


@pytest.mark.parametrize("name", ["page_text", "classify_keywords", "canonical_articles", "domain_category", "daily_statistics"])
def test_no_row_at_a_time_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["language", "topic", "articles", "hits", "confidence"] and df.count() > 0
