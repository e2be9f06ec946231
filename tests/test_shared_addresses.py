"""Registered queries on pages of which many share an address."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, check, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The given tables, with one address for all pages of a host."""
    sf_dir = tmp_path_factory.mktemp("shared")
    for name in TABLES.split():
        if name != "pages":
            os.symlink(f"{SF_DIR}/{name}.parquet", sf_dir / f"{name}.parquet")
    address = "regexp_replace(url, '^([^:]*://[^/?#]*).*', '\\1/same#top')"
    duckdb.sql(f"COPY (SELECT * REPLACE ({address} AS url) FROM '{SF_DIR}/pages.parquet') TO '{sf_dir}/pages.parquet' (FORMAT parquet)")
    return str(sf_dir)


@pytest.mark.parametrize("name", ["stream_ingest", "monitor_topics", "title_repair"])
def test_pages_that_share_an_address_are_articles_of_their_own(spark, shared, name):
    con = connect(shared)
    assert con.sql("SELECT count(*) > count(DISTINCT url) FROM pages").fetchall()[0][0]
    problems, _, _ = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], shared)
    assert not problems
