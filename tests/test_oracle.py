"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir, tmp_path_factory):
    import duckdb

    c = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duckdb"))})
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    assert check.compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
