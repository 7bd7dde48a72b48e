"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(E.QUERIES) - set(E.oracle_sql())
    assert rows_only == {"notes_roundtrip", "token_counts_bpe"}


def test_keys_see_rows():
    """No key compares nothing with nothing (see test_query_matches_oracle)."""
    assert set(E.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) & set(E.QUERIES)))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows) > 0
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "date"
