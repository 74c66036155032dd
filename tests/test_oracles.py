"""Every query that has SQL beside it gives the same rows in both engines."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v.item() if hasattr(v, "item") else v) for v in r] for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_and_sql_agree(spark, oracle, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), oracle.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
