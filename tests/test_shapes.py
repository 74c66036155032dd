"""A report over small documents of all formats and varied shapes gives the rows that were worked out for it by hand."""

import duckdb

from shape_documents import SQL, said
from test_oracles import rows


def test_facts_of_all_formats(spark):
    assert rows(said(spark).toPandas()) == rows(duckdb.sql(SQL).fetchdf())
