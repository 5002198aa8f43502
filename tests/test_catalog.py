"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted((tuple(None if pd.isna(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return made


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_queries_without_sql_are_tested_elsewhere():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"embedding_chunks", "html_texts", "fuzzy_titles"}
