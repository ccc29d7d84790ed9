"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidepool.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if not isinstance(x, (list, str)) and pd.isna(x):
            return "null"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6g}"
        return str(x)

    columns = sorted(df.columns)
    return sorted(tuple(cell(x) for x in row) for row in df[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, wanted = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found) == plain(wanted)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_every_query_says_what_it_is():
    assert all(f.__doc__ for f in catalogue.QUERIES.values()) and len(catalogue.QUERIES) >= 60
