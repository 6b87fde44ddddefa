"""Every query with SQL equals it on the smallest tables; the rest run."""

import math

import duckdb
import pytest

from pixelweave import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = plain([tuple(r) for r in df.collect()], df.columns)
    spark.catalog.clearCache()
    if name in catalogue.oracle_sql():
        rel = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows == plain(rel.fetchall(), rel.columns)
    else:
        assert rows
