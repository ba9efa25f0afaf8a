import glob

import duckdb
import pytest

import __spark_entry__ as entry
from presencekit import queries


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert (a[c] == b[c]).all(), c


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {f.rsplit('/', 1)[1].removesuffix('.parquet')} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.queries()) & set(queries.oracle_sql())))
def test_query_matches_sql(spark, sf, duck, name):
    same(queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_topn_and_components(spark, sf):
    assert queries.gwas_topn(spark, sf).count() > 0
    assert len(queries.pca_components(spark, sf).columns) == 6
