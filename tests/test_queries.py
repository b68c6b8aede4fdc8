"""Every registered query with SQL gives the rows of DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.operators import sketch as K
from quillon.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    norm = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sketch_bounds(spark):
    df = spark.range(5000).select("id")
    m, k = K.bloom_size(5000)
    bits = K.bloom_bits(df, "id", m, k)
    assert K.bloom_matches(df, "id", bits, m, k).count() == 5000
    other = spark.range(10_000, 15_000).select("id")
    assert K.bloom_matches(other, "id", bits, m, k).count() < 5000 * 3 * K.bloom_rate(5000, m, k)
    assert abs(K.hll_estimate(K.hll_registers(df, "id")).first()[0] / 5000 - 1) < 0.1
    cells = K.cms_cells(df, "id")
    assert K.cms_estimate(df.limit(100), "id", cells).where("estimate < 1").count() == 0
