"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tagweave import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(df):
    columns = sorted(df.columns)
    shown = df[columns].astype(object).where(df[columns].notna(), None)


    def one(v):
        return str(int(v)) if isinstance(v, float) and v.is_integer() else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in shown.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name in queries.ORACLE_SQL:
        want = con.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_packet_filters_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from tagweave.sources import packets as store

    df = spark.range(100).select("id", (F.col("id") % 4).alias("part"))
    store.write(store.frame(df, 1, F.lit(0), F.col("part")), str(tmp_path / "p"))
    kept = store.read(spark, str(tmp_path / "p")).where("shard_id = 2")
    assert "EqualTo(shard_id,2)" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in store.unframe(kept, df.schema).collect()) == list(range(2, 100, 4))


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    assert len(got) and rows(got) == rows(want)


def test_batches_of_large_keys(spark, tmp_path):
    """Keys for which u32 and i32 are too narrow."""
    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 9000000 ELSE 0 END AS o_orderkey, o_custkey + o_orderkey % 3 * 900000 AS o_custkey) FROM '{FOLDER}/orders.parquet' LIMIT 60) TO '{tmp_path}/orders.parquet'")
    same_as_sql(spark, tmp_path, "batch_decode_all")


def test_scalars_of_large_keys(spark, tmp_path):
    """Keys for which i16 and u32 are too narrow."""
    duckdb.sql(f"COPY (SELECT * REPLACE (l_suppkey + l_linenumber * 20000 AS l_suppkey, l_orderkey + l_linenumber % 2 * 700000000 AS l_orderkey, l_partkey + l_linenumber % 3 * 3000000000 AS l_partkey) FROM '{FOLDER}/lineitem.parquet' LIMIT 60) TO '{tmp_path}/lineitem.parquet'")
    same_as_sql(spark, tmp_path, "le_decode")


def test_prices_about_bounds(spark, tmp_path):
    """Fractions above a bound are out of range."""
    prices = "[65534.5, 65535, 65535.01, 65535.49, 65535.5, 65536, 62767, 62767.26, 62767.5, 62768, 34028.23, 34028.24, 0, 900.68]"
    duckdb.sql(f"COPY (SELECT * REPLACE ({prices}[n] AS l_extendedprice) FROM (SELECT *, row_number() OVER () % 14 + 1 AS n FROM '{FOLDER}/lineitem.parquet' LIMIT 60)) TO '{tmp_path}/lineitem.parquet'")
    same_as_sql(spark, tmp_path, "numeric_range")
