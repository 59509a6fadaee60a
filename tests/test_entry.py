"""Every query of the library against its SQL over the smallest tables."""

import datetime as dt
import decimal
import math
import os

import pytest

from textwarden.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        return
    rel = sql.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


#: Orders whose MD5 has digits only (6637317 and 1518375), and keys of more than six digits.
LARGE_KEYS = [6637317, 1518375, 5, 6, 7, 8, 999998, 999999, 1000000, 1000001, 1234566, 10000000]


@pytest.mark.parametrize("name", ["detect_attribute_secret", "detect_env_fallback", "skip_own_placeholders", "detect_custom"])
def test_large_keys(spark, sql, tmp_path, name):
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    rows = [(k, k % 97, "F", 1.0, dt.datetime(2024, 1, 1), "5-LOW") for k in LARGE_KEYS]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).select("o_orderkey", "entity", "value").collect()}
    con = sql.cursor()
    con.sql(f"create temp view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == set(con.sql(catalogue.oracle_sql()[name]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
