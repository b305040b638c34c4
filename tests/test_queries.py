"""Every registered query with SQL against DuckDB, on the smallest data folder."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.functions import texts
from cairn.plans import catalog, scalars
from cairn.plans.tables import BASE

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, data, name):
    found = catalog.QUERIES[name](spark, data)
    expected = duck.sql(catalog.ORACLES[name])
    kinds = {n: KINDS.get(t, t) for n, t in found.dtypes}
    assert kinds == dict(zip(expected.columns, map(str, expected.types)))
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_byte_sizes_beyond_64_bits_and_as_printf_rounds(spark, duck):
    """Keys whose sizes the SQL's BIGINT can't hold, with HUGEINT in its place."""
    keys = [0, 1, 2, 9, 100, 131_040, 131_041, 463_853, 691_595, 899_999, 100_000_000]
    sql = catalog.ORACLES["t10_byte_sizes"].replace("AS BIGINT)", "AS HUGEINT)").replace("c_custkey * c_custkey *", "c_custkey::HUGEINT * c_custkey *").replace("FROM customer", f"FROM (SELECT unnest({keys})::BIGINT AS c_custkey)")
    df = spark.createDataFrame([(k,) for k in keys], "c_custkey long")
    assert sorted(map(tuple, scalars.t10_byte_sizes(df).collect())) == sorted(duck.sql(sql).fetchall())


def test_byte_sizes_halfway(spark, duck):
    sizes = [1023, 1024, 1280, 1792, 1_048_525, 1_048_575, 1_310_720, 1_835_008, 1_207_959_552, 1_079_110_533, (1 << 40) + (1 << 37), (1 << 40) + 3 * (1 << 37), None]
    shown = "CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END"
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    found = {r["n"]: r["s"] for r in df.select("n", texts.byte_size(F.col("n")).alias("s")).collect()}
    assert found == dict(duck.execute(f"SELECT n, {shown} FROM (SELECT unnest($1::BIGINT[]) AS n)", [sizes]).fetchall())
    assert found[1280] == "1.2 KB" and found[1792] == "1.8 KB" and found[None] is None
