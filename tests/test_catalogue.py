import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("q"))


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(cursor_rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = oracle.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert rows(df.select(*columns).collect()) == rows(expected.select(*columns).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == duckdb.sql(f"SELECT count(DISTINCT l_orderkey) FROM '{SF}/lineitem.parquet'").fetchall()[0][0]


def test_coercion_failures(spark):
    from pyspark.sql import functions as F

    from lumenfold.functions import coerce

    df = spark.createDataFrame([("1\\2/ 3",), ("1\\x",), ("\\",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(coerce.to_doubles(F.col("t"))).collect()] == [[1.0, 2.0, 3.0], None, None, None, None]
    assert [r[0] for r in df.select(coerce.multiplicity(F.col("t"))).collect()] == [2, 2, 2, 0, None]
    pn = spark.createDataFrame([("A^B=C=D",), ("A=B=C=D",), ("1^2^3^4^5^6",)], "t string").select(coerce.person_name(F.col("t")).alias("n")).collect()
    assert pn[0].n.alphabetic == ["A", "B"] and pn[1].n is None and pn[2].n is None
