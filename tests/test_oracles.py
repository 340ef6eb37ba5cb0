"""Every registered query against the same query in SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from washboard.plans.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(REGISTRY) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in place) for r in result.fetchall()]
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert found, "no rows"
    assert ordered(found) == ordered(expected)


def test_entry(spark):
    report = entry_point.entry(spark)
    assert report.columns == ["uuid", "original_values", "cleaned_values", "manual_reviews", "is_dup", "is_dup_cnic"]
    assert report.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
