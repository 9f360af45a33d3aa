"""Every registered query of the panel library against its SQL, on the small tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(data):
    return sorted((tuple(map(plain, r)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    cur = con.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.select(*names).collect())) == rows(cur.fetchall())


def test_queries_without_sql_have_tests_of_their_own():
    assert set(registry.QUERIES) - set(registry.SQL) == {"b51_sign_flip_whole"}  # tests/test_sign_flip.py


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
