"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from seamark.plans import operations as plans

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if x is None or x != x else float(x) if isinstance(x, float) else x
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_equal(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(columns, found.fetchall())


def test_page_outcomes(spark):
    assert plans.QUERIES["h3_page_outcomes"](spark, SF).filter("outcome = 'parsed' and links > 0").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
