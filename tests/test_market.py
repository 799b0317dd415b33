"""Every query with SQL against DuckDB on a small table set."""

import os

import duckdb
import pytest

from tapeline.plans import context, market, reads, records, sessions, streams  # noqa: F401

DATA = os.environ.get("TAPELINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(rows):
    def one(x):
        return None if x is None or x != x else float(f"{x:.6g}") if isinstance(x, float) else x

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(market.SQL))
def test_matches_sql(spark, duck, name):
    got = market.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(market.SQL[name])
    assert sorted(want.columns) == cols
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_news_takes_every_event(spark, duck):
    n = duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    assert market.QUERIES["news_to_bar"](spark, DATA).count() == n
