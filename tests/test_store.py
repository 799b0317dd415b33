"""The store, journals, exchange hours and small scans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.functions import clock
from tapeline.operators import scans
from tapeline.sources import store
from tests.test_operators import frame


def test_store_adds_missing_days_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    day = frame(spark, [1, 2, 3])
    assert store.read_bars(spark, path).count() == 0
    assert store.add_missing(spark, path, day).count() == 3
    later = day.withColumn("t", F.col("t") + F.expr("interval 1 day"))
    got = store.add_missing(spark, path, day.withColumn("c", F.lit(9.0)).union(later).union(day.withColumn("symbol", F.lit("a/b c")).limit(1)))
    assert sorted((r.symbol, r.day.day, r.c) for r in got.collect()) == [("X", d, float(c)) for d in (2, 3) for c in (1, 2, 3)] + [("a/b c", 2, 1.0)]
    assert (tmp_path / "bars" / "symbol=X" / "day=2024-01-02").exists() and store.add_missing(spark, path, day.where("false")).count() == 7


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    for k in (1, 2):
        store.append_journal(spark.createDataFrame([(k, "x")], "at int, what string"), path)
    (tmp_path / "j" / "bad.json").write_text("{not json\n")
    assert [r.at for r in store.read_journal(spark, path, "at int, what string", "at").collect()] == [2, 1]


@pytest.mark.parametrize(
    ("at", "is_open", "opens"),
    [
        ("2024-01-05 14:29:59", False, "2024-01-05 14:30:00"), ("2024-01-05 14:30:00", True, "2024-01-08 14:30:00"), ("2024-01-05 21:00:00", False, "2024-01-08 14:30:00"),
        ("2024-01-06 10:00:00", False, "2024-01-08 14:30:00"), ("2024-01-07 20:00:00", False, "2024-01-08 14:30:00"), ("2024-03-08 20:00:00", True, "2024-03-11 13:30:00"), ("2024-07-02 13:30:00", True, "2024-07-03 13:30:00"),
    ],
)
def test_hours(spark, at, is_open, opens):
    t = F.to_timestamp(F.lit(at))
    x = spark.range(1).select(clock.is_open(t).alias("o"), clock.next_open(t).alias("n"), clock.session_open(t).alias("s"), clock.seconds_to_open(t).alias("k")).first()
    want = dt.datetime.fromisoformat(opens)
    assert (x.o, x.n, x.k) == (is_open, want, (want - dt.datetime.fromisoformat(at)).total_seconds()) and (x.s is not None) == is_open


def test_small_scans(spark):
    assert spark.range(1).select(scans.dividend_return(F.lit(2.0), F.lit(0.0)).alias("x")).first().x == 20.0
    x = frame(spark, range(1, 8)).withColumn("id", F.col("v"))
    assert scans.lookback(x, "2024-01-02 14:33:00", 8, 2).count() == 2 and scans.window(x, "2024-01-02 14:30:00", "2024-01-02 14:32:00").count() == 2
    assert scans.news_page(x.select("id", "symbol", F.col("t").alias("created_at")), "2024-01-03", 0).count() == 1
