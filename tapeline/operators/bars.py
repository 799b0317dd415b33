"""Roll-ups of trades to bars, and bar hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.clock import ny_date


#: Bars that a day of one symbol may be filled to: a bar per second.
MOST_STEPS = 86_400


def rollup(trades: DataFrame, minutes: int) -> DataFrame:
    """(symbol, t, p, s) to OHLCV bars (symbol, t, o, h, l, c, v, vw); one partial aggregation and one shuffle by symbol and bucket.

    Trades of one time follow each other by id where there is one, else by price and size.
    """
    order = F.struct("t", *(["id"] if "id" in trades.columns else ["p", "s"]))
    return (
        trades.groupBy("symbol", F.window("t", f"{minutes} minutes").alias("w"))
        .agg(
            F.min_by("p", order).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", order).alias("c"),
            F.sum("s").alias("v"), (F.sum(F.col("p") * F.col("s")) / F.sum("s")).alias("vw"),
        )
        .select("symbol", F.col("w.start").alias("t"), "o", "h", "l", "c", "v", "vw")
    )


def daily(trades: DataFrame) -> DataFrame:
    """Bars by New York date, the trading date; t is that date at midnight."""
    order = F.struct("t", *(["id"] if "id" in trades.columns else ["p", "s"]))
    g = trades.groupBy("symbol", ny_date(F.col("t")).alias("d")).agg(
        F.min_by("p", order).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", order).alias("c"), F.sum("s").alias("v"), (F.sum(F.col("p") * F.col("s")) / F.sum("s")).alias("vw")
    )
    return g.select("symbol", F.col("d").cast(trades.schema["t"].dataType).alias("t"), "o", "h", "l", "c", "v", "vw")


def fill_gaps(bars: DataFrame) -> DataFrame:
    """Per symbol and UTC date, every step between the first and last bar; missing bars repeat the previous close with v = 0 and synthetic = true.

    The step is the smallest spacing of the symbol's bars. Bars off the grid stay. A symbol of fewer
    than three bars, or with two bars at one time, stays as it is. A step that would put more than
    MOST_STEPS bars in a day (two stray bars close together) is an error.
    """
    gap = F.col("t") - F.lag("t").over(W.partitionBy("symbol").orderBy("t"))
    every = W.partitionBy("symbol")
    d = bars.select("symbol", "t", gap.alias("gap")).withColumns({"step": F.min("gap").over(every), "n": F.count("*").over(every)})
    ends = d.where("n >= 3 and step > interval '0' second").groupBy("symbol", F.to_date("t").alias("d")).agg(F.min("t").alias("a"), F.max("t").alias("z"), F.first("step").alias("step"))
    steps = (F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / (F.unix_micros(F.lit(0).cast("timestamp") + F.col("step")))
    checked = F.when(steps > MOST_STEPS, F.raise_error(F.format_string("bars of %s are too close together to fill gaps", F.col("symbol"))).cast("timestamp")).otherwise(F.col("z").cast("timestamp"))
    grid = ends.withColumn("z", checked.cast(bars.schema["t"].dataType)).select("symbol", F.explode(F.expr("sequence(a, z, step)")).alias("t"))
    joined = grid.join(bars, ["symbol", "t"], "full").withColumn("synthetic", F.col("c").isNull())
    last = F.last("c", ignorenulls=True).over(W.partitionBy("symbol", F.to_date("t")).orderBy("t"))
    return joined.select(
        "symbol", "t", *[F.coalesce(x, last).alias(x) for x in ("o", "h", "l")], last.alias("c"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("vw", last).alias("vw"), "synthetic"
    )


def merge_missing(held: DataFrame, fetched: DataFrame) -> DataFrame:
    """Held bars and those fetched bars whose (symbol, t) is not held; held rows win."""
    return held.unionByName(fetched.join(held.select("symbol", "t"), ["symbol", "t"], "left_anti"))


def average_daily_volume(days: DataFrame, window: int = 20) -> DataFrame:
    """Per symbol over completed days with volume (the last day is the forming one): mean of the last `window`, or the latest day's with fewer than 5."""
    last = F.max("t").over(W.partitionBy("symbol"))
    done = days.withColumn("last", last).where("t < last and v > 0").withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("t"))))
    got = done.where(F.col("n") <= window).groupBy("symbol").agg(F.count("*").alias("days"), F.avg("v").alias("mean"), F.max(F.when(F.col("n") == 1, F.col("v"))).cast("double").alias("latest"))
    return got.select("symbol", "days", F.when(F.col("days") < 5, F.col("latest")).otherwise(F.col("mean")).alias("adv"))
