"""Ledgers (account, seq, ts, symbol, action, price): equity, round trips, extremes and session counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.operators.joins import asof_backward, running_sums

FEE = 1.15


def positions(ledger: DataFrame, cash: float = 1000.0, fee: float = FEE) -> DataFrame:
    """(symbol, ts, position, cash, fees) of all accounts together after each time at which a symbol is traded, one share a trade; in time slices."""
    side = F.when(F.col("action") == "buy", 1).otherwise(-1)
    g = ledger.groupBy("symbol", "ts").agg(F.sum(side).alias("position"), F.sum(side * F.col("price") + fee).alias("cash"), F.count("*").alias("fees"))
    d = running_sums(g, "symbol", "ts", ["position", "cash", "fees"])
    return d.select("symbol", "ts", "position", (F.lit(cash) - F.col("cash")).alias("cash"), (F.col("fees") * fee).alias("fees"))


def equity_curve(bars: DataFrame, ledger: DataFrame, cash: float = 1000.0) -> DataFrame:
    """Per bar: cash and position of the latest trades at or before it, marked at the bar's close."""
    d = asof_backward(bars.select("symbol", "t", "c"), positions(ledger, cash), "symbol", "t", "ts", ["cash", "position"])
    return d.select("symbol", "t", (F.coalesce("cash", F.lit(cash)) + F.coalesce("position", F.lit(0)) * F.col("c")).alias("equity"))


def best_round_trip(bars: DataFrame) -> DataFrame:
    """Largest rise in percent from any earlier (or the same) positive close; never below zero."""
    low = F.min("c").over(W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return bars.where("c > 0").withColumn("r", (F.col("c") / low - 1) * 100).groupBy("symbol").agg(F.greatest(F.max("r"), F.lit(0.0)).alias("best_pct"))


def ordered_extremes(bars: DataFrame) -> DataFrame:
    """Lowest and highest close (first of equals), the highest from the lowest on and the lowest up to the highest."""
    low, high = F.struct("c", "t"), F.struct(-F.col("c"), F.col("t"))
    g = bars.groupBy("symbol").agg(F.min_by("t", low).alias("t_min"), F.min_by("t", high).alias("t_max"), F.min("c").alias("min"), F.max("c").alias("max"))
    d = bars.join(g, "symbol")
    return d.groupBy("symbol").agg(
        F.first("min").alias("min"), F.first("max").alias("max"),
        F.max(F.when(F.col("t") >= F.col("t_min"), F.col("c"))).alias("max_after_min"), F.min(F.when(F.col("t") <= F.col("t_max"), F.col("c"))).alias("min_before_max"),
    )


def summary(ledger: DataFrame, fee: float = FEE) -> DataFrame:
    """Trades, buys, sells, fees and realised result per symbol."""
    sign = F.when(F.col("action") == "sell", F.col("price")).otherwise(-F.col("price"))
    return ledger.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.count_if(F.col("action") == "buy").alias("buys"), F.count_if(F.col("action") == "sell").alias("sells"), (F.count("*") * fee).alias("fees"), F.sum(sign).alias("cash_flow")
    )
