"""Option chains (symbol, strike, call_oi, put_oi, iv): walls, gamma exposure and the flip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_sides(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """calls and puts (symbol, strike, oi, iv) to one chain; a missing or NaN value is zero."""
    c, p = (x.select("symbol", "strike", F.col("oi").alias(f"{k}_oi"), F.col("iv").alias(f"{k}_iv")) for x, k in ((calls, "call"), (puts, "put")))
    d = c.join(p, ["symbol", "strike"], "full")
    return d.select("symbol", "strike", *[F.coalesce(F.nanvl(F.col(k).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(k) for k in ("call_oi", "put_oi", "call_iv", "put_iv")])


def gamma_exposure(chain: DataFrame, spot: float, years: float = 30 / 365, rate: float = 0.045) -> DataFrame:
    """Adds gamma (Black-Scholes, zero without volatility) and net_gamma: dealers long calls and short puts, per 1 % move of 100-share contracts."""
    root = F.col("iv") * years**0.5
    d1 = (F.log(F.lit(spot) / F.col("strike")) + (rate + F.col("iv") ** 2 / 2) * years) / root
    gamma = F.when(F.col("iv") > 0, F.exp(-(d1**2) / 2) / (2 * 3.141592653589793) ** 0.5 / (spot * root)).otherwise(0.0)
    d = chain.withColumn("gamma", gamma)
    return d.withColumn("net_gamma", F.col("gamma") * (F.col("call_oi") - F.col("put_oi")) * 100 * spot * spot * 0.01)


def walls(chain: DataFrame) -> DataFrame:
    """Strikes with the largest call and put open interest; of equals the lowest."""
    top = lambda k: F.max_by("strike", F.struct(F.col(k), -F.col("strike")))
    return chain.groupBy("symbol").agg(top("call_oi").alias("call_wall"), top("put_oi").alias("put_wall"), F.sum("call_oi").alias("call_oi"), F.sum("put_oi").alias("put_oi"))


def gamma_flip(exposure: DataFrame) -> DataFrame:
    """First strike where cumulative net gamma turns from negative to non-negative, interpolated."""
    w = W.partitionBy("symbol").orderBy("strike")
    d = exposure.withColumn("cum", F.sum("net_gamma").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumns({"pc": F.lag("cum").over(w), "ps": F.lag("strike").over(w)}).where("pc < 0 and cum >= 0")
    flip = F.col("ps") + (F.col("strike") - F.col("ps")) * (-F.col("pc")) / (F.col("cum") - F.col("pc"))
    return d.groupBy("symbol").agg(F.min_by(flip, "strike").alias("flip"))
