"""Window indicators. Each takes bars (symbol, t, o, h, l, c, v) and adds columns; values are null until a window is full.

All windows of one call share the partitioning by symbol and the order by t, so a plan has one
exchange and one sort whatever the number of indicators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by():
    return W.partitionBy("symbol").orderBy("t")


def over(n: int):
    return by().rowsBetween(-(n - 1), 0)


def full(value: Column, counted: Column, n: int) -> Column:
    return F.when(F.count(counted).over(over(n)) == n, value)


def sma(bars: DataFrame, n: int, out: str = "sma") -> DataFrame:
    return bars.withColumn(out, full(F.avg("c").over(over(n)), F.col("c"), n))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength with simple means; no loss in the window gives 100."""
    d = bars.withColumn("_d", F.col("c") - F.lag("c").over(by()))
    gain, loss = (F.avg(F.greatest(x, F.lit(0.0))).over(over(n)) for x in (F.col("_d"), -F.col("_d")))
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    return d.withColumn("rsi", full(value, F.col("_d"), n)).drop("_d")


def true_range() -> Column:
    """The first row has no previous close: its range is high less low (greatest skips nulls)."""
    pc = F.lag("c").over(by())
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - pc), F.abs(F.col("l") - pc))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of the last n bars."""
    d = bars.withColumn("_tr", true_range())
    return d.withColumn("atr", full(F.avg("_tr").over(over(n)), F.col("_tr"), n)).drop("_tr")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement index with simple means; null where the directional sum is zero anywhere in the window."""
    up, down = F.col("h") - F.lag("h").over(by()), F.lag("l").over(by()) - F.col("l")
    d = bars.withColumns({"_tr": true_range(), "_p": F.when((up > down) & (up > 0), up).otherwise(0.0), "_m": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    a = {k: full(F.avg(k).over(over(n)), F.col(k), n) for k in ("_tr", "_p", "_m")}
    d = d.withColumns({f"{k}s": v for k, v in a.items()})
    p, m = (F.when(F.col("_trs") != 0, 100 * F.col(k) / F.col("_trs")) for k in ("_ps", "_ms"))
    d = d.withColumns({"plus_di": p, "minus_di": m}).withColumn("_dx", F.when(F.col("plus_di") + F.col("minus_di") != 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / (F.col("plus_di") + F.col("minus_di"))))
    return d.withColumn("adx", full(F.avg("_dx").over(over(n)), F.col("_dx"), n)).drop("_tr", "_p", "_m", "_trs", "_ps", "_ms", "_dx")


def obv(bars: DataFrame, n: int = 20) -> DataFrame:
    """On-balance volume and its trend over n rows: rising, falling or flat."""
    d = bars.withColumn("_d", F.coalesce(F.signum(F.col("c") - F.lag("c").over(by())), F.lit(0.0)) * F.col("v"))
    d = d.withColumn("obv", F.sum("_d").over(by().rowsBetween(W.unboundedPreceding, 0)))
    step = F.col("obv") - F.lag("obv", n - 1).over(by())
    return d.withColumn("obv_trend", F.when(step > 0, "rising").when(step < 0, "falling").when(step == 0, "flat")).drop("_d")


def vwma(bars: DataFrame, n: int, out: str = "vwma") -> DataFrame:
    value = F.sum(F.col("c") * F.col("v")).over(over(n)) / F.nullif(F.sum("v").over(over(n)), F.lit(0))
    return bars.withColumn(out, full(value, F.col("c"), n))


def vwap_bands(bars: DataFrame) -> DataFrame:
    """Running VWAP per UTC date with volume-weighted deviation about each row's own VWAP, and the close's z-score."""
    w = W.partitionBy("symbol", F.to_date("t")).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    d = bars.withColumn("vwap", F.sum(tp * F.col("v")).over(w) / F.sum("v").over(w))
    d = d.withColumn("sigma", F.sqrt(F.sum(F.col("v") * (tp - F.col("vwap")) ** 2).over(w) / F.sum("v").over(w)))
    return d.withColumn("z", F.when(F.col("sigma") > 1e-9, (F.col("c") - F.col("vwap")) / F.col("sigma")))


def features(bars: DataFrame) -> DataFrame:
    """Return, log return, 20-row extremes, volatility (sample deviation of the log returns of 20 rows), volume z-score and 5- and 20-row log-price slopes."""
    log = F.log("c")
    d = bars.withColumns({"_x": F.row_number().over(by()), "_y": log}).withColumn("_r", F.col("_y") - F.lag("_y").over(by()))
    return d.withColumns(
        {
            "ret": F.col("c") / F.lag("c").over(by()) - 1,
            "log_ret": log - F.lag(log).over(by()),
            "high_20": full(F.max("h").over(over(20)), F.col("h"), 20),
            "low_20": full(F.min("l").over(over(20)), F.col("l"), 20),
            "vol_z": full((F.col("v") - F.avg("v").over(over(20))) / F.nullif(F.stddev_samp("v").over(over(20)), F.lit(0.0)), F.col("v"), 20),
            "volatility_20": full(F.stddev_samp("_r").over(over(20)), F.col("_r"), 20),
            **{f"slope_{n}": full(F.regr_slope("_y", "_x").over(over(n)), F.col("_y"), n) for n in (5, 20)},
        }
    ).drop("_x", "_y", "_r")


def beta(days: DataFrame, market: str, least: int = 20) -> DataFrame:
    """Sample covariance over variance of daily returns with the market symbol's, on common dates."""
    r = days.withColumn("r", F.col("c") / F.lag("c").over(by()) - 1).where("r is not null").select("symbol", "t", "r")
    m = r.where(F.col("symbol") == market).select("t", F.col("r").alias("m"))
    both = r.where(F.col("symbol") != market).join(m, "t")
    out = both.groupBy("symbol").agg(F.count("*").alias("n"), (F.covar_samp("r", "m") / F.var_samp("m")).alias("beta"))
    return out.select("symbol", "n", F.when(F.col("n") >= least, F.col("beta")).alias("beta"))


def trend(bars: DataFrame) -> DataFrame:
    """One row per symbol: a vote of close against SMA 20 and 200, SMA 20 against 50 and the change over all bars (1 % either way).

    Two votes or more make a bullish or bearish regime, three a strong one.
    """
    whole = W.partitionBy("symbol")
    d = rsi(sma(sma(sma(bars, 20, "sma_20"), 50, "sma_50"), 200, "sma_200"))
    d = d.withColumns({"_n": F.row_number().over(whole.orderBy(F.desc("t"))), "_first": F.first("c").over(by().rowsBetween(W.unboundedPreceding, 0))}).where("_n = 1")
    vote = lambda a, b: F.coalesce(F.signum(F.col(a) - F.col(b)), F.lit(0.0))
    pct = F.when(F.col("_first") != 0, (F.col("c") / F.col("_first") - 1) * 100).otherwise(0.0)
    score = vote("c", "sma_20") + vote("sma_20", "sma_50") + vote("c", "sma_200") + F.when(pct > 1, 1).when(pct < -1, -1).otherwise(0)
    regime = F.when(F.col("score") >= 2, "bullish").when(F.col("score") <= -2, "bearish").otherwise("neutral")
    strength = F.when(F.abs("score") >= 3, "strong").when(F.abs("score") == 2, "moderate").otherwise("weak")
    return d.withColumns({"pct_change": pct, "score": score.cast("int")}).withColumns({"trend": regime, "strength": strength}).drop("_n", "_first")
