"""Alerts, changes and held conditions over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by():
    return W.partitionBy("symbol").orderBy("t")


def compare(value: Column, condition: Column, threshold: Column) -> Column:
    """'above' is at least, 'below' is at most; nulls are false."""
    return F.coalesce(F.when(condition == "above", value >= threshold).when(condition == "below", value <= threshold), F.lit(False))


def fire(rows: DataFrame, alerts: DataFrame, sets: tuple[str, ...] = ()) -> DataFrame:
    """The first hit of each set of one-shot alerts (alert_id, symbol, field, condition, threshold) over rows (symbol, t, fields...).

    A hit clears its whole set, whatever symbol it is on. `sets` names columns of `alerts` that tell
    sets apart; without them all alerts are one. Of hits at one time the smallest alert_id counts.
    """
    fields = [c for c in rows.columns if c not in ("symbol", "t")]
    long = rows.unpivot(["symbol", "t"], fields, "field", "value")
    hit = long.join(alerts, ["symbol", "field"]).where(compare(F.col("value"), F.col("condition"), F.col("threshold")))
    first = hit.groupBy(*sets).agg(F.min(F.struct("t", "alert_id", "symbol", "field", "value")).alias("_x")).where("_x is not null")
    return first.select("_x.alert_id", "_x.symbol", "_x.field", F.col("_x.t").alias("fired_at"), "_x.value")


def changes(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose value differs from the previous one of their symbol; the first row counts."""
    d = rows.withColumns({"_p": F.lag(column).over(by()), "_n": F.row_number().over(by())})
    return d.where((F.col("_n") == 1) | ~F.col(column).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def held(rows: DataFrame, condition: Column) -> DataFrame:
    """Maximal runs of rows on which a condition holds: (symbol, start, end, n)."""
    d = rows.withColumns({"_ok": F.coalesce(condition, F.lit(False)), "_n": F.row_number().over(by())}).where("_ok")
    d = d.withColumn("_run", F.col("_n") - F.row_number().over(by()))
    return d.groupBy("symbol", "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).drop("_run")


def held_for(rows: DataFrame, condition: Column, seconds: int) -> DataFrame:
    """(symbol, start, fired_at): of each run on which a condition holds, the first row at least `seconds` after the run's first."""
    d = rows.withColumns({"_ok": F.coalesce(condition, F.lit(False)), "_n": F.row_number().over(by())}).where("_ok")
    d = d.withColumn("_run", F.col("_n") - F.row_number().over(by()))
    d = d.withColumn("start", F.min("t").over(W.partitionBy("symbol", "_run")))
    long = F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp")) >= seconds * 1_000_000
    return d.where(long).groupBy("symbol", "start").agg(F.min("t").alias("fired_at"))


def latched(rows: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """The first row of each key, in time, on which a condition holds; of rows at one time the one with the smallest id, where there is one."""
    order = F.struct("t", *[c for c in ("id",) if c in rows.columns])
    first = rows.where(condition).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_x"))
    return first.select(*keys, "_x.*")


def price_alert(trades: DataFrame, condition: str, threshold: float, seconds: int = 60, slice_seconds: int = 86_400) -> DataFrame:
    """trades (symbol, t, p) with `met`: some price of the last `seconds`, the row's own included, meets an 'above' or 'below' threshold.

    A symbol is cut into time slices, each with the rows of the last `seconds` before it.
    """
    length = max(slice_seconds, seconds) * 1_000_000
    us = F.unix_micros(F.col("t").cast("timestamp"))
    own = F.floor(us / length)
    d = trades.withColumn("_own", own).withColumn("_s", F.explode(F.array_distinct(F.array(own, F.floor((us + seconds * 1_000_000) / length)))))
    w = W.partitionBy("symbol", "_s").orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    best = {"above": F.max("p"), "below": F.min("p")}[condition].over(w)
    d = d.withColumn("met", compare(best, F.lit(condition), F.lit(threshold))).where(F.col("_own").eqNullSafe(F.col("_s")))
    return d.drop("_own", "_s")


def trailing_stop(bars: DataFrame, percent: float = 5.0) -> DataFrame:
    """Running highest close, its stop and whether the close has fallen to it."""
    high = F.max("c").over(by().rowsBetween(W.unboundedPreceding, 0))
    return bars.select("symbol", "t", "c", high.alias("high"), (high * (1 - percent / 100)).alias("stop"), (F.col("c") <= high * (1 - percent / 100)).alias("hit"))


def ratchet_stop(prices: DataFrame, brackets: DataFrame) -> DataFrame:
    """prices (symbol, t, c) against one bracket per symbol (armed_at, entry, armed, target): the trailing stop at each time.

    It stays at `armed` until the high since arming has cleared entry by one risk (entry less
    armed), then covers the share of its way to the target that the high has covered. Brackets
    armed at or above the entry don't move.
    """
    d = prices.join(brackets, "symbol").where("t >= armed_at")
    d = d.withColumn("high", F.max("c").over(by().rowsBetween(W.unboundedPreceding, 0)))
    progress = F.least(F.lit(1.0), (F.col("high") - F.col("entry")) / (F.col("target") - F.col("entry")))
    on = (F.col("armed") < F.col("entry")) & (F.col("target") > F.col("entry")) & (F.col("high") >= 2 * F.col("entry") - F.col("armed"))
    stop = F.when(on, F.round(F.col("armed") + progress * (F.col("target") - F.col("armed")), 4)).otherwise(F.col("armed"))
    return d.select("symbol", "t", "c", "high", stop.alias("stop"), (F.col("c") <= stop).alias("hit"))
