"""Session scoring: decisions (ts, symbol, action, status, value) and activation windows (strategy, regime, started_at, ended_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("buy", "sell")


def decision_quality(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by action, the share of filled buys and sells, and the return from the first to the last value in percent."""
    active = F.col("action").isin(*ACTIVE) & (F.col("status") == "filled")
    g = decisions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(active).alias("active"), F.min_by("value", "ts").alias("_a"), F.max_by("value", "ts").alias("_z"))
    return g.select(*keys, "n", "active", (F.col("active") / F.col("n")).alias("active_rate"), ((F.col("_z") / F.nullif("_a", F.lit(0.0)) - 1) * 100).alias("return_pct"))


def in_windows(windows: DataFrame, events: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Events inside each window, both ends included and an open end unbounded: an equi-join on the keys and time buckets.

    Windows are cut at buckets of `seconds`; an open window ends at the last event.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    last = events.groupBy(*keys).agg(F.max("ts").alias("_last"))
    w = windows.join(last, keys).withColumn("_end", F.coalesce("ended_at", "_last")).where("started_at <= _end")
    w = w.withColumn("_b", F.explode(F.sequence(bucket("started_at"), bucket("_end"))))
    hit = w.join(events.withColumn("_b", bucket("ts")), [*keys, "_b"])
    return hit.where("ts >= started_at and ts <= _end").drop("_b", "_end", "_last")


def strategy_stats(activations: DataFrame) -> DataFrame:
    """activations (strategy, regime, return_pct, active): per strategy the windows, effective ones (return above zero where known, else any activity), hit rate, mean return and regimes."""
    effective = F.when(F.col("return_pct").isNotNull(), F.col("return_pct") > 0).otherwise(F.col("active") > 0)
    g = activations.groupBy("strategy").agg(
        F.count("*").alias("activations"), F.count_if(effective).alias("effective"), F.count_if(F.col("active") == 0).alias("alert_only"), F.avg("return_pct").alias("mean_return"), F.sort_array(F.collect_set("regime")).alias("regimes")
    )
    return g.withColumn("hit_rate", F.col("effective") / F.col("activations"))


def breakout_geometry(entry: Column, stop: Column, base_height: Column, atr: Column, resistance: Column) -> Column:
    """A long breakout: targets one and two base heights and one and two ATR above the entry, each over the risk, the best
    ratio (2 at least is wanted), and the room below the next resistance (none if it is already cleared).

    Null unless 0 < stop < entry; a size or resistance that is null or not positive gives nulls of its own.
    """
    risk = F.when((stop > 0) & (stop < entry), entry - stop)
    sizes = {"1_base": base_height, "2_base": 2 * base_height, "1_atr": atr, "2_atr": 2 * atr}
    targets = {f"target{k}": F.when(size > 0, F.round(entry + size, 4)) for k, size in sizes.items()}
    ratios = {k.replace("target", "ratio"): F.round((target - entry) / risk, 2) for k, target in targets.items()}
    best = F.greatest(*ratios.values())
    at_resistance = F.when(resistance > entry, F.round((resistance - entry) / risk, 2))
    room = F.when(resistance > 0, (resistance <= entry) | (at_resistance >= 2))
    out = {"risk": F.round(risk, 4)} | targets | ratios | {"best": best, "meets": F.coalesce(best >= 2, F.lit(False)), "ratio_at_resistance": at_resistance, "room": room}
    return F.when(risk.isNotNull(), F.struct(*[c.alias(k) for k, c in out.items()]))


def _plan(entry: Column, stop: Column, target: Column, least: float, valid: Column) -> Column:
    risk, reward = F.abs(entry - stop), F.abs(target - entry)
    ratio = F.when(valid, reward / risk)
    out = {"stop": F.round(stop, 4), "target": F.round(target, 4), "risk": F.round(risk, 4), "reward": F.round(reward, 4), "ratio": F.round(ratio, 2), "meets": ratio >= least}
    return F.when(valid, F.struct(*[c.alias(k) for k, c in out.items()]))


def reversion_geometry(entry: Column, vwap: Column, deviation: Column, side: Column, least: float = 1.5) -> Column:
    """Back to the VWAP with the stop one deviation beyond the entry: side 'long' from below it, 'short' from above; else null."""
    long = F.lower(side) == "long"
    valid = (entry > 0) & (vwap > 0) & (deviation > 0) & ((long & (entry < vwap)) | ((F.lower(side) == "short") & (entry > vwap)))
    return _plan(entry, F.when(long, entry - deviation).otherwise(entry + deviation), vwap, least, valid)


def block_geometry(entry: Column, stop: Column, target: Column, least: float = 3.0) -> Column:
    """A long entry at a demand block, stop just beyond it, target at the next opposing level; null unless 0 < stop < entry < target."""
    return _plan(entry, stop, target, least, (stop > 0) & (stop < entry) & (entry < target))
