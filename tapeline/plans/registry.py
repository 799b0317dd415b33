"""Named tools: each takes rows (bars, or what it names) and clamped arguments and returns a DataFrame; unknown names and bad arguments raise ValueError."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions import clock
from tapeline.operators import indicators, kernels, levels, options, reads, records, scans, scoring, session_levels, structure


def _swing_levels(bars: DataFrame, k: int) -> DataFrame:
    return reads.swing_clusters(bars, swing=k)


def _setup(bars: DataFrame) -> DataFrame:
    """From intraday bars alone: their daily bars are rolled up first."""
    order = F.min("t")
    days = bars.groupBy("symbol", clock.ny_date(F.col("t")).alias("d")).agg(F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"), order.alias("_t"))
    return reads.smart_money_setup(days.select("symbol", F.col("d").cast(bars.schema["t"].dataType).alias("t"), "o", "h", "l", "c", "v"), bars)


def _market(closes: DataFrame) -> DataFrame:
    """Closes (symbol, t, c) of VIX, VIX3M and SPY."""
    return reads.market_regime(closes, "VIX", "VIX3M", "SPY")


def _clock(rows: DataFrame) -> DataFrame:
    t = F.col("t")
    return rows.withColumns({"window": clock.session_window(t), "open": clock.is_open(t), "next_open": clock.next_open(t), "seconds_to_open": clock.seconds_to_open(t)})


def _news(news: DataFrame, n: int) -> DataFrame:
    return scans.news_page(news, "9999-12-31 00:00:00", n)


def _targets(targets: DataFrame, n: int) -> DataFrame:
    """Targets (firm, date, target, id): each firm's latest, newest first, of the `n` firms heard from last."""
    last = targets.where("target is not null").groupBy("firm").agg(F.max(F.struct("date", "id", "target")).alias("x"))
    return last.select("firm", "x.date", "x.target").orderBy(F.desc("date"), "firm").limit(n)


def _quotes(quotes: DataFrame, stale: int) -> DataFrame:
    """Each symbol's last quote (symbol, t, bp, ap), judged at the time of the newest of all."""
    last = quotes.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("t"), "bp", "ap"))).where("_k = 1").drop("_k")
    now = quotes.agg(F.max("t").alias("_now"))  # one row
    return records.quote_quality(last.withColumn("_", F.lit(1)).join(now.withColumn("_", F.lit(1)), "_").drop("_"), F.col("_now"), stale_s=stale).drop("_now")


def _geometry(kind: Callable, *columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda plans: plans.withColumn("geometry", kind(*[F.col(c) for c in columns]))


#: Tool to operator, and its arguments with default, least and most.
TOOLS: dict[str, tuple[Callable[..., DataFrame], dict[str, tuple[float, float, float]]]] = {
    "analyze_daily_trend": (indicators.trend, {}),
    "analyze_intraday_momentum": (structure.momentum, {"n": (10, 2, 150)}),
    "analyze_opening_range": (levels.opening_breakout, {"minutes": (15, 1, 120)}),
    "analyze_market": (_market, {}),
    "analyze_consolidation": (structure.consolidation, {}),
    "get_key_levels": (levels.key_levels, {}),
    "analyze_swing_levels": (_swing_levels, {"k": (3, 2, 10)}),
    "swing_points": (levels.swings, {"k": (3, 2, 10)}),
    "analyze_volume_profile": (levels.volume_profile, {"bins": (24, 8, 60)}),
    "get_floor_pivots": (levels.floor_pivots, {}),
    "analyze_vwap_bands": (indicators.vwap_bands, {}),
    "analyze_order_blocks": (structure.order_blocks, {}),
    "analyze_fair_value_gaps": (levels.filled_gaps, {}),
    "analyze_premium_discount": (levels.premium_discount, {}),
    "analyze_smart_money_setup": (_setup, {}),
    "analyze_volume": (indicators.obv, {"n": (20, 2, 200)}),
    "current_leg": (kernels.momentum_legs, {}),
    "get_put_call_walls": (options.walls, {}),
    "analyze_liquidity": (reads.liquidity_sweeps, {"swing": (3, 2, 10), "recent_bars": (5, 1, 20)}),
    "analyze_volume_profile_2": (session_levels.session_levels, {"warmup": (15, 0, 120), "width": (5, 1, 30), "bins": (24, 8, 60)}),
    "cluster_swing_levels": (reads.swing_clusters, {"swing": (3, 2, 10), "keep": (6, 1, 20)}),
    "momentum_pct": (reads.momentum_pct, {"minutes": (10, 1, 120)}),
    "breakout_trade_geometry": (_geometry(scoring.breakout_geometry, "entry", "stop", "base_height", "atr", "resistance"), {}),
    "vwap_reversion_geometry": (_geometry(scoring.reversion_geometry, "entry", "vwap", "deviation", "side"), {}),
    "smart_money_trade_geometry": (_geometry(scoring.block_geometry, "entry", "stop", "target"), {}),
    "get_session_clock": (_clock, {}),
    "get_news": (_news, {"n": (10, 1, 30)}),
    "get_analyst_targets": (_targets, {"n": (8, 1, 50)}),
    "get_corporate_actions": (records.corporate_actions, {}),
    "get_quote": (_quotes, {"stale": (120, 1, 3600)}),
}
#: Columns that a row's time may be in.
_TIMES = ("t", "created_at", "date", "ts")


def run(tool: str, rows: DataFrame, as_of: Any = None, **arguments: float) -> DataFrame:
    """Run a tool over rows, of those before `as_of` (by t, created_at, date or ts) where it is given; arguments are clamped to their range."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool: {tool}")
    operator, known = TOOLS[tool]
    if unknown := arguments.keys() - known.keys():
        raise ValueError(f"{tool} has no argument {sorted(unknown)[0]}")
    if as_of is not None:
        rows = rows.where(rows[next(c for c in _TIMES if c in rows.columns)] < as_of)
    return operator(rows, **{k: int(max(lo, min(arguments.get(k, d), hi))) for k, (d, lo, hi) in known.items()})
