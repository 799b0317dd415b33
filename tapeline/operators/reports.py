"""Scoring sessions and the report of a day, as nested aggregates, with the gate that writes a day once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of sessions below which a day is not scored yet, and ungrounded numbers that a report shows.
LEAST_RUNTIME, SHOWN = 3600, 20

_COUNTS = ("total", "buy_sell_filled", "buy_sell_rejected", "tactics_armed", "alerts", "forced_sleeps", "active")
SESSION = (
    "started_at timestamp, mode string, runtime_sec double, "
    "grounding struct<scored_cycles: long, mean_score: double, min_score: double, ungrounded: array<string>>, "
    "tactics struct<attempts: long, rejections: long>, tools struct<calls: long, errors: long, quote_calls: long, quote_warnings: long>, "
    f"decisions struct<{', '.join(f'{c}: long' for c in _COUNTS)}, return_pct: double>, "
    "activations array<struct<strategy: string, regime: string, effective: boolean, active_decisions: long, return_pct: double>>"
)


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _day(c: str = "started_at") -> Column:
    return F.to_date(c)


def strategy_stats(sessions: DataFrame) -> DataFrame:
    """(day, strategy, activations, effective, alert_only, effectiveness, mean_return_pct, regimes) over all activations of a day's sessions; regimes in order of their first use."""
    each = sessions.select(_day().alias("day"), "started_at", F.posexplode("activations").alias("_k", "a")).select("day", "started_at", "_k", "a.*")
    g = each.groupBy("day", "strategy").agg(
        F.count("*").alias("activations"), F.count_if("effective").alias("effective"), F.count_if(F.coalesce("active_decisions", F.lit(0)) == 0).alias("alert_only"), F.avg("return_pct").alias("mean_return_pct")
    )
    seen = each.where("regime is not null and regime <> ''").groupBy("day", "strategy", "regime").agg(F.min(F.struct("started_at", "_k")).alias("_first"))
    seen = seen.groupBy("day", "strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "regime"))), lambda x: x["regime"]).alias("regimes"))
    d = g.join(seen.select("day", "strategy", "regimes"), ["day", "strategy"], "left")
    return d.select(
        "day", "strategy", "activations", "effective", "alert_only", (F.col("effective") / F.col("activations")).alias("effectiveness"), "mean_return_pct", F.coalesce("regimes", F.array().cast("array<string>")).alias("regimes")
    )


def day_reports(sessions: DataFrame) -> DataFrame:
    """One nested row per UTC day of sessions (SESSION): runtime, grounding, rates of rejections, errors and warnings, decisions, and a map of strategy to its statistics.

    The grounding score is the mean of the sessions' scores by their scored cycles, null where none
    was scored; rates without a base are null; a session without a return counts in no mean.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.split(".")[-1])
    day = sessions.withColumn("day", _day())
    scored = F.col("grounding.scored_cycles")
    g = day.groupBy("day").agg(
        F.count("*").alias("sessions"), F.round(F.coalesce(F.sum("runtime_sec"), F.lit(0.0)), 1).alias("total_runtime_sec"),
        F.struct(F.coalesce(F.sum(scored), F.lit(0)).alias("scored_cycles"), (F.sum(F.col("grounding.mean_score") * scored) / F.nullif(F.sum(scored), F.lit(0))).alias("mean_score"), F.min("grounding.min_score").alias("min_score")).alias("grounding"),
        F.struct(*[total(f"tactics.{c}") for c in ("attempts", "rejections")]).alias("tactics"), F.struct(*[total(f"tools.{c}") for c in ("calls", "errors", "quote_calls", "quote_warnings")]).alias("tools"),
        F.struct(*[total(f"decisions.{c}") for c in _COUNTS]).alias("decisions"), F.avg("decisions.return_pct").alias("mean_session_return_pct"),
        F.array_sort(F.collect_list(F.struct("started_at", "mode", "runtime_sec", F.col("decisions.return_pct").alias("return_pct")))).alias("session_index"),
    )
    numbers = day.select("day", F.explode("grounding.ungrounded").alias("n")).where("n is not null").distinct()
    shown = numbers.withColumn("_k", F.row_number().over(W.partitionBy("day").orderBy("n"))).where(F.col("_k") <= SHOWN).groupBy("day").agg(F.array_sort(F.collect_list("n")).alias("ungrounded"))
    stats = strategy_stats(sessions)
    each = F.struct(*[c for c in stats.columns if c not in ("day", "strategy")])
    strategies = stats.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", each)))).alias("strategies"))
    d = g.join(shown, "day", "left").join(strategies, "day", "left")
    had = F.col("grounding.scored_cycles") > 0
    return d.select(
        "day", "sessions", "total_runtime_sec", F.when(had, F.struct("grounding.*", F.coalesce("ungrounded", F.array().cast("array<string>")).alias("ungrounded"))).alias("grounding"),
        F.struct("tactics.*", _rate(F.col("tactics.rejections"), F.col("tactics.attempts")).alias("rejection_rate")).alias("tactics_validation"),
        F.struct("tools.*", _rate(F.col("tools.errors"), F.col("tools.calls")).alias("error_rate"), _rate(F.col("tools.quote_warnings"), F.col("tools.quote_calls")).alias("quote_warning_rate")).alias("tools"),
        F.struct("decisions.*", _rate(F.col("decisions.active"), F.col("decisions.total")).alias("active_rate"), "mean_session_return_pct").alias("decision_quality"),
        F.coalesce("strategies", F.create_map().cast(strategies.schema["strategies"].dataType)).alias("strategies"), "session_index",
    )


def due_reports(sessions: DataFrame, earlier: DataFrame, least_runtime: float = LEAST_RUNTIME) -> DataFrame:
    """Reports of the days that have none in `earlier` (day) and whose sessions ran for `least_runtime` seconds in all. Appending them to `earlier` makes a second run add nothing."""
    days = sessions.groupBy(_day().alias("day")).agg(F.sum("runtime_sec").alias("_run")).where(F.col("_run") >= least_runtime)
    due = days.join(earlier.select("day"), "day", "left_anti").select("day")
    return day_reports(sessions.join(due.withColumnRenamed("day", "_day"), _day() == F.col("_day"), "left_semi"))
