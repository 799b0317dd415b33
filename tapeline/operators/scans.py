"""Windows and pages of scans, entries with their tape, marks and long ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.operators import joins
from tapeline.operators.bars import rollup
from tapeline.operators.indicators import by, over


def window(rows: DataFrame, start: str, end: str, t: str = "t") -> DataFrame:
    """Rows of the half-open time [start, end). On a table the filter reaches the scan; for bars rolled up from trades use bars_window."""
    at = lambda x: F.lit(x).cast(rows.schema[t].dataType)
    return rows.where((F.col(t) >= at(start)) & (F.col(t) < at(end)))


def bars_window(trades: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Bars of `minutes` with start <= t < end, from the trades of that time alone: the range, widened to whole bars, reaches the scan of the trades."""
    at = lambda x: F.lit(x).cast(trades.schema["t"].dataType)
    step = minutes * 60
    floor = lambda x: F.timestamp_seconds(F.floor(F.unix_timestamp(F.lit(x).cast("timestamp")) / step) * step).cast(trades.schema["t"].dataType)
    some = trades.where((F.col("t") >= floor(start)) & (F.col("t") < floor(end) + F.expr(f"interval {minutes} minutes")))
    return window(rollup(some, minutes), start, end)


def lookback(rows: DataFrame, now: str, hours: int = 8, limit: int = 10_000) -> DataFrame:
    """Per symbol the first `limit` rows (symbol, t) of the last `hours` before `now`, trades with an id or bars without; rows of one time follow each other by id, else by their other columns."""
    at = F.lit(now).cast(rows.schema["t"].dataType)
    recent = rows.where((F.col("t") >= at - F.expr(f"interval {hours} hours")) & (F.col("t") < at))
    ties = ["id"] if "id" in rows.columns else [c for c in rows.columns if c not in ("symbol", "t")]
    n = F.row_number().over(W.partitionBy("symbol").orderBy("t", *ties))
    return recent.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def news_page(news: DataFrame, until: str, n: int = 10) -> DataFrame:
    """Per symbol the newest `n` (1 to 30) items (id, symbol, created_at) before `until`, ranked newest first, ties by the larger id."""
    at = F.lit(until).cast(news.schema["created_at"].dataType)
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("created_at"), F.desc("id")))
    return news.where(F.col("created_at") < at).withColumn("rank", rank).where(F.col("rank") <= max(1, min(n, 30)))


def unseen(fresh: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key was not seen, one a key."""
    return fresh.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def entry_context(entries: DataFrame, bars: DataFrame, minutes: int, before: int = 10, horizon: int = 3600) -> DataFrame:
    """entries (id, symbol, ts, price) with the last `before` bars complete by then and the bars in (ts, ts + horizon seconds].

    Number and mean close of the bars before; number, best and worst excursion in percent of the
    price, and last close of those after. The bars before are an as-of join to the latest and an
    equi-join on its number; those after an equi-join on time buckets.
    """
    numbered = bars.withColumn("i", F.row_number().over(by()))
    e = entries.withColumn("_done", F.col("ts") - F.expr(f"interval {minutes} minutes"))
    last = joins.asof_backward(e, numbered, "symbol", "_done", "t", ["i"])
    spans = last.where("i is not null").select("id", "symbol", F.explode(F.sequence(F.greatest(F.col("i") - before + 1, F.lit(1)), F.col("i"))).alias("i"))
    a = spans.join(numbered.select("symbol", "i", "c"), ["symbol", "i"]).groupBy("id").agg(F.count("*").alias("n_before"), F.avg("c").alias("mean_before"))
    z = joins.within(entries, bars, "symbol", "ts", "t", horizon).where("t > ts")
    z = z.groupBy("id").agg(F.count("*").alias("n_after"), F.max("h").alias("_h"), F.min("l").alias("_l"), F.max_by("c", "t").alias("close_after"))
    pct = lambda x: (F.col(x) / F.nullif("price", F.lit(0.0)) - 1) * 100
    d = entries.join(a, "id", "left").join(z, "id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("id", "symbol", none("n_before"), "mean_before", none("n_after"), pct("_h").alias("best_pct"), pct("_l").alias("worst_pct"), "close_after")


def marked(positions: DataFrame, trades: DataFrame, bars: DataFrame, closes: DataFrame) -> DataFrame:
    """positions (symbol, quantity) at the last trade's price, else the last bar's close, else the previous close, else unmarked."""
    p = trades.groupBy("symbol").agg(F.max(F.struct("t", "id", "p")).alias("_x")).select("symbol", F.col("_x.p").alias("_p"))
    b = bars.groupBy("symbol").agg(F.max_by("c", "t").alias("_b"))
    c = closes.groupBy("symbol").agg(F.max_by("c", "t").alias("_c"))
    d = positions.join(p, "symbol", "left").join(b, "symbol", "left").join(c, "symbol", "left").withColumn("mark", F.coalesce("_p", "_b", "_c"))
    return d.select("symbol", "quantity", "mark", (F.col("quantity") * F.col("mark")).alias("value"))


def long_ranges(closes: DataFrame, n: int = 252, least: int = 60) -> DataFrame:
    """Highest and lowest close of the last `n` rows of a symbol, from `least` rows on."""
    enough = F.count("c").over(over(n)) >= least
    return closes.withColumns({"high": F.when(enough, F.max("c").over(over(n))), "low": F.when(enough, F.min("c").over(over(n)))})


def top_firms(targets: DataFrame, n: int = 8) -> DataFrame:
    """The `n` firms with the latest target, newest first, ties by name."""
    return targets.groupBy("firm").agg(F.max("date").alias("date"), F.count("*").alias("n")).orderBy(F.desc("date"), "firm").limit(n)


def dividend_return(yield_pct: Column, growth_pct: Column, years: int = 10) -> Column:
    """The sum of a dividend yield over years at yearly growth, both in percent."""
    grown = F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda k: yield_pct * F.pow(1 + growth_pct / 100, k))
    return F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
