"""Levels of a session: volume spikes, levels built up without a spike, and the cut at the last news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.clock import minute_of_day
from tapeline.operators import joins
from tapeline.operators.reads import regular_session, session_spikes


def session_levels(
    bars: DataFrame, news: DataFrame | None = None, warmup: int = 15, times: float = 3.0, width: int = 5, flat: float = 8.0,
    news_minutes: int = 15, bins: int = 24, scattered: float = 1.5,
) -> DataFrame:
    """(symbol, day, t, price, rel_vol, v, type, news_driven, stale): support and resistance of every regular session.

    Spikes as in `session_spikes`; one with a piece of news (symbol, created_at) at most `news_minutes`
    before or after it is news-driven. What the spikes' bars leave of the volume is cut into `bins`
    prices between the session's low and high: a bin of at least `scattered` times the mean bin that
    no neighbour exceeds is a `scattered` level at its centre (of equal neighbours each is one), at
    the time of its largest bar, unless a spike's price lies within half a bin of the centre. Levels
    before the session's last news-driven spike are stale. A session is the most that one task takes.
    """
    keys = ["symbol", "day"]
    whole = W.partitionBy(*keys)
    d = regular_session(bars).withColumn("n", F.count("*").over(whole)).where(F.col("n") >= warmup + 2 * width)
    late = (minute_of_day(F.col("t")) >= 570 + warmup) & (F.col("v") > 0)
    d = d.withColumns({"base": F.median(F.when(late, F.col("v"))).over(whole), "lo": F.min("l").over(whole), "hi": F.max("h").over(whole)}).where("base > 0")
    spikes = session_spikes(bars, warmup, times, width, flat)
    near = F.lit(False)
    if news is not None:
        hit = joins.within(spikes.select(*keys, "t"), news.select("symbol", "created_at"), "symbol", "t", "created_at", 60 * news_minutes).select(*keys, "t").distinct().withColumn("_near", F.lit(True))
        spikes, near = spikes.join(hit, [*keys, "t"], "left"), F.coalesce("_near", F.lit(False))
    spikes = spikes.withColumn("news_driven", near).select(*keys, "t", "price", "rel_vol", "v", "type", "news_driven")

    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.greatest(F.floor(((F.col("h") + F.col("l") + F.col("c")) / 3 - F.col("lo")) / step), F.lit(0)), F.lit(bins - 1))
    rest = d.where("hi > lo").join(spikes.select(*keys, "t"), [*keys, "t"], "left_anti").withColumn("bin", at)
    largest = F.max_by("t", F.struct("v", -F.unix_micros(F.col("t").cast("timestamp"))))
    rest = rest.groupBy(*keys, "bin").agg(F.sum("v").alias("v"), largest.alias("t"), F.first("base").alias("base"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    w = whole.orderBy("bin")
    beside = lambda f, by: F.when(f("bin").over(w) == F.col("bin") + by, f("v").over(w)).otherwise(0)
    rest = rest.withColumns({"_mean": F.sum("v").over(whole) / bins, "_left": beside(F.lag, -1), "_right": beside(F.lead, 1)})
    peak = rest.where((F.col("_mean") > 0) & (F.col("v") >= scattered * F.col("_mean")) & (F.col("v") >= F.col("_left")) & (F.col("v") >= F.col("_right")))
    centre = F.col("lo") + (F.col("bin") + 0.5) * step
    peak = peak.withColumns({"_centre": centre, "_half": step / 2})
    owner = spikes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("price").alias("_price"))
    free = peak.join(owner, (F.col("symbol") == F.col("_symbol")) & (F.col("day") == F.col("_day")) & (F.abs(F.col("_centre") - F.col("_price")) <= F.col("_half")), "left_anti")
    free = free.select(*keys, "t", F.round("_centre", 4).alias("price"), F.round(F.col("v") / F.col("base"), 2).alias("rel_vol"), "v", F.lit("scattered").alias("type"), F.lit(False).alias("news_driven"))
    every = spikes.unionByName(free)
    cut = F.max(F.when(F.col("news_driven"), F.col("t"))).over(whole)
    return every.withColumn("stale", F.coalesce(F.col("t") < cut, F.lit(False)))


def potential(bars: DataFrame, seconds: int = joins.SLICE) -> DataFrame:
    """(symbol, min, max, max_after_min, min_before_max, max_profit_pct) of the lows and highs of bars (symbol, t, l, h) in order of arrival, a bar's low before its high.

    max_profit_pct is the better of two round trips: from the lowest price to the highest after it,
    and down to the highest price from the lowest before it. Prices that are null or not above 0
    don't count; of equal extremes the first does. Each time slice of a symbol is folded by itself
    into these four numbers, which two neighbouring slices join into one again.
    """
    prices = bars.select("symbol", "t", F.posexplode(F.array("l", "h")).alias("_k", "p")).where("p > 0")
    prices = prices.withColumns({"_s": F.floor(F.unix_micros(F.col("t").cast("timestamp")) / (seconds * 1_000_000)), "_o": F.struct("t", "_k")})
    w = W.partitionBy("symbol", "_s")
    d = prices.withColumns({"_lo": F.min("p").over(w), "_hi": F.max("p").over(w)})
    d = d.withColumns({"_at_lo": F.min(F.when(F.col("p") == F.col("_lo"), F.col("_o"))).over(w), "_at_hi": F.min(F.when(F.col("p") == F.col("_hi"), F.col("_o"))).over(w)})
    part = d.groupBy("symbol", "_s").agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"), F.max(F.when(F.col("_o") >= F.col("_at_lo"), F.col("p"))).alias("up"), F.min(F.when(F.col("_o") <= F.col("_at_hi"), F.col("p"))).alias("down")
    )

    def joined(a, b):
        """Extremes of two stretches, a before b."""
        lower, higher = b["lo"] < a["lo"], b["hi"] > a["hi"]
        return F.when(a["lo"].isNull(), b).otherwise(
            F.struct(
                F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
                F.when(lower, b["up"]).otherwise(F.greatest(a["up"], b["hi"])).alias("up"), F.when(higher, F.least(a["lo"], b["down"])).otherwise(a["down"]).alias("down"),
            )
        )

    four = ("lo", "hi", "up", "down")
    none = F.struct(*[F.lit(None).cast("double").alias(c) for c in four])
    slices = F.transform(F.array_sort(F.collect_list(F.struct("_s", *[F.col(c).cast("double").alias(c) for c in four]))), lambda x: F.struct(*[x[c].alias(c) for c in four]))
    g = part.groupBy("symbol").agg(slices.alias("_p")).select("symbol", F.aggregate("_p", none, joined).alias("x"))
    best = F.greatest((F.col("x.up") / F.col("x.lo") - 1) * 100, (F.col("x.hi") / F.col("x.down") - 1) * 100)
    return g.select("symbol", F.col("x.lo").alias("min"), F.col("x.hi").alias("max"), F.col("x.up").alias("max_after_min"), F.col("x.down").alias("min_before_max"), best.alias("max_profit_pct"))


def profit_efficiency(symbols: DataFrame, return_pct: float | None) -> DataFrame:
    """One row (best_symbol, max_possible_profit_pct, profit_efficiency) over rows of `potential`: the return as a part of the best symbol's, of equally good ones the first by name; null where nothing could be won."""
    first = symbols.agg(F.min(F.struct((-F.col("max_profit_pct")).alias("p"), "symbol")).alias("x")).where("x is not null")
    best = (-F.col("x.p")).alias("max_possible_profit_pct")
    return first.select(F.col("x.symbol").alias("best_symbol"), best, F.when(-F.col("x.p") > 0, F.lit(return_pct).cast("double") / -F.col("x.p")).alias("profit_efficiency"))
