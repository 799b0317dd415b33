"""Price levels and structure: pivots, ranges, profiles, swings, gaps and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.clock import eastern, minute_of_day
from tapeline.operators.indicators import by
from tapeline.operators.structure import last, overlapped

#: Retracement ratios; fixed values.
FIBONACCI = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]


def floor_pivots(days: DataFrame) -> DataFrame:
    """Pivot, resistances and supports of each day from the day before, one row per level."""
    prior = {x: F.lag(x).over(by()) for x in ("h", "l", "c")}
    d = days.select("symbol", "t", *[v.alias(k) for k, v in prior.items()]).where("c is not null").withColumn("p", (F.col("h") + F.col("l") + F.col("c")) / 3)
    levels = "stack(7, 'P', p, 'R1', 2*p - l, 'S1', 2*p - h, 'R2', p + (h - l), 'S2', p - (h - l), 'R3', h + 2*(p - l), 'S3', l - 2*(h - p)) as (level, price)"
    return d.selectExpr("symbol", "t", levels)


def fibonacci(bars: DataFrame) -> DataFrame:
    """high - ratio * range for the fixed ratios; none where the range is empty."""
    r = bars.groupBy("symbol").agg(F.max("h").alias("h"), F.min("l").alias("l")).where("h > l")
    return r.withColumn("ratio", F.explode(F.array(*map(F.lit, FIBONACCI)))).select("symbol", "ratio", (F.col("h") - F.col("ratio") * (F.col("h") - F.col("l"))).alias("price"))


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    w = by().rowsBetween(-(n - 1), 0)
    return bars.withColumns({"support": F.min("l").over(w), "resistance": F.max("h").over(w)})


def drawdown(bars: DataFrame) -> DataFrame:
    """Percent of the last close below the highest high; zero where that is not positive."""
    g = bars.groupBy("symbol").agg(F.max_by("c", "t").alias("c"), F.max("h").alias("peak"))
    return g.select("symbol", "peak", F.when(F.col("peak") > 0, (F.col("c") / F.col("peak") - 1) * 100).otherwise(0.0).alias("drawdown_pct"))


def opening_range(bars: DataFrame, minutes: int = 60) -> DataFrame:
    """Per symbol and New York date: high, low, mean volume and bars of [09:30, 09:30 + minutes)."""
    m = minute_of_day(F.col("t"))
    inside = bars.where((m >= 570) & (m < 570 + minutes)).withColumn("day", F.date_format(eastern(F.col("t")), "yyyy-MM-dd"))
    return inside.groupBy("symbol", "day").agg(F.max("h").alias("high"), F.min("l").alias("low"), F.avg("v").alias("avg_volume"), F.count("*").alias("n"))


def opening_breakout(bars: DataFrame, minutes: int = 15, grace: int = 3) -> DataFrame:
    """Opening range and what became of it, per symbol and New York date: (symbol, day, note, high, low, avg_volume, n, complete, price, status, volume_ratio).

    The range is that of [09:30, 09:30 + minutes). Where the date's bars from 09:30 on begin more
    than `grace` minutes late, they don't reach back to the open and there is no range but a note;
    so too where no bar lies in the window. It is complete once a bar at or after its end is
    there. price is the last close from 09:30 on; volume_ratio is the mean volume of the last three
    bars after the window to that of the window.
    """
    m = minute_of_day(F.col("t"))
    d = bars.where(m >= 570).withColumns({"day": F.date_format(eastern(F.col("t")), "yyyy-MM-dd"), "_m": m, "_in": m < 570 + minutes})
    w = W.partitionBy("symbol", "day", "_in").orderBy(F.desc("t"))
    d = d.withColumn("_k", F.row_number().over(w))
    only = lambda c: F.when(F.col("_in"), F.col(c))
    g = d.groupBy("symbol", "day").agg(
        F.min("_m").alias("_first"), F.max(only("h")).alias("high"), F.min(only("l")).alias("low"), F.avg(only("v")).alias("avg_volume"), F.count_if("_in").alias("n"),
        F.count_if(~F.col("_in")).alias("_after"), F.max_by("c", "t").alias("price"), F.avg(F.when(~F.col("_in") & (F.col("_k") <= 3), F.col("v"))).alias("_late"),
    )
    g = g.withColumn("note", F.when(F.col("_first") > 570 + grace, "bars do not reach back to the open").when(F.col("n") == 0, "no bars in the window")).withColumn("complete", F.col("_after") > 0)
    status = F.when(~F.col("complete"), "still forming").when(F.col("price") > F.col("high"), "broken out above").when(F.col("price") < F.col("low"), "broken out below").otherwise("inside_range")
    had = lambda c, name: F.when(F.col("note").isNull(), c).alias(name)
    return g.select(
        "symbol", "day", "note", *[had(F.col(c), c) for c in ("high", "low", "avg_volume", "n", "complete")], had(F.col("price"), "price"), had(status, "status"),
        had(F.col("_late") / F.nullif("avg_volume", F.lit(0.0)), "volume_ratio"),
    )


def key_levels(bars: DataFrame) -> DataFrame:
    """Per symbol and New York date: premarket high and low (before 09:30), session high and low, and the previous day's high, low and close."""
    m = minute_of_day(F.col("t"))
    d = bars.withColumns({"day": F.date_format(eastern(F.col("t")), "yyyy-MM-dd"), "pre": m < 570})
    g = d.groupBy("symbol", "day").agg(
        F.max(F.when(F.col("pre"), F.col("h"))).alias("premarket_high"), F.min(F.when(F.col("pre"), F.col("l"))).alias("premarket_low"),
        F.max(F.when(~F.col("pre"), F.col("h"))).alias("session_high"), F.min(F.when(~F.col("pre"), F.col("l"))).alias("session_low"),
        F.max("h").alias("_h"), F.min("l").alias("_l"), F.max_by("c", "t").alias("_c"),
    )
    w = W.partitionBy("symbol").orderBy("day")
    return g.withColumns({f"prior_{n}": F.lag(k).over(w) for n, k in (("high", "_h"), ("low", "_l"), ("close", "_c"))}).drop("_h", "_l", "_c")


def volume_profile(bars: DataFrame, bins: int = 24) -> DataFrame:
    """Volume by price in equal bins between the lowest low and highest high (typical price), empty bins included, with the share of volume and the point of control."""
    tp = (F.col("h") + F.col("l") + F.col("c")) / 3
    span = bars.groupBy("symbol").agg(F.min("l").alias("lo"), F.max("h").alias("hi")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.greatest(F.floor((tp - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    filled = bars.join(span, "symbol").groupBy("symbol", at.alias("bin")).agg(F.sum("v").alias("v"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    d = grid.join(filled, ["symbol", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    w = W.partitionBy("symbol")
    first = F.min(F.when(F.col("v") == F.col("_max"), F.col("bin"))).over(w)
    d = d.withColumns({"_max": F.max("v").over(w), "_sum": F.sum("v").over(w)})
    return d.select("symbol", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), "v", (100 * F.col("v") / F.col("_sum")).alias("share_pct"), (F.col("bin") == first).alias("is_poc"))


def profile_nodes(profile: DataFrame) -> DataFrame:
    """Runs of adjacent bins with at least 1.5 times (HVN) or at most half (LVN, above zero) the mean volume."""
    w = W.partitionBy("symbol")
    d = profile.withColumn("mean", F.avg("v").over(w))
    kind = F.when(F.col("v") >= 1.5 * F.col("mean"), "HVN").when((F.col("v") > 0) & (F.col("v") <= 0.5 * F.col("mean")), "LVN")
    d = d.withColumn("kind", kind).where("kind is not null")
    d = d.withColumn("run", F.col("bin") - F.row_number().over(W.partitionBy("symbol", "kind").orderBy("bin")))
    return d.groupBy("symbol", "kind", "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("v").alias("v")).drop("run")


def swings(bars: DataFrame, k: int = 2) -> DataFrame:
    """Fractal swing highs and lows: equal to the extreme of k rows on either side, all rows present."""
    w = by().rowsBetween(-k, k)
    n = F.count("*").over(w) == 2 * k + 1
    d = bars.withColumns({"swing_high": n & (F.col("h") == F.max("h").over(w)), "swing_low": n & (F.col("l") == F.min("l").over(w))})
    return d.where("swing_high or swing_low")


def fair_value_gaps(bars: DataFrame, keep: int = 6) -> DataFrame:
    """The last `keep` three-bar gaps per symbol (bullish: next low above previous high; bearish mirrored), edges to four places, at the middle bar `i`."""
    d = bars.withColumns({"i": F.row_number().over(by()), "_ph": F.lag("h").over(by()), "_pl": F.lag("l").over(by()), "_nh": F.lead("h").over(by()), "_nl": F.lead("l").over(by())})
    up, down = F.col("_nl") > F.col("_ph"), F.col("_nh") < F.col("_pl")
    gaps = d.where(up | down).select(
        "symbol", "t", "i", F.when(up, "bullish").otherwise("bearish").alias("kind"), F.round(F.when(up, F.col("_ph")).otherwise(F.col("_nh")), 4).alias("bottom"), F.round(F.when(up, F.col("_nl")).otherwise(F.col("_pl")), 4).alias("top")
    )
    return last(gaps, keep)


def filled_gaps(bars: DataFrame, keep: int = 6) -> DataFrame:
    """The kept gaps with `filled`: some bar from the second after on overlaps [bottom, top]."""
    return overlapped(fair_value_gaps(bars, keep), bars, 2, "filled")


def premium_discount(bars: DataFrame) -> DataFrame:
    """Equilibrium of the range, the last close's place in it (discount below 0.45, premium above 0.55), and whether it
    lies in the retracement of 0.618 to 0.79 down from the high. A flat range has no place."""
    g = bars.groupBy("symbol").agg(F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c")).withColumn("_r", F.col("h") - F.col("l"))
    place = F.when(F.col("_r") > 0, (F.col("c") - F.col("l")) / F.col("_r"))
    zone = F.when(place < 0.45, "discount").when(place > 0.55, "premium").when(place.isNotNull(), "equilibrium")
    top, bottom = F.round(F.col("h") - 0.618 * F.col("_r"), 4), F.round(F.col("h") - 0.79 * F.col("_r"), 4)
    return g.select("symbol", ((F.col("h") + F.col("l")) / 2).alias("equilibrium"), "c", zone.alias("zone"), F.when(F.col("_r") > 0, F.col("c").between(bottom, top)).alias("in_retracement"))


def volume_spikes(bars: DataFrame, times: float = 3.0) -> DataFrame:
    """Bars with at least `times` the symbol's median positive volume, classed by the move over five rows either side (8 basis points)."""
    base = bars.where("v > 0").groupBy("symbol").agg(F.median("v").alias("base"))
    d = bars.withColumns({"_a": F.coalesce(F.lag("c", 5).over(by()), F.first("c").over(by().rowsBetween(W.unboundedPreceding, 0))), "_z": F.coalesce(F.lead("c", 5).over(by()), F.last("c").over(by().rowsBetween(0, W.unboundedFollowing)))})
    move = (F.col("_z") / F.col("_a") - 1) * 10_000
    d = d.join(base, "symbol")
    return d.where(F.col("v") >= times * F.col("base")).select("symbol", "t", "v", "base", F.when(move > 8, "demand").when(move < -8, "supply").otherwise("unsure").alias("kind"))
