"""Market structure: order blocks, breaks, momentum patterns and consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.operators.indicators import by


def recent(bars: DataFrame) -> DataFrame:
    """Adds `back`: 1 for a symbol's last bar, 2 for the one before, and so on."""
    return bars.withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("t"))))


def order_blocks(bars: DataFrame, swing: int = 5, ahead: int = 3, keep: int = 6) -> DataFrame:
    """Last opposing candles before an impulse past the extreme of the preceding `swing` bars within `ahead` bars.

    Bullish: a falling candle with a high above the swing high ahead; bearish mirrored. Candles
    without `ahead` bars behind them don't count. Keeps the last `keep` per symbol, with edges to
    four places and `mitigated`: a later bar (beyond the look-ahead) overlaps the zone.
    """
    before, after = by().rowsBetween(-swing, -1), by().rowsBetween(1, ahead)
    d = bars.withColumns({"i": F.row_number().over(by()), "_sh": F.max("h").over(before), "_sl": F.min("l").over(before), "_ih": F.max("h").over(after), "_il": F.min("l").over(after), "_n": F.count("*").over(after)})
    kind = F.when((F.col("c") < F.col("o")) & (F.col("_ih") > F.col("_sh")), "bullish").when((F.col("c") > F.col("o")) & (F.col("_il") < F.col("_sl")), "bearish")
    d = d.where((F.col("i") > swing) & (F.col("_n") == ahead)).withColumn("kind", kind).where("kind is not null")
    d = d.select("symbol", "t", "i", "kind", F.round("l", 4).alias("bottom"), F.round("h", 4).alias("top"))
    return overlapped(last(d, keep), bars, ahead + 1, "mitigated")


def last(zones: DataFrame, keep: int) -> DataFrame:
    """The last `keep` rows of each symbol."""
    return zones.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("t")))).where(F.col("_n") <= keep).drop("_n")


def overlapped(zones: DataFrame, bars: DataFrame, after: int, name: str) -> DataFrame:
    """Adds a flag: some bar from the `after`-th behind the zone's bar `i` on overlaps [bottom, top].

    Zones are few per symbol, so each bar meets a bounded number of them.
    """
    later = bars.withColumn("_j", F.row_number().over(by())).select("symbol", "_j", F.col("h").alias("_h"), F.col("l").alias("_l"))
    hit = zones.join(later, "symbol").where((F.col("_j") >= F.col("i") + after) & (F.col("_l") <= F.col("top")) & (F.col("_h") >= F.col("bottom")))
    hit = hit.select("symbol", "i").distinct().withColumn("_hit", F.lit(True))
    return zones.join(hit, ["symbol", "i"], "left").select("symbol", "t", "kind", "bottom", "top", F.coalesce("_hit", F.lit(False)).alias(name))


def break_of_structure(bars: DataFrame) -> DataFrame:
    """Whether the last five bars' high exceeds the five before and the last close is above those."""
    d = recent(bars).where("back <= 10")
    g = d.groupBy("symbol").agg(F.max(F.when(F.col("back") <= 5, F.col("h"))).alias("recent_high"), F.max(F.when(F.col("back") > 5, F.col("h"))).alias("prior_high"), F.max(F.when(F.col("back") == 1, F.col("c"))).alias("c"))
    return g.withColumn("broken", (F.col("recent_high") > F.col("prior_high")) & (F.col("c") > F.col("prior_high")))


def momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    """Two adjacent blocks of min(n, half the symbol's bars): higher highs and lows, lower ones, or mixed; with volume of the last n over the n before.

    Fewer than four bars give no pattern.
    """
    d = recent(bars.withColumn("_all", F.count("*").over(W.partitionBy("symbol")))).where(F.col("back") <= 2 * n)
    size = F.least(F.lit(n), F.floor(F.col("_all") / 2))
    new, old = F.col("back") <= size, (F.col("back") > size) & (F.col("back") <= 2 * size)
    g = d.groupBy("symbol").agg(
        F.max("_all").alias("_all"),
        F.max(F.when(new, F.col("h"))).alias("nh"), F.min(F.when(new, F.col("l"))).alias("nl"), F.max(F.when(old, F.col("h"))).alias("oh"), F.min(F.when(old, F.col("l"))).alias("ol"),
        (F.avg(F.when(F.col("back") <= n, F.col("v"))) / F.nullif(F.avg(F.when(F.col("back") > n, F.col("v"))), F.lit(0.0))).alias("relative_volume"),
    )
    up, down = (F.col("nh") > F.col("oh")) & (F.col("nl") > F.col("ol")), (F.col("nh") < F.col("oh")) & (F.col("nl") < F.col("ol"))
    pattern = F.when(F.col("_all") < 4, "not enough bars").when(up, "higher highs and lows").when(down, "lower highs and lows").otherwise("mixed")
    return g.select("symbol", pattern.alias("pattern"), "relative_volume")


def consolidation(bars: DataFrame, base_bars: int = 10, prior_bars: int = 20) -> DataFrame:
    """The base of a symbol's last `base_bars` bars against the `prior_bars` before, of which five at least must exist.

    Contraction of the range in percent, the trend of the mean volume (a tenth either way is flat),
    bars that touch either edge (within 15 % of the height, or 0.1 % of the price), and whether the
    base coils: contracted by more than 10 % on volume that doesn't rise.
    """
    w = W.partitionBy("symbol")
    new = F.col("back") <= base_bars
    d = recent(bars).where(F.col("back") <= base_bars + prior_bars)
    d = d.withColumns({"_top": F.max(F.when(new, F.col("h"))).over(w), "_low": F.min(F.when(new, F.col("l"))).over(w), "_c": F.max(F.when(F.col("back") == 1, F.col("c"))).over(w)})
    near = F.greatest((F.col("_top") - F.col("_low")) * 0.15, F.col("_c") * 0.001)
    g = d.groupBy("symbol").agg(
        F.count("*").alias("_n"), F.first("_c").alias("c"), F.first("_top").alias("base_high"), F.first("_low").alias("base_low"), (F.max(F.when(~new, F.col("h"))) - F.min(F.when(~new, F.col("l")))).alias("prior"),
        F.avg(F.when(new, F.col("v"))).alias("nv"), F.avg(F.when(~new, F.col("v"))).alias("ov"),
        F.count_if(new & (F.col("_top") - F.col("h") <= near)).alias("touches_high"), F.count_if(new & (F.col("l") - F.col("_low") <= near)).alias("touches_low"),
    ).where(F.col("_n") >= base_bars + 5).withColumn("base", F.col("base_high") - F.col("base_low"))
    contraction = F.when(F.col("prior") > 0, (F.col("prior") - F.col("base")) / F.col("prior") * 100).otherwise(0.0)
    volume = F.when(F.coalesce("ov", F.lit(0.0)) == 0, "unknown").when(F.col("nv") < F.col("ov") * 0.9, "declining").when(F.col("nv") > F.col("ov") * 1.1, "rising").otherwise("flat")
    g = g.withColumns({"contraction_pct": contraction, "volume": volume, "height_pct": F.when(F.col("c") != 0, F.col("base") / F.col("c") * 100).otherwise(0.0)})
    return g.select(
        "symbol", "base_high", "base_low", "base", "height_pct", "prior", "contraction_pct", "volume", "touches_high", "touches_low",
        ((F.col("touches_high") >= 2) | (F.col("touches_low") >= 2)).alias("well_tested"), ((F.col("contraction_pct") > 10) & F.col("volume").isin("declining", "flat")).alias("coiling"),
    )


def price_time_histogram(bars: DataFrame, prices: int = 50, times: int = 20) -> DataFrame:
    """Volume on a grid of price bins and row-count time buckets per symbol; a price on an inner edge belongs to the lower bin. Only filled cells."""
    w = W.partitionBy("symbol")
    d = bars.withColumns({"_n": F.row_number().over(by()), "_all": F.count("*").over(w), "_lo": F.min("c").over(w), "_hi": F.max("c").over(w)})
    price = F.least(F.greatest(F.ceil((F.col("c") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / prices)) - 1, F.lit(0)), F.lit(prices - 1)).cast("int")
    time = F.floor((F.col("_n") - 1) * times / F.col("_all")).cast("int")
    return d.where("_hi > _lo").groupBy("symbol", price.alias("price_bin"), time.alias("time_bucket")).agg(F.sum("v").alias("v"))


def weighted_lines(days: DataFrame, spans: tuple[int, ...] = (7, 28, 365)) -> DataFrame:
    """Volume-weighted close over the last N days of each symbol, one column a span."""
    last = F.max("t").over(W.partitionBy("symbol"))
    d = days.withColumn("_age", F.datediff(last, "t"))
    cut = lambda n, x: F.sum(F.when(F.col("_age") <= n, x))
    return d.groupBy("symbol").agg(*[(cut(n, F.col("c") * F.col("v")) / F.nullif(cut(n, F.col("v")), F.lit(0))).alias(f"line_{n}") for n in spans])
