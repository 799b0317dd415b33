"""Composite reads per symbol: sweeps, clustered swing levels, market regime, session state, spikes of a session and standing targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.clock import eastern, minute_of_day
from tapeline.operators import folds
from tapeline.operators.indicators import by, trend, true_range
from tapeline.operators.levels import filled_gaps, swings
from tapeline.operators.scoring import block_geometry
from tapeline.operators.structure import break_of_structure, order_blocks, recent

#: Upper bounds of the volatility index and their labels; fixed values.
FEAR = [(13, "very low (complacent)"), (17, "low (calm)"), (20, "normal"), (26, "elevated"), (35, "high (fear)")]
PANIC = "extreme (panic)"
#: Upper bounds of the volatility index and their votes; fixed values.
FEAR_VOTES = [(17, 2), (20, 1), (26, 0), (35, -2)]
PANIC_VOTE = -3


def numbered(bars: DataFrame) -> DataFrame:
    """Adds `i`, a bar's place in its symbol from 1, and `n`, the symbol's number of bars."""
    return bars.withColumns({"i": F.row_number().over(by()), "n": F.count("*").over(W.partitionBy("symbol"))})


def liquidity_sweeps(bars: DataFrame, swing: int = 3, recent_bars: int = 5) -> DataFrame:
    """The recent sweep of each symbol (type, level, bars_ago); symbols without one have no row.

    A bar among the last `recent_bars` sweeps bullishly if it undercuts an earlier swing low and
    closes above it (the earliest such low counts), bearishly mirrored at swing highs unless it
    also swept bullishly. The last bullish sweep counts; without one, the first bearish one.
    Only the recent bars meet the swings, so a symbol costs a few comparisons a swing.
    """
    d = numbered(bars)
    edge = d.where((F.col("n") >= 2 * swing + 2) & (F.col("i") > F.greatest(F.lit(swing), F.col("n") - recent_bars)))
    s = swings(d, swing).select("symbol", F.col("i").alias("_k"), F.when(F.col("swing_low"), F.col("l")).alias("_low"), F.when(F.col("swing_high"), F.col("h")).alias("_high"))
    up, down = (F.col("l") < F.col("_low")) & (F.col("c") > F.col("_low")), (F.col("h") > F.col("_high")) & (F.col("c") < F.col("_high"))
    met = edge.join(s, "symbol").where((F.col("_k") < F.col("i")) & (up | down))
    hit = met.groupBy("symbol", "n", "i").agg(F.min_by("_low", F.when(up, F.col("_k"))).alias("bullish"), F.min_by("_high", F.when(down, F.col("_k"))).alias("bearish"))
    last_up = F.max(F.when(F.col("bullish").isNotNull(), F.struct("i", F.col("bullish").alias("level"))))
    first_down = F.min(F.when(F.col("bullish").isNull(), F.struct("i", F.col("bearish").alias("level"))))
    g = hit.groupBy("symbol", "n").agg(last_up.alias("_u"), first_down.alias("_d")).withColumn("_x", F.coalesce("_u", "_d"))
    return g.select("symbol", F.when(F.col("_u").isNotNull(), "bullish").otherwise("bearish").alias("type"), F.round("_x.level", 4).alias("level"), (F.col("n") - F.col("_x.i")).alias("bars_ago"))


def swing_clusters(bars: DataFrame, swing: int = 3, keep: int = 6) -> DataFrame:
    """Swing prices clustered into levels: (symbol, level, touches, last_test_bars_ago, type, rank).

    In rising order a price joins the cluster below while it is within a quarter ATR of its mean
    (0.1 % of the last close where the ATR is zero). Ranked by touches, then by the latest test,
    then by price. Neighbours further apart than that can't share a cluster, so the fold runs
    over the stretches between such gaps, not over a symbol's whole history.
    """
    d = numbered(bars.withColumn("_tr", true_range()))
    back = F.col("n") - F.col("i")
    size = d.groupBy("symbol").agg(F.max_by("c", "t").alias("_spot"), F.max("n").alias("_all"), F.avg(F.when(back < F.least(F.lit(14), F.col("n") - 1), F.col("_tr"))).alias("_atr"))
    size = size.select("symbol", "_spot", "_all", F.when(F.col("_atr") > 0, 0.25 * F.col("_atr")).otherwise(F.col("_spot") * 0.001).alias("_tol"))
    s = swings(d, swing)
    p = s.where("swing_high").select("symbol", F.col("h").alias("price"), "i").union(s.where("swing_low").select("symbol", F.col("l").alias("price"), "i")).join(size, "symbol")
    w = W.partitionBy("symbol").orderBy("price", "i")
    gap = F.coalesce((F.col("price") - F.lag("price").over(w) > F.col("_tol")).cast("int"), F.lit(0))
    p = p.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        head, out = rows.iloc[0], []
        for price, i in sorted(zip(rows["price"], rows["i"])):
            if out and abs(price - out[-1][0] / out[-1][1]) <= head["_tol"]:
                total, touches, latest = out[-1]
                out[-1] = (total + price, touches + 1, max(latest, i))
            else:
                out.append((price, 1, i))
        return pd.DataFrame([(head["symbol"], head["_spot"], head["_all"], total / touches, touches, latest) for total, touches, latest in out], columns=["symbol", "spot", "n", "level", "touches", "i"])

    c = p.select("symbol", "_run", "price", "i", "_tol", "_spot", "_all").groupBy("symbol", "_run").applyInPandas(fold, "symbol string, spot double, n long, level double, touches int, i long")
    c = c.withColumn("last_test_bars_ago", F.col("n") - F.col("i"))
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("touches"), "last_test_bars_ago", "level"))
    kind = F.when(F.col("level") > F.col("spot"), "resistance").otherwise("support")
    return c.withColumn("rank", rank).where(F.col("rank") <= keep).select("symbol", F.round("level", 4).alias("level"), "touches", "last_test_bars_ago", kind.alias("type"), "rank")


def steps(value: Column, bounds: list, otherwise) -> Column:
    """The entry of the first bound above a value."""
    chain = F.when(value < bounds[0][0], bounds[0][1])
    for bound, entry in bounds[1:]:
        chain = chain.when(value < bound, entry)
    return chain.otherwise(otherwise)


def market_regime(closes: DataFrame, fear: str, fear_3m: str, index: str) -> DataFrame:
    """One row: the risk score of the market and its markers, from closes (symbol, t, c) of a volatility index, its
    three-month sister and a stock index. No row without a volatility index and without two closes of the stock index.

    Votes: level of the volatility index, its change over five closes (10 % either way), an inverted
    term structure, the stock index against its 200 and 50 day means, and its drawdown. From 3 on
    risk-on, from -3 risk-off.
    """
    d = recent(closes.where(F.col("symbol").isin(fear, fear_3m, index)).withColumn("_d", F.col("c") - F.lag("c").over(by())))
    within = lambda k, x: F.avg(F.when(F.col("back") <= k, x))
    g = d.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("back") == 1, F.col("c"))).alias("c"), F.max(F.when(F.col("back") == 6, F.col("c"))).alias("c6"), F.max("c").alias("peak"),
        within(50, F.col("c")).alias("m50"), within(200, F.col("c")).alias("m200"),
        within(14, F.greatest(F.col("_d"), F.lit(0.0))).alias("gain"), within(14, F.greatest(-F.col("_d"), F.lit(0.0))).alias("loss"),
    )
    pick = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    one = g.agg(
        pick(fear, "c").alias("vix"), pick(fear, "c6").alias("v6"), pick(fear_3m, "c").alias("vix3m"),
        *[pick(index, c).alias(a) for c, a in (("n", "n"), ("c", "_c"), ("peak", "peak"), ("m50", "_m50"), ("m200", "_m200"), ("gain", "gain"), ("loss", "loss"))],
    )
    has = F.col("n") >= 2
    one = one.where(F.col("vix").isNotNull() | has).withColumns({
        "index_close": F.when(has, F.col("_c")), "m50": F.when(F.col("n") >= 50, F.col("_m50")), "m200": F.when(F.col("n") >= 200, F.col("_m200")),
        "drawdown_pct": F.when(has, F.when(F.col("peak") > 0, (F.col("_c") / F.col("peak") - 1) * 100).otherwise(0.0)),
        "rsi": F.when(F.col("n") >= 15, F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))),
        "vix_change_pct": F.when(F.col("v6") != 0, (F.col("vix") / F.col("v6") - 1) * 100),
    })
    vote = lambda c: F.coalesce(c, F.lit(0))
    side = lambda m: vote(F.when(F.col("index_close") >= F.col(m), 1).when(F.col("index_close") < F.col(m), -1))
    score = (
        vote(F.when(F.col("vix").isNotNull(), steps(F.col("vix"), FEAR_VOTES, PANIC_VOTE)))
        + vote(F.when(F.col("vix_change_pct") > 10, -1).when(F.col("vix_change_pct") < -10, 1)) + vote(F.when(F.col("vix3m") < F.col("vix"), -2))
        + side("m200") + side("m50") + vote(F.when(F.col("drawdown_pct") <= -20, -2).when(F.col("drawdown_pct") <= -10, -1))
    )
    one = one.withColumn("risk_score", score.cast("int"))
    environment = F.when(F.col("risk_score") >= 3, "risk-on").when(F.col("risk_score") <= -3, "risk-off").otherwise("neutral / mixed")
    label = F.when(F.col("vix").isNotNull(), steps(F.col("vix"), FEAR, PANIC))
    return one.select(
        environment.alias("risk_environment"), "risk_score", "vix", label.alias("vix_label"), "vix_change_pct", "vix3m",
        F.when(F.col("vix3m") < F.col("vix"), "backwardation").when(F.col("vix3m") >= F.col("vix"), "contango").alias("term_structure"), "index_close", "drawdown_pct",
        F.when(F.col("m50") >= F.col("m200"), "golden").when(F.col("m50") < F.col("m200"), "death").alias("ma_cross"), "rsi", F.when(F.col("rsi") >= 70, "overbought").when(F.col("rsi") <= 30, "oversold").alias("rsi_state"),
    )


def session_bars(bars: DataFrame) -> DataFrame:
    """The bars on the UTC date of each symbol's last bar."""
    day = F.to_date("t")
    return bars.withColumn("_last", F.max(day).over(W.partitionBy("symbol"))).where(day == F.col("_last")).drop("_last")


def regular_session(bars: DataFrame) -> DataFrame:
    """Bars from 09:30 to before 16:00 in New York, with that date as `day`."""
    m = minute_of_day(F.col("t"))
    return bars.where((m >= 570) & (m < 960)).withColumn("day", F.date_format(eastern(F.col("t")), "yyyy-MM-dd"))


def todays_range(days: DataFrame, bars: DataFrame) -> DataFrame:
    """Open, high and low of each symbol's last session: of its daily bar if there is one of that date, else of the session's bars."""
    g = session_bars(bars).groupBy("symbol", F.to_date("t").alias("day")).agg(F.min_by("o", "t").alias("_o"), F.max("h").alias("_h"), F.min("l").alias("_l"))
    d = days.select("symbol", F.to_date("t").alias("day"), "o", "h", "l", F.lit(True).alias("_daily"))
    both = g.join(d, ["symbol", "day"], "left")
    return both.select("symbol", "day", *[F.coalesce(c, f"_{c}").alias(c) for c in "ohl"], F.coalesce("_daily", F.lit(False)).alias("from_daily"))


def rejection(o: Column, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    """'bullish_rejection' or 'bearish_rejection' where one wick takes half the range at least, exceeds the body and the other wick; else null."""
    size, body, low, high = h - l, F.abs(c - o), F.least(o, c) - l, h - F.greatest(o, c)
    tail = lambda a, b: (size > 0) & (a >= size * 0.5) & (a > body) & (b < a)
    return F.when(tail(low, high), "bullish_rejection").when(tail(high, low), "bearish_rejection")


def momentum_pct(bars: DataFrame, minutes: int = 10) -> DataFrame:
    """Percent change of each symbol's last close from that of the latest bar at least `minutes` older, or of its oldest bar."""
    old = F.unix_seconds(F.col("t").cast("timestamp")) <= F.unix_seconds(F.col("_z").cast("timestamp")) - 60 * minutes
    d = bars.withColumn("_z", F.max("t").over(W.partitionBy("symbol")))
    g = d.groupBy("symbol").agg(F.max_by("c", "t").alias("c"), F.coalesce(F.max_by("c", F.when(old, F.col("t"))), F.min_by("c", "t")).alias("base"))
    return g.select("symbol", "c", "base", F.when(F.col("base") != 0, (F.col("c") / F.col("base") - 1) * 100).alias("momentum_pct"))


def session_spikes(bars: DataFrame, warmup: int = 15, times: float = 3.0, width: int = 5, flat: float = 8.0) -> DataFrame:
    """Volume peaks of each symbol's regular sessions: (symbol, day, t, price, rel_vol, v, type).

    The base is the median of the positive volumes from `warmup` minutes after 09:30; bars of `times`
    that much are peaks, the largest first, none within `width` bars of a larger one. A rise over
    `width` bars before that doesn't go on after is supply, a fall that doesn't is demand; moves
    within `flat` basis points are none. Sessions of fewer than warmup + 2 * width bars are left out.
    """
    whole = W.partitionBy("symbol", "day")
    w = whole.orderBy("t")
    d = regular_session(bars).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole), "_a": F.coalesce(F.lag("c", width).over(w), F.first("c").over(w)), "_z": F.coalesce(F.lead("c", width).over(w), F.last("c").over(w.rowsBetween(0, W.unboundedFollowing)))})
    d = d.where(F.col("n") >= warmup + 2 * width).where(minute_of_day(F.col("t")) >= 570 + warmup)
    d = d.withColumn("_base", F.median(F.when(F.col("v") > 0, F.col("v"))).over(whole)).where((F.col("_base") > 0) & (F.col("v") >= times * F.col("_base")))
    kept = folds.suppress_neighbours(d, width, ["symbol", "day"]).select("symbol", "day", "i")
    sign = lambda a, z: F.when(a == 0, 0).otherwise(F.when((z - a) / a * 10_000 > flat, 1).when((z - a) / a * 10_000 < -flat, -1).otherwise(0))
    before, after = sign(F.col("_a"), F.col("c")), sign(F.col("c"), F.col("_z"))
    kind = F.when((before > 0) & (after <= 0), "supply").when((before < 0) & (after >= 0), "demand").otherwise("unsure")
    d = d.join(kept, ["symbol", "day", "i"], "left_semi")
    return d.select("symbol", "day", "t", F.round((F.col("h") + F.col("l") + F.col("c")) / 3, 4).alias("price"), F.round(F.col("v") / F.col("_base"), 2).alias("rel_vol"), "v", kind.alias("type"))


def standing_targets(targets: DataFrame, tracked: list[str], price: float) -> DataFrame:
    """The latest target (firm, date, target, id) of each tracked firm, whose name is part of the row's firm in any case, with its upside in percent."""
    names = F.explode(F.filter(F.array(*map(F.lit, tracked)), lambda x: F.contains(F.lower("firm"), F.lower(x))))
    g = targets.where("target is not null").withColumn("tracked", names).groupBy("tracked").agg(F.max(F.struct("date", "id", "target")).alias("x"))
    return g.select(F.col("tracked").alias("firm"), "x.date", "x.target", F.round((F.col("x.target") / F.nullif(F.lit(float(price)), F.lit(0.0)) - 1) * 100, 1).alias("upside_pct"))


def levels_around(levels: DataFrame, spot: DataFrame) -> DataFrame:
    """levels (symbol, level, price) against spot (symbol, c): those above as resistance, those below as support, each ranked nearest first; a level at the spot is neither."""
    d = levels.join(spot.select("symbol", "c"), "symbol").where("price <> c").withColumn("side", F.when(F.col("price") > F.col("c"), "resistance").otherwise("support"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("symbol", "side").orderBy(F.abs(F.col("price") - F.col("c")), "level"))).select("symbol", "level", "price", "side", "rank")


def smart_money_setup(days: DataFrame, bars: DataFrame, least: float = 3.0, buffer: float = 0.1) -> DataFrame:
    """One row per symbol of at least eight daily bars: signal (long_setup, watching, no_setup), quality, zones, confirmations and plan.

    Demand is the highest bullish block that starts at or below the last intraday close, supply the
    lowest bearish one that ends at or above it. Confirmations: a bullish rejection on the last bar,
    the nearest bullish gap filled, a break of structure, a bullish sweep. A long setup needs a
    close inside demand, a regime that isn't bearish, a confirmation and `least` as reward to risk.
    """
    w = W.partitionBy("symbol")
    d = recent(days).withColumns({"_days": F.count("*").over(w)}).where("_days >= 8")
    head = d.groupBy("symbol").agg(F.max(F.when(F.col("back") == 1, F.col("c"))).alias("_dc"), F.max(F.when(F.col("back") <= 20, F.col("h"))).alias("_high"), F.min(F.when(F.col("back") <= 20, F.col("l"))).alias("_low"))
    b = recent(bars).withColumn("_bars", F.count("*").over(w)).where("back = 1")
    b = b.select("symbol", F.col("c").alias("_ic"), "_bars", rejection(*map(F.col, "ohlc")).alias("_candle"))
    base = head.join(b, "symbol", "left").withColumn("spot", F.coalesce("_ic", "_dc"))
    spot = base.select("symbol", "spot")
    blocks = order_blocks(days).join(spot, "symbol")
    zone = F.struct("top", "bottom", "mitigated")
    zones = blocks.groupBy("symbol").agg(
        F.max(F.when((F.col("kind") == "bullish") & (F.col("bottom") <= F.col("spot")), zone)).alias("demand"),
        F.min(F.when((F.col("kind") == "bearish") & (F.col("top") >= F.col("spot")), F.struct("bottom", "top", "mitigated"))).alias("supply"),
    )
    gaps = filled_gaps(bars).join(spot, "symbol").where((F.col("kind") == "bullish") & (F.col("bottom") <= F.col("spot") * 1.001))
    gaps = gaps.groupBy("symbol").agg(F.max(F.struct("top", "bottom", "filled")).alias("gap"))
    enough = F.col("_bars") >= 3
    g = (
        base.join(zones, "symbol", "left").join(gaps, "symbol", "left").join(trend(days).select("symbol", F.col("trend").alias("regime")), "symbol", "left")
        .join(break_of_structure(bars).select("symbol", "broken"), "symbol", "left").join(liquidity_sweeps(bars).select("symbol", F.col("type").alias("sweep")), "symbol", "left")
    )
    signs = {"rejection_candle": F.col("_candle") == "bullish_rejection", "fvg_fill": F.col("gap.filled"), "breaker": (F.col("_bars") >= 10) & F.col("broken"), "liquidity_sweep": F.col("sweep") == "bullish"}
    place = (F.col("spot") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    g = g.withColumns({
        "confirmations": F.array_compact(F.array(*[F.when(enough & yes, name) for name, yes in signs.items()])),
        "inside": F.coalesce(F.col("spot").between(F.col("demand.bottom"), F.col("demand.top")), F.lit(False)),
        "zone": F.when(place < 0.45, "discount").when(place > 0.55, "premium").when(place.isNotNull(), "equilibrium"),
    })
    g = g.withColumn("entry", F.when(F.col("demand").isNotNull(), F.round(F.when(F.col("inside"), F.col("spot")).otherwise(F.col("demand.top")), 4)))
    height = F.greatest(F.col("demand.top") - F.col("demand.bottom"), F.col("entry") * 0.001)
    target = F.when(F.col("supply.bottom") > F.col("entry"), F.col("supply.bottom")).when(F.col("_high") > F.col("entry"), F.round("_high", 4))
    g = g.withColumns({"stop": F.round(F.col("demand.bottom") - buffer * height, 4), "target": target})
    g = g.withColumn("plan", block_geometry(F.col("entry"), F.col("stop"), F.col("target"), least))
    meets = F.coalesce("plan.meets", F.lit(False))
    found = F.size("confirmations")
    signal = F.when(F.col("demand").isNull() | (F.col("regime") == "bearish"), "no_setup").when(F.col("inside") & (found > 0) & meets, "long_setup").otherwise("watching")
    best = (found >= 2) & (F.col("regime") == "bullish") & (F.col("zone") == "discount") & (F.col("plan.ratio") >= 4)
    g = g.withColumn("signal", signal)
    quality = F.when((F.col("signal") == "long_setup") & best, "A+").when(F.col("signal") == "long_setup", "B").otherwise("C")
    return g.select("symbol", "signal", quality.alias("quality"), "regime", "spot", "demand", "supply", F.col("inside").alias("price_in_block"), "zone", "confirmations", "sweep", "gap", "entry", "stop", "target", F.col("plan.ratio").alias("reward_risk"), meets.alias("meets"))
