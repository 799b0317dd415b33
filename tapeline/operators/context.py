"""What a session is read against: closes over several spans, macro markers, option walls over time, expiries, chosen and labelled news, candle bodies, target lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.clock import eastern, session_window
from tapeline.operators.joins import in_gaps
from tapeline.operators.options import gamma_flip, walls

#: Spans of the price context in days, upper ends of the volatility regimes, windows in which breaks follow through.
SPANS = (7, 30, 90, 365)
REGIMES = ((30, "fear/spike"), (20, "elevated"), (15, "moderate"))
CALM = "complacency"
FAVOURABLE = ("opening_window", "other_session_hours", "power_hour")


def _since(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    at = F.lit(as_of).cast(rows.schema["t"].dataType)
    return rows.where((F.col("t") >= at - F.expr(f"interval {days} days")) & (F.col("t") < at) & F.col("c").isNotNull())


def price_context(closes: DataFrame, as_of: str, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """(symbol, days, change_pct, low, high, last) of the closes (symbol, t, c) of each span of days before `as_of`.

    A span with fewer than two closes gives no row; null closes count as none; closes must be
    unique by (symbol, t). A first close of zero has no change. All spans are folded in one pass.
    """
    at = F.lit(as_of).cast(closes.schema["t"].dataType)

    def facts(days: int) -> Column:
        inside = lambda x: F.when(F.col("t") >= at - F.expr(f"interval {days} days"), x)
        point = inside(F.struct("t", "c"))
        return F.struct(
            F.lit(days).alias("days"), F.count(inside(F.col("c"))).alias("n"), F.min(point)["c"].alias("first"),
            F.min(inside(F.col("c"))).alias("low"), F.max(inside(F.col("c"))).alias("high"), F.max(point)["c"].alias("last"),
        )

    g = _since(closes, as_of, max(spans)).groupBy("symbol").agg(*[facts(d).alias(f"s{d}") for d in spans])
    each = g.select("symbol", F.inline(F.array(*[f"s{d}" for d in spans]))).where("n >= 2")
    return each.select("symbol", "days", ((F.col("last") / F.nullif("first", F.lit(0.0)) - 1) * 100).alias("change_pct"), "low", "high", "last")


def macro_context(closes: DataFrame, fear: str, fear_3m: str, index: str, as_of: str, days: int = 30) -> DataFrame:
    """One row of the last `days` before `as_of`: (index_week_pct, index_month_pct, index_close, vix, regime, vix3m, term_structure).

    The index's week is its last against its fifth close from the end and needs five closes, its
    month the last against the first of the span and needs twenty. Markers without closes are
    null; the three-month index counts only beside the volatility index.
    """
    d = _since(closes, as_of, days).where(F.col("symbol").isin(fear, fear_3m, index))
    w = W.partitionBy("symbol")
    d = d.withColumns({"_back": F.row_number().over(w.orderBy(F.desc("t"))), "_n": F.count("*").over(w)})
    pick = lambda s, cond: F.max(F.when((F.col("symbol") == s) & cond, F.col("c")))
    last = F.col("_back") == 1
    one = d.agg(
        pick(index, last & (F.col("_n") >= 5)).alias("index_close"), pick(index, F.col("_back") == 5).alias("_week"),
        pick(index, (F.col("_back") == F.col("_n")) & (F.col("_n") >= 20)).alias("_month"), pick(fear, last).alias("vix"), pick(fear_3m, last).alias("_3m"),
    )
    change = lambda c: (F.col("index_close") / F.nullif(c, F.lit(0.0)) - 1) * 100
    regime = F.when(F.col("vix").isNull(), F.lit(None))
    for bound, name in REGIMES:
        regime = regime.when(F.col("vix") > bound, name)
    vix3m = F.when(F.col("vix").isNotNull(), F.col("_3m"))
    return one.select(
        change("_week").alias("index_week_pct"), change("_month").alias("index_month_pct"), "index_close", "vix", regime.otherwise(CALM).alias("regime"), vix3m.alias("vix3m"),
        F.when(vix3m > F.col("vix"), "contango").when(vix3m <= F.col("vix"), "backwardation").alias("term_structure"),
    )


def wall_trends(history: DataFrame) -> DataFrame:
    """(symbol, call_wall_trend, put_wall_trend): rising, falling or flat, from the first to the last of walls
    (symbol, taken, call_wall, put_wall); null with fewer than two snapshots or where either end is null."""
    ends = lambda c: (F.min(F.struct("taken", c))[c], F.max(F.struct("taken", c))[c])

    def trend(c: str) -> Column:
        a, z = ends(c)
        return F.when(F.count("*") >= 2, F.when(z > a, "rising").when(z < a, "falling").when(z == a, "flat")).alias(f"{c}_trend")

    return history.groupBy("symbol").agg(trend("call_wall"), trend("put_wall"))


def wall_read(exposure: DataFrame, spot: float, history: DataFrame | None = None) -> DataFrame:
    """One row per symbol of a chain with net_gamma (options.gamma_exposure): its walls, where `spot` stands to them, gamma and trends.

    position: inside, above the call wall, or below the put wall (above, where the walls are the
    wrong way round and both hold). range_position_pct: 0 at the put wall, 100 at the call wall,
    null where they coincide or are the wrong way round. near: within 1 % of a wall. Without
    history there are no trends.
    """
    facts = walls(exposure).select("symbol", "call_wall", "put_wall").join(exposure.groupBy("symbol").agg(F.sum("net_gamma").alias("net_gamma")), "symbol").join(gamma_flip(exposure), "symbol", "left")
    none = F.lit(None).cast("string")
    facts = facts.join(wall_trends(history), "symbol", "left") if history is not None else facts.withColumns({"call_wall_trend": none, "put_wall_trend": none})
    x, call, put = F.lit(float(spot)), F.col("call_wall"), F.col("put_wall")
    near = lambda wall: (wall > 0) & (F.abs(x - wall) / F.nullif(wall, F.lit(0.0)) < 0.01)
    return facts.select(
        "symbol", "call_wall", "put_wall", F.col("flip").alias("gamma_flip"), "net_gamma", F.when(F.col("net_gamma") >= 0, "dampening").otherwise("amplifying").alias("gamma_regime"),
        F.when((put <= x) & (x <= call), "inside").when(x > call, "above").otherwise("below").alias("position"),
        F.when(call > put, F.round((x - put) / (call - put) * 100, 1)).alias("range_position_pct"),
        F.coalesce(near(call), F.lit(False)).alias("near_call_wall"), F.coalesce(near(put), F.lit(False)).alias("near_put_wall"), "call_wall_trend", "put_wall_trend",
    )


def nearest_expiry(expiries: DataFrame, today: str, max_dte: int = 45) -> DataFrame:
    """Per symbol of expiries (symbol, expiry) the nearest within `max_dte` days from `today` on, else the nearest after, else the earliest of all; with days to it. Null expiries are ignored."""
    days = F.datediff("expiry", F.lit(today).cast("date"))
    rank = F.when(days.between(0, max_dte), 0).when(days >= 0, 1).otherwise(2)
    g = expiries.where("expiry is not null").groupBy("symbol").agg(F.min(F.struct(rank.alias("rank"), F.to_date("expiry").alias("expiry"), days.alias("dte"))).alias("x"))
    return g.select("symbol", "x.expiry", "x.dte")


def chosen_news(news: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (pick, title, text) with the item of news (id, title, text, ...) that has the same title and text but for case.

    Of items alike the one with the largest id; choices that match none are left out, as are null
    titles and texts. Returns pick and the columns of the item.
    """
    key = lambda: [F.lower("title").alias("_title"), F.lower("text").alias("_text")]
    last = news.groupBy(*key()).agg(F.max_by(F.struct(*news.columns), "id").alias("item"))
    return chosen.select("pick", *key()).join(last, ["_title", "_text"]).select("pick", "item.*")


def labelled_news(news: DataFrame, impacts: DataFrame) -> DataFrame:
    """news (id, ...) with the impact of impacts (id, impact), `unknown` where there is none; ids must be unique in impacts."""
    found = impacts.select(F.col("id").alias("_id"), F.col("impact").alias("_impact"))
    return news.join(found, F.col("id") == F.col("_id"), "left").withColumn("impact", F.coalesce("_impact", F.lit("unknown"))).drop("_id", "_impact")


def candle_bodies(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """(symbol, t, rising, base, height, p20, p80, from_trades) per bar, for drawing candles.

    base and height: the lower of open and close, and how far they are apart. p20 and p80: the
    percentiles of the trades (symbol, t, p) in the bar, up to the next bar (joins.in_gaps), or a
    fifth and four fifths of its range where it has none.
    """
    binned = in_gaps(trades.select("symbol", "t", "p"), bars.select("symbol", "t"))
    got = binned.groupBy("symbol", F.col("bar_t").alias("t")).agg(F.percentile("p", 0.2).alias("_20"), F.percentile("p", 0.8).alias("_80"))
    within = lambda k: F.col("l") + k * (F.col("h") - F.col("l"))
    return bars.join(got, ["symbol", "t"], "left").select(
        "symbol", "t", (F.col("c") >= F.col("o")).alias("rising"), F.least("o", "c").alias("base"), F.abs(F.col("c") - F.col("o")).alias("height"),
        F.coalesce("_20", within(0.2)).alias("p20"), F.coalesce("_80", within(0.8)).alias("p80"), F.col("_20").isNotNull().alias("from_trades"),
    )


def breakout_gate(moments: DataFrame, ranges: DataFrame) -> DataFrame:
    """moments (t, ...) with `refused`: why no breakout is to be traded then, or null where it may be.

    The time must be in a window that favours breaks, and at least one symbol must have an opening
    range (symbol, day, high) of that New York date. A null time favours none. Ranges are reduced to dates before the join.
    """
    measured = ranges.where("high is not null").select(F.col("day").alias("_day")).distinct()
    d = moments.join(measured, F.date_format(eastern(F.col("t")), "yyyy-MM-dd") == F.col("_day"), "left")
    favourable = F.col("t").isNotNull() & session_window(F.col("t")).isin(*FAVOURABLE)
    return d.withColumn("refused", F.when(~favourable, "window does not favour breakouts").when(F.col("_day").isNull(), "no symbol has an opening range")).drop("_day")


def target_steps(targets: DataFrame, first: str, last: str, base: float) -> DataFrame:
    """(firm, step, moment, target, pct): the points of each firm's line of targets (firm, date, target, id), for drawing steps.

    Dates are moved into [first, last], and a point at `last` with the newest target ends each line;
    pct is the target against `base` in percent. Steps follow date, then id; rows without target are ignored.
    """
    d = targets.where("target is not null and date is not null")
    kind = targets.schema["date"].dataType
    low, high = F.lit(first).cast(kind), F.lit(last).cast(kind)
    step = F.row_number().over(W.partitionBy("firm").orderBy("date", "id"))
    points = d.select("firm", step.cast("long").alias("step"), F.least(F.greatest("date", low), high).alias("moment"), "target")
    ends = d.groupBy("firm").agg((F.count("*") + 1).alias("step"), F.max(F.struct("date", "id", "target"))["target"].alias("target"))
    every = points.unionByName(ends.select("firm", "step", high.alias("moment"), "target"))
    return every.withColumn("pct", (F.col("target") / base - 1) * 100)
