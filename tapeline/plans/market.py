"""Registered market queries, each with its SQL. Times are returned as text, ratios rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.clock import session_window
from tapeline.operators import bars as B
from tapeline.operators import folds as D
from tapeline.operators import indicators as I
from tapeline.operators import joins as J
from tapeline.operators import kernels as K
from tapeline.operators import levels as L
from tapeline.operators import options as O
from tapeline.operators import pace as C
from tapeline.operators import portfolio as P
from tapeline.operators import records as E
from tapeline.operators import rules as R
from tapeline.operators import scoring as G
from tapeline.operators import structure as S
from tapeline.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TRADES = "trades AS (SELECT event_type AS symbol, ts AS t, value AS p, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS s, event_id AS id FROM events)"
_BAR = "SELECT symbol, {t} AS t, arg_min(p, row(t, id)) AS o, max(p) AS h, min(p) AS l, arg_max(p, row(t, id)) AS c, CAST(sum(s) AS BIGINT) AS v, sum(p * s) / sum(s) AS vw FROM trades GROUP BY symbol, {t}"
HOURS = f"{TRADES}, bars AS ({_BAR.format(t="time_bucket(INTERVAL 1 hour, trades.t)")})"
NY_DAY = "CAST(CAST(timezone('America/New_York', timezone('UTC', trades.t)) AS DATE) AS TIMESTAMP)"
DAYS = f"{TRADES}, bars AS ({_BAR.format(t=NY_DAY)})"
QUARTERS = f"{TRADES}, bars AS ({_BAR.format(t="time_bucket(INTERVAL 15 minute, trades.t)")})"
HALVES = f"{TRADES}, bars AS ({_BAR.format(t="time_bucket(INTERVAL 30 minute, trades.t)")})"
LEDGER = "ledger AS (SELECT CAST(user_id AS VARCHAR) AS account, row_number() OVER a AS seq, ts, event_type AS symbol, CASE WHEN row_number() OVER a % 2 = 1 THEN 'buy' ELSE 'sell' END AS action, value AS price FROM events WHERE event_type = 'purchase' WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id))"
CHAIN = "chain AS (SELECT p_brand AS symbol, CAST(p_size AS DOUBLE) AS strike, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS call_oi, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS put_oi, round(avg(0.10 + (p_partkey % 40) / 100.0), 6) AS iv FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def half_up(x: str, places: int) -> str:
    """SQL that rounds the shortest decimal form of a double, halves away from zero, as F.round does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 22)), {places}) AS DOUBLE)"


def r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def hours(spark, d):
    return B.rollup(V.trades(spark, d), 60)


def days(spark, d):
    return B.daily(V.trades(spark, d))


@query(f"WITH {QUARTERS} SELECT symbol, {TEXT.format('t')} AS t, o, h, l, c, v, round(vw, 6) AS vw FROM bars")
def ohlcv_rollup(spark, d):
    return B.rollup(V.trades(spark, d), 15).select("symbol", text("t"), "o", "h", "l", "c", "v", r("vw"))


@query(f"WITH {DAYS} SELECT symbol, {TEXT.format('t')} AS t, o, h, l, c, v, round(vw, 6) AS vw FROM bars")
def daily_bars(spark, d):
    return days(spark, d).select("symbol", text("t"), "o", "h", "l", "c", "v", r("vw"))


@query(f"WITH {TRADES} SELECT symbol, {TEXT.format('max(t)')} AS t, arg_max(p, row(t, id)) AS p, arg_max(s, row(t, id)) AS s FROM trades GROUP BY symbol")
def latest_trade(spark, d):
    return V.trades(spark, d).groupBy("symbol").agg(F.max(F.struct("t", "id", "p", "s")).alias("x")).select("symbol", text("x.t").alias("t"), "x.p", "x.s")


@query(
    f"WITH {HALVES}, s AS (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM bars), m AS (SELECT symbol, min(gap) AS step FROM s GROUP BY symbol HAVING count(*) >= 3), "
    "e AS (SELECT symbol, CAST(t AS DATE) AS d, min(t) AS a, max(t) AS z FROM bars GROUP BY ALL), g AS (SELECT e.symbol, unnest(generate_series(a, z, step)) AS t FROM e JOIN m ON e.symbol = m.symbol), "
    "j AS (SELECT coalesce(g.symbol, b.symbol) AS symbol, coalesce(g.t, b.t) AS t, b.* EXCLUDE (symbol, t) FROM g FULL JOIN bars b ON g.symbol = b.symbol AND g.t = b.t), "
    "k AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM j) "
    f"SELECT symbol, {TEXT.format('t')} AS t, coalesce(o, p) AS o, coalesce(h, p) AS h, coalesce(l, p) AS l, p AS c, coalesce(v, 0) AS v, c IS NULL AS synthetic FROM k"
)
def gap_fill(spark, d):
    return B.fill_gaps(B.rollup(V.trades(spark, d), 30)).select("symbol", text("t"), "o", "h", "l", "c", "v", "synthetic")



@query(
    f"WITH {HOURS}, w AS (SELECT symbol, t, CASE WHEN count(*) OVER a = 20 THEN avg(c) OVER a END AS sma_20, CASE WHEN count(*) OVER b = 50 THEN avg(c) OVER b END AS sma_50, "
    "CASE WHEN count(*) OVER e = 15 THEN sum(c * v) OVER e / sum(v) OVER e END AS vwma_15 FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY t ROWS 49 PRECEDING), e AS (PARTITION BY symbol ORDER BY t ROWS 14 PRECEDING)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, round(sma_20, 6) AS sma_20, round(sma_50, 6) AS sma_50, {half_up('vwma_15', 6)} AS vwma_15 FROM w"
)
def moving_averages(spark, d):
    x = I.vwma(I.sma(I.sma(hours(spark, d), 20, "sma_20"), 50, "sma_50"), 15, "vwma_15")
    return x.select("symbol", text("t"), r("sma_20"), r("sma_50"), r("vwma_15"))


@query(
    f"WITH {HOURS}, a AS (SELECT *, c - lag(c) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), b AS (SELECT symbol, t, count(d) OVER w AS n, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS x FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, CASE WHEN n = 14 THEN CASE WHEN x = 0 THEN 100.0 ELSE round(100 - 100 / (1 + g / x), 6) END END AS rsi FROM b"
)
def rsi(spark, d):
    return I.rsi(hours(spark, d)).select("symbol", text("t"), r("rsi"))


_ADX = (
    "a AS (SELECT *, lag(c) OVER w AS pc, h - lag(h) OVER w AS up, lag(l) OVER w - l AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), "
    "b AS (SELECT symbol, t, greatest(h - l, abs(h - pc), abs(l - pc)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM a), "
    "e AS (SELECT symbol, t, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS trs, CASE WHEN count(p) OVER w = 14 THEN avg(p) OVER w END AS ps, CASE WHEN count(m) OVER w = 14 THEN avg(m) OVER w END AS ms FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING)), "
    "f AS (SELECT symbol, t, trs, 100 * ps / nullif(trs, 0) AS pd, 100 * ms / nullif(trs, 0) AS md FROM e), g AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM f) "
)


@query(f"WITH {HOURS}, {_ADX} SELECT symbol, {TEXT.format('t')} AS t, round(trs, 6) AS atr, round(pd, 6) AS plus_di, round(md, 6) AS minus_di, round(CASE WHEN count(dx) OVER w = 14 THEN avg(dx) OVER w END, 6) AS adx FROM g WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING)")
def atr_adx(spark, d):
    return I.adx(I.atr(hours(spark, d))).select("symbol", text("t"), r("atr"), r("plus_di"), r("minus_di"), r("adx"))


@query(
    f"WITH {HOURS}, a AS (SELECT symbol, t, CASE WHEN lag(c) OVER w IS NULL THEN 0 ELSE sign(c - lag(c) OVER w) END * v AS x FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), b AS (SELECT symbol, t, sum(x) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS obv FROM a), "
    "e AS (SELECT *, obv - lag(obv, 19) OVER (PARTITION BY symbol ORDER BY t) AS s FROM b) "
    f"SELECT symbol, {TEXT.format('t')} AS t, CAST(obv AS DOUBLE) AS obv, CASE WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' WHEN s = 0 THEN 'flat' END AS obv_trend FROM e"
)
def obv_trend(spark, d):
    return I.obv(hours(spark, d)).select("symbol", text("t"), "obv", "obv_trend")


@query(
    f"WITH {HOURS}, a AS (SELECT *, (h + l + c) / 3 AS tp, sum((h + l + c) / 3 * v) OVER w / sum(v) OVER w AS vwap FROM bars WINDOW w AS (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t ROWS UNBOUNDED PRECEDING)), "
    "b AS (SELECT *, sqrt(sum(v * (tp - vwap) ^ 2) OVER w / sum(v) OVER w) AS sigma FROM a WINDOW w AS (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t ROWS UNBOUNDED PRECEDING)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, round(vwap, 6) AS vwap, round(sigma, 6) AS sigma, round(CASE WHEN sigma > 1e-9 THEN (c - vwap) / sigma END, 5) AS z FROM b"
)
def vwap_bands(spark, d):
    return I.vwap_bands(hours(spark, d)).select("symbol", text("t"), r("vwap"), r("sigma"), r("z", 5))


@query(
    f"WITH {DAYS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS x FROM bars), b AS (SELECT *, c / lag(c) OVER o - 1 AS ret, ln(c) - lag(ln(c)) OVER o AS log_ret, count(*) OVER w AS n, max(h) OVER w AS hi, min(l) OVER w AS lo, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z, count(*) OVER f AS m, regr_slope(ln(c), x) OVER f AS s5, regr_slope(ln(c), x) OVER w AS s20 FROM a WINDOW o AS (PARTITION BY symbol ORDER BY t), w AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING), f AS (PARTITION BY symbol ORDER BY t ROWS 4 PRECEDING)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, round(ret, 6) AS ret, round(log_ret, 6) AS log_ret, CASE WHEN n = 20 THEN hi END AS high_20, CASE WHEN n = 20 THEN lo END AS low_20, CASE WHEN n = 20 THEN round(z, 6) END AS vol_z, CASE WHEN m = 5 THEN round(s5, 6) END AS slope_5, CASE WHEN n = 20 THEN round(s20, 6) END AS slope_20, round(CASE WHEN count(log_ret) OVER v = 20 THEN stddev_samp(log_ret) OVER v END, 6) AS volatility_20 FROM b WINDOW v AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING)"
)
def price_features(spark, d):
    return I.features(days(spark, d)).select("symbol", text("t"), r("ret"), r("log_ret"), "high_20", "low_20", r("vol_z"), r("slope_5"), r("slope_20"), r("volatility_20"))


@query(
    f"WITH {DAYS}, a AS (SELECT symbol, t, c / lag(c) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM bars), b AS (SELECT a.symbol, a.r, m.r AS m FROM a JOIN a m ON a.t = m.t AND m.symbol = 'purchase' WHERE a.symbol <> 'purchase' AND a.r IS NOT NULL AND m.r IS NOT NULL) "
    "SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(covar_samp(r, m) / var_samp(m), 6) END AS beta FROM b GROUP BY symbol"
)
def beta(spark, d):
    return I.beta(days(spark, d), "purchase").select("symbol", "n", r("beta"))


@query(
    f"WITH {HOURS}, w AS (SELECT *, lag(h) OVER o AS ph, lag(l) OVER o AS pl, lag(c) OVER o AS pc FROM ({_BAR.format(t=NY_DAY)}) WINDOW o AS (PARTITION BY symbol ORDER BY t)), p AS (SELECT symbol, t, ph AS h, pl AS l, (ph + pl + pc) / 3 AS p FROM w WHERE pc IS NOT NULL), "
    "u AS (SELECT symbol, t, 'P' AS level, p AS price FROM p UNION ALL SELECT symbol, t, 'R1', 2 * p - l FROM p UNION ALL SELECT symbol, t, 'S1', 2 * p - h FROM p UNION ALL SELECT symbol, t, 'R2', p + (h - l) FROM p UNION ALL SELECT symbol, t, 'S2', p - (h - l) FROM p UNION ALL SELECT symbol, t, 'R3', h + 2 * (p - l) FROM p UNION ALL SELECT symbol, t, 'S3', l - 2 * (h - p) FROM p) "
    f"SELECT symbol, {TEXT.format('t')} AS t, level, round(price, 6) AS price FROM u"
)
def floor_pivots(spark, d):
    return L.floor_pivots(days(spark, d)).select("symbol", text("t"), "level", r("price"))


@query(f"WITH {HOURS}, g AS (SELECT symbol, max(h) AS h, min(l) AS l FROM bars GROUP BY symbol) SELECT symbol, CAST(ratio AS DOUBLE) AS ratio, round(h - ratio * (h - l), 6) AS price FROM g, (SELECT unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]) AS ratio) WHERE h > l")
def fibonacci_levels(spark, d):
    return L.fibonacci(hours(spark, d)).select("symbol", "ratio", r("price"))


@query(f"WITH {HOURS} SELECT symbol, {TEXT.format('t')} AS t, min(l) OVER w AS support, max(h) OVER w AS resistance FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING)")
def support_resistance(spark, d):
    return L.support_resistance(hours(spark, d)).select("symbol", text("t"), "support", "resistance")


@query(f"WITH {HOURS} SELECT symbol, max(h) AS peak, round(CASE WHEN max(h) > 0 THEN (arg_max(c, t) / max(h) - 1) * 100 ELSE 0 END, 6) AS drawdown_pct FROM bars GROUP BY symbol")
def drawdown(spark, d):
    return L.drawdown(hours(spark, d)).select("symbol", "peak", r("drawdown_pct"))


@query(f"WITH {HALVES}, a AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS e FROM bars) SELECT symbol, strftime(e, '%Y-%m-%d') AS day, max(h) AS high, min(l) AS low, round(avg(v), 6) AS avg_volume, count(*) AS n FROM a WHERE hour(e) * 60 + minute(e) >= 570 AND hour(e) * 60 + minute(e) < 630 GROUP BY ALL")
def opening_range(spark, d):
    return L.opening_range(B.rollup(V.trades(spark, d), 30)).select("symbol", "day", "high", "low", r("avg_volume"), "n")


@query(
    f"WITH {HALVES}, a AS (SELECT *, strftime(timezone('America/New_York', timezone('UTC', t)), '%Y-%m-%d') AS day, hour(timezone('America/New_York', timezone('UTC', t))) * 60 + minute(timezone('America/New_York', timezone('UTC', t))) < 570 AS pre FROM bars), g AS (SELECT symbol, day, max(CASE WHEN pre THEN h END) AS premarket_high, min(CASE WHEN pre THEN l END) AS premarket_low, max(CASE WHEN NOT pre THEN h END) AS session_high, min(CASE WHEN NOT pre THEN l END) AS session_low, max(h) AS h, min(l) AS l, arg_max(c, t) AS c FROM a GROUP BY ALL) "
    "SELECT symbol, day, premarket_high, premarket_low, session_high, session_low, lag(h) OVER w AS prior_high, lag(l) OVER w AS prior_low, lag(c) OVER w AS prior_close FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day)"
)
def key_levels(spark, d):
    return L.key_levels(B.rollup(V.trades(spark, d), 30))


_PROFILE = (
    f"WITH {HOURS}, s AS (SELECT symbol, min(l) AS lo, max(h) AS hi FROM bars GROUP BY symbol HAVING max(h) > min(l)), f AS (SELECT b.symbol, CAST(least(greatest(floor(((h + l + c) / 3 - lo) / ((hi - lo) / 24)), 0), 23) AS INT) AS bin, CAST(sum(v) AS BIGINT) AS v FROM bars b JOIN s ON b.symbol = s.symbol GROUP BY ALL), "
    "g AS (SELECT s.symbol, lo, hi, CAST(bin AS INT) AS bin FROM s, range(24) x(bin)), j AS (SELECT g.*, coalesce(f.v, 0) AS v FROM g LEFT JOIN f ON g.symbol = f.symbol AND g.bin = f.bin), k AS (SELECT *, max(v) OVER w AS mx, sum(v) OVER w AS sm, avg(v) OVER w AS mean FROM j WINDOW w AS (PARTITION BY symbol))"
)


@query(_PROFILE + " SELECT symbol, bin, round(lo + bin * ((hi - lo) / 24), 6) AS low, v, round(100 * v / sm, 6) AS share_pct, bin = min(CASE WHEN v = mx THEN bin END) OVER (PARTITION BY symbol) AS is_poc FROM k")
def volume_profile(spark, d):
    return L.volume_profile(hours(spark, d)).select("symbol", "bin", r("low"), "v", r("share_pct"), "is_poc")


@query(
    _PROFILE + ", n AS (SELECT *, CASE WHEN v >= 1.5 * mean THEN 'HVN' WHEN v > 0 AND v <= 0.5 * mean THEN 'LVN' END AS kind FROM k), q AS (SELECT *, bin - row_number() OVER (PARTITION BY symbol, kind ORDER BY bin) AS run FROM n WHERE kind IS NOT NULL) "
    "SELECT symbol, kind, min(bin) AS first_bin, max(bin) AS last_bin, CAST(sum(v) AS BIGINT) AS v FROM q GROUP BY symbol, kind, run"
)
def profile_nodes(spark, d):
    return L.profile_nodes(L.volume_profile(hours(spark, d)))


@query(
    f"WITH {HOURS}, a AS (SELECT *, count(*) OVER w = 5 AND h = max(h) OVER w AS swing_high, count(*) OVER w = 5 AND l = min(l) OVER w AS swing_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, swing_high, swing_low FROM a WHERE swing_high OR swing_low"
)
def swing_points(spark, d):
    return L.swings(hours(spark, d)).select("symbol", text("t"), "swing_high", "swing_low")


@query(
    f"WITH {QUARTERS}, a AS (SELECT *, row_number() OVER w AS i, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lead(h) OVER w AS nh, lead(l) OVER w AS nl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), g AS (SELECT symbol, t, i, CASE WHEN nl > ph THEN 'bullish' ELSE 'bearish' END AS kind, round(CASE WHEN nl > ph THEN ph ELSE nh END, 4) AS bottom, round(CASE WHEN nl > ph THEN nl ELSE pl END, 4) AS top FROM a WHERE nl > ph OR nh < pl), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM g) "
    f"SELECT symbol, {TEXT.format('t')} AS t, kind, bottom, top, EXISTS (SELECT 1 FROM a b WHERE b.symbol = n.symbol AND b.i >= n.i + 2 AND b.l <= n.top AND b.h >= n.bottom) AS filled FROM n WHERE n <= 6"
)
def fair_value_gaps(spark, d):
    return L.filled_gaps(B.rollup(V.trades(spark, d), 15)).select("symbol", text("t"), "kind", "bottom", "top", "filled")


@query(
    f"WITH {HOURS}, g AS (SELECT symbol, max(h) AS h, min(l) AS l, arg_max(c, t) AS c FROM bars GROUP BY symbol) "
    "SELECT symbol, (h + l) / 2 AS equilibrium, c, CASE WHEN h <= l THEN NULL WHEN (c - l) / (h - l) < 0.45 THEN 'discount' WHEN (c - l) / (h - l) > 0.55 THEN 'premium' ELSE 'equilibrium' END AS zone, "
    "CASE WHEN h > l THEN c BETWEEN round(h - 0.79 * (h - l), 4) AND round(h - 0.618 * (h - l), 4) END AS in_retracement FROM g"
)
def premium_discount(spark, d):
    return L.premium_discount(hours(spark, d))


@query(
    f"WITH {QUARTERS}, m AS (SELECT symbol, median(v) AS base FROM bars WHERE v > 0 GROUP BY symbol), a AS (SELECT *, coalesce(lag(c, 5) OVER w, first(c) OVER w) AS pa, coalesce(lead(c, 5) OVER w, last(c) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pz FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) "
    f"SELECT a.symbol, {TEXT.format('t')} AS t, v, base, CASE WHEN (pz / pa - 1) * 10000 > 8 THEN 'demand' WHEN (pz / pa - 1) * 10000 < -8 THEN 'supply' ELSE 'unsure' END AS kind FROM a JOIN m ON a.symbol = m.symbol WHERE v >= 3 * base"
)
def volume_spikes(spark, d):
    return L.volume_spikes(B.rollup(V.trades(spark, d), 15)).select("symbol", text("t"), "v", "base", "kind")


@query(
    f"WITH {DAYS}, a AS (SELECT *, max(t) OVER (PARTITION BY symbol) AS z FROM bars), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM a WHERE t < z AND v > 0) "
    "SELECT symbol, count(*) AS days, round(CASE WHEN count(*) < 5 THEN max(CASE WHEN n = 1 THEN v END) ELSE avg(v) END, 6) AS adv FROM b WHERE n <= 20 GROUP BY symbol"
)
def average_daily_volume(spark, d):
    return B.average_daily_volume(days(spark, d)).select("symbol", "days", r("adv"))


_NEWS = "news AS (SELECT event_id AS id, event_type AS symbol, ts AS created_at FROM events)"


@query(f"WITH {HOURS}, {_NEWS} SELECT n.id, n.symbol, {TEXT.format('coalesce(b.t, f.t)')} AS t, coalesce(b.c, f.c) AS c FROM news n ASOF LEFT JOIN bars b ON n.symbol = b.symbol AND n.created_at >= b.t LEFT JOIN (SELECT symbol, min(t) AS t, arg_min(c, t) AS c FROM bars GROUP BY symbol) f ON f.symbol = n.symbol")
def news_to_bar(spark, d):
    return J.asof_backward(V.news(spark, d), hours(spark, d), "symbol", "created_at", "t", ["c"], clip=True).select("id", "symbol", text("t"), "c")


@query(f"WITH {QUARTERS}, {_NEWS}, m AS (SELECT symbol, median(v) AS base FROM bars WHERE v > 0 GROUP BY symbol), s AS (SELECT b.symbol, b.t FROM bars b JOIN m ON b.symbol = m.symbol WHERE v >= 3 * base) SELECT s.symbol, {TEXT.format('s.t')} AS t, n.id FROM s JOIN news n ON s.symbol = n.symbol AND abs(epoch_us(s.t) - epoch_us(n.created_at)) <= 900000000")
def spike_news(spark, d):
    spikes = L.volume_spikes(B.rollup(V.trades(spark, d), 15)).select("symbol", "t")
    return J.within(spikes, V.news(spark, d), "symbol", "t", "created_at", 900).select("symbol", text("t"), "id")


@query(f"WITH {TRADES} SELECT symbol, {TEXT.format("time_bucket(INTERVAL 1 hour, t)")} AS t, round(quantile_cont(p, 0.2), 6) AS p20, round(quantile_cont(p, 0.8), 6) AS p80 FROM trades GROUP BY symbol, time_bucket(INTERVAL 1 hour, t)")
def trade_percentiles(spark, d):
    binned = J.in_bins(V.trades(spark, d), hours(spark, d), 60)
    return binned.groupBy("symbol", F.col("bar_t").alias("t")).agg(F.percentile("p", 0.2).alias("p20"), F.percentile("p", 0.8).alias("p80")).select("symbol", text("t"), r("p20"), r("p80"))


@query(f"WITH {HOURS} SELECT symbol, {TEXT.format('t')} AS t, c, hour(t) % 2 = 0 AS held FROM bars")
def merge_missing(spark, d):
    x = hours(spark, d).select("symbol", "t", "c")
    even = F.hour("t") % 2 == 0
    merged = B.merge_missing(x.where(even).withColumn("held", F.lit(True)), x.withColumn("held", F.lit(False)))
    return merged.select("symbol", text("t"), "c", "held")


@query("SELECT firm, strftime(date, '%Y-%m-%d') AS date, target, id, carried FROM (SELECT o_orderpriority AS firm, max(o_orderdate) AS date, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS target, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, true AS carried FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_orderpriority UNION ALL SELECT o_orderpriority, o_orderdate, o_totalprice, o_orderkey, false FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def carried_targets(spark, d):
    return J.carried_in(V.targets(spark, d), "1998-01-01 00:00:00").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"WITH {TRADES}, g AS (SELECT symbol, CAST(d AS DATE) AS d FROM (SELECT DISTINCT symbol FROM trades), (SELECT unnest(generate_series(CAST(min(CAST(t AS DATE)) AS TIMESTAMP), CAST(max(CAST(t AS DATE)) AS TIMESTAMP), INTERVAL 1 day)) AS d FROM trades)), n AS (SELECT symbol, CAST(t AS DATE) AS d, count(*) AS n FROM trades GROUP BY ALL) SELECT g.symbol, strftime(g.d, '%Y-%m-%d') AS d, coalesce(n, 0) AS n, isodow(g.d) < 6 AS is_weekday FROM g LEFT JOIN n ON g.symbol = n.symbol AND g.d = n.d")
def coverage_grid(spark, d):
    return J.coverage(V.trades(spark, d)).withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query(f"WITH {LEDGER}, x AS (SELECT a.account, a.symbol, a.seq, a.price, (SELECT min(b.seq) FROM ledger b WHERE b.account = a.account AND b.symbol = a.symbol AND b.seq > a.seq AND b.action = 'sell') AS exit_seq FROM ledger a WHERE a.action = 'buy') SELECT x.*, l.price AS exit_price FROM x LEFT JOIN ledger l ON l.account = x.account AND l.symbol = x.symbol AND l.seq = x.exit_seq")
def first_exit(spark, d):
    return J.first_after(V.ledger(spark, d))


@query(f"WITH {CHAIN} SELECT symbol, arg_max(strike, (call_oi, -strike)) AS call_wall, arg_max(strike, (put_oi, -strike)) AS put_wall, CAST(sum(call_oi) AS BIGINT) AS call_oi, CAST(sum(put_oi) AS BIGINT) AS put_oi FROM chain GROUP BY symbol")
def option_walls(spark, d):
    return O.walls(V.chain(spark, d))


_GEX = f"WITH {CHAIN}, a AS (SELECT *, iv * sqrt(30 / 365.0) AS root, (ln(25.0 / strike) + (0.045 + iv * iv / 2) * (30 / 365.0)) / (iv * sqrt(30 / 365.0)) AS d1 FROM chain), b AS (SELECT symbol, strike, exp(-(d1 * d1) / 2) / sqrt(2 * pi()) / (25.0 * root) AS gamma, exp(-(d1 * d1) / 2) / sqrt(2 * pi()) / (25.0 * root) * (call_oi - put_oi) * 100 * 25.0 * 25.0 * 0.01 AS net_gamma FROM a)"


@query(_GEX + " SELECT symbol, strike, round(gamma, 6) AS gamma, round(net_gamma, 3) + 0.0 AS net_gamma FROM b")
def gamma_exposure(spark, d):
    return O.gamma_exposure(V.chain(spark, d), 25.0).select("symbol", "strike", r("gamma"), (F.round("net_gamma", 3) + 0.0).alias("net_gamma"))


@query(_GEX + ", e AS (SELECT *, sum(net_gamma) OVER (PARTITION BY symbol ORDER BY strike ROWS UNBOUNDED PRECEDING) AS cum FROM b), f AS (SELECT *, lag(cum) OVER w AS pc, lag(strike) OVER w AS ps FROM e WINDOW w AS (PARTITION BY symbol ORDER BY strike)) SELECT symbol, round(arg_min(ps + (strike - ps) * (-pc) / (cum - pc), strike), 5) AS flip FROM f WHERE pc < 0 AND cum >= 0 GROUP BY symbol")
def gamma_flip(spark, d):
    return O.gamma_flip(O.gamma_exposure(V.chain(spark, d), 25.0)).select("symbol", r("flip", 5))


@query(
    f"WITH {HOURS}, {LEDGER}, p AS (SELECT DISTINCT symbol, ts, sum(CASE WHEN action = 'buy' THEN 1 ELSE -1 END) OVER w AS position, 1000.0 - sum(CASE WHEN action = 'buy' THEN price ELSE -price END + 1.15) OVER w AS cash FROM ledger WINDOW w AS (PARTITION BY symbol ORDER BY ts)) "
    f"SELECT b.symbol, {TEXT.format('b.t')} AS t, round(coalesce(cash, 1000.0) + coalesce(position, 0) * c, 6) AS equity FROM bars b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.t >= p.ts"
)
def equity_curve(spark, d):
    return P.equity_curve(hours(spark, d), V.ledger(spark, d)).select("symbol", text("t"), r("equity"))


@query(f"WITH {HOURS}, a AS (SELECT symbol, c / min(c) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS x FROM bars WHERE c > 0) SELECT symbol, round(greatest(max(x) * 100, 0), 4) AS best_pct FROM a GROUP BY symbol")
def best_round_trip(spark, d):
    return P.best_round_trip(hours(spark, d)).select("symbol", r("best_pct", 4))


@query(f"WITH {HOURS}, g AS (SELECT symbol, arg_min(t, (c, t)) AS a, arg_min(t, (-c, t)) AS z, min(c) AS mn, max(c) AS mx FROM bars GROUP BY symbol) SELECT b.symbol, max(mn) AS min, max(mx) AS max, max(CASE WHEN t >= a THEN c END) AS max_after_min, min(CASE WHEN t <= z THEN c END) AS min_before_max FROM bars b JOIN g ON b.symbol = g.symbol GROUP BY b.symbol")
def ordered_extremes(spark, d):
    return P.ordered_extremes(hours(spark, d))


@query(f"WITH {LEDGER} SELECT symbol, count(*) AS trades, count(*) FILTER (action = 'buy') AS buys, count(*) FILTER (action = 'sell') AS sells, CAST(round(count(*) * 1.15, 6) AS DOUBLE) AS fees, round(sum(CASE WHEN action = 'sell' THEN price ELSE -price END), 4) AS cash_flow FROM ledger GROUP BY symbol")
def ledger_summary(spark, d):
    return P.summary(V.ledger(spark, d)).withColumns({"fees": F.round("fees", 6), "cash_flow": F.round("cash_flow", 4)})


_CLOCK = "CASE WHEN isodow(e) > 5 OR m < 570 OR m >= 960 THEN 'outside_regular_hours' WHEN m < 660 THEN 'opening_window' WHEN m >= 720 AND m < 840 THEN 'midday_dead_zone' WHEN m >= 900 THEN 'power_hour' ELSE 'other_session_hours' END"


@query(f"WITH {TRADES}, a AS (SELECT symbol, timezone('America/New_York', timezone('UTC', t)) AS e, hour(timezone('America/New_York', timezone('UTC', t))) * 60 + minute(timezone('America/New_York', timezone('UTC', t))) AS m, s FROM trades) SELECT symbol, {_CLOCK} AS clock, count(*) AS n, CAST(sum(s) AS BIGINT) AS shares FROM a GROUP BY ALL")
def session_clock(spark, d):
    return V.trades(spark, d).groupBy("symbol", session_window(F.col("t")).alias("clock")).agg(F.count("*").alias("n"), F.sum("s").alias("shares"))


@query(f"WITH {HOURS}, a AS (SELECT *, lag(c) OVER w AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), b AS (SELECT symbol, t, CASE WHEN c > p THEN 'up' WHEN c < p THEN 'down' END AS side, row_number() OVER w AS n, lag(CASE WHEN c > p THEN 'up' WHEN c < p THEN 'down' END) OVER w AS q FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, {TEXT.format('t')} AS t, side FROM b WHERE n = 1 OR side IS DISTINCT FROM q")
def direction_changes(spark, d):
    x = hours(spark, d).withColumn("_b", F.lag("c").over(I.by()))
    x = x.select("symbol", "t", F.when(F.col("c") > F.col("_b"), "up").when(F.col("c") < F.col("_b"), "down").alias("side"))
    return R.changes(x, "side").select("symbol", text("t"), "side")


@query(f"WITH {HOURS}, a AS (SELECT symbol, t, c > o AS ok, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM bars), b AS (SELECT *, n - row_number() OVER (PARTITION BY symbol ORDER BY t) AS run FROM a WHERE ok) SELECT symbol, {TEXT.format('min(t)')} AS start, {TEXT.format('max(t)')} AS \"end\", count(*) AS n FROM b GROUP BY symbol, run")
def held_rises(spark, d):
    return R.held(hours(spark, d), F.col("c") > F.col("o")).select("symbol", text("start"), text("end"), "n")


@query(f"WITH {HOURS}, a AS (SELECT symbol, t, c, max(c) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS high FROM bars) SELECT symbol, {TEXT.format('t')} AS t, c, high, round(high * (1 - 5 / 100.0), 6) AS stop, c <= high * (1 - 5 / 100.0) AS hit FROM a")
def trailing_stop(spark, d):
    return R.trailing_stop(hours(spark, d)).select("symbol", text("t"), "c", "high", r("stop"), "hit")


@query(f"WITH {HOURS}, m AS (SELECT symbol, avg(c) AS a, avg(v) AS b FROM bars GROUP BY symbol), k AS (SELECT symbol || '-c' AS alert_id, symbol, 'c' AS field, round(a * 1.5, 3) AS x FROM m UNION ALL SELECT symbol || '-v', symbol, 'v', round(b * 2, 3) FROM m), u AS (SELECT symbol, t, 'c' AS field, c AS value FROM bars UNION ALL SELECT symbol, t, 'v', CAST(v AS DOUBLE) FROM bars), z AS (SELECT alert_id, k.symbol, k.field, t, value, row_number() OVER (PARTITION BY k.field ORDER BY t, alert_id) AS n FROM u JOIN k ON u.symbol = k.symbol AND u.field = k.field WHERE value >= x) SELECT alert_id, symbol, field, {TEXT.format('t')} AS fired_at, value FROM z WHERE n = 1")
def alerts(spark, d):
    x = hours(spark, d).select("symbol", "t", "c", F.col("v").cast("double").alias("v"))
    m = x.groupBy("symbol").agg(F.round(F.avg("c") * 1.5, 3).alias("c"), F.round(F.avg("v") * 2, 3).alias("v")).unpivot(["symbol"], ["c", "v"], "field", "threshold")
    return R.fire(x, m.withColumns({"alert_id": F.concat_ws("-", "symbol", "field"), "condition": F.lit("above"), "set": F.col("field")}), ("set",)).select("alert_id", "symbol", "field", text("fired_at"), "value")


@query(
    f"WITH {HOURS}, a AS (SELECT *, avg(c) OVER (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING) AS x, avg(c) OVER (PARTITION BY symbol ORDER BY t ROWS 49 PRECEDING) AS y, avg(c) OVER (PARTITION BY symbol ORDER BY t ROWS 199 PRECEDING) AS z, first(c) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS f, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n, count(*) OVER (PARTITION BY symbol) AS k FROM bars), "
    "s AS (SELECT *, CAST(CASE WHEN k >= 20 THEN sign(c - x) ELSE 0 END + CASE WHEN k >= 50 THEN sign(x - y) ELSE 0 END + CASE WHEN k >= 200 THEN sign(c - z) ELSE 0 END + CASE WHEN c / f - 1 > 0.01 THEN 1 WHEN c / f - 1 < -0.01 THEN -1 ELSE 0 END AS INT) AS score FROM a WHERE n = 1) "
    "SELECT symbol, c, round((c / f - 1) * 100, 4) AS pct_change, score, CASE WHEN score >= 2 THEN 'bullish' WHEN score <= -2 THEN 'bearish' ELSE 'neutral' END AS trend, CASE WHEN abs(score) >= 3 THEN 'strong' WHEN abs(score) = 2 THEN 'moderate' ELSE 'weak' END AS strength FROM s"
)
def market_trend(spark, d):
    return I.trend(hours(spark, d)).select("symbol", "c", r("pct_change", 4), "score", "trend", "strength")


_BACK = f"WITH {HOURS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS back FROM bars)"


@query(
    f"WITH {DAYS}, a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS total, max(h) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sh, min(l) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sl, max(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ih, min(l) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS il FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), "
    "k AS (SELECT *, CASE WHEN c < o AND ih > sh THEN 'bullish' WHEN c > o AND il < sl THEN 'bearish' END AS kind, round(l, 4) AS bottom, round(h, 4) AS top FROM a WHERE i > 5 AND i <= total - 3), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM k WHERE kind IS NOT NULL) "
    f"SELECT symbol, {TEXT.format('t')} AS t, kind, bottom, top, EXISTS (SELECT 1 FROM a b WHERE b.symbol = n.symbol AND b.i >= n.i + 4 AND b.l <= n.top AND b.h >= n.bottom) AS mitigated FROM n WHERE n <= 6"
)
def order_blocks(spark, d):
    return S.order_blocks(days(spark, d)).select("symbol", text("t"), "kind", "bottom", "top", "mitigated")


@query(_BACK + ", g AS (SELECT symbol, max(CASE WHEN back <= 5 THEN h END) AS recent_high, max(CASE WHEN back > 5 THEN h END) AS prior_high, max(CASE WHEN back = 1 THEN c END) AS c FROM a WHERE back <= 10 GROUP BY symbol) SELECT *, recent_high > prior_high AND c > prior_high AS broken FROM g")
def break_of_structure(spark, d):
    return S.break_of_structure(hours(spark, d))


@query(
    _BACK + ", g AS (SELECT symbol, max(CASE WHEN back <= 10 THEN h END) AS nh, min(CASE WHEN back <= 10 THEN l END) AS nl, max(CASE WHEN back > 10 THEN h END) AS oh, min(CASE WHEN back > 10 THEN l END) AS ol, avg(CASE WHEN back <= 10 THEN v END) / nullif(avg(CASE WHEN back > 10 THEN v END), 0) AS rv FROM a WHERE back <= 20 GROUP BY symbol) "
    "SELECT symbol, CASE WHEN nh > oh AND nl > ol THEN 'higher highs and lows' WHEN nh < oh AND nl < ol THEN 'lower highs and lows' ELSE 'mixed' END AS pattern, round(rv, 6) AS relative_volume FROM g"
)
def momentum_pattern(spark, d):
    return S.momentum(hours(spark, d)).select("symbol", "pattern", r("relative_volume"))


@query(
    _BACK + ", e AS (SELECT *, max(CASE WHEN back <= 10 THEN h END) OVER w AS top, min(CASE WHEN back <= 10 THEN l END) OVER w AS low, max(CASE WHEN back = 1 THEN c END) OVER w AS z FROM a WHERE back <= 30 WINDOW w AS (PARTITION BY symbol)), "
    "g AS (SELECT symbol, any_value(top) AS base_high, any_value(low) AS base_low, any_value(top) - any_value(low) AS base, any_value(z) AS z, max(CASE WHEN back > 10 THEN h END) - min(CASE WHEN back > 10 THEN l END) AS prior, avg(CASE WHEN back <= 10 THEN v END) AS nv, avg(CASE WHEN back > 10 THEN v END) AS ov, "
    "count(*) FILTER (back <= 10 AND top - h <= greatest((top - low) * 0.15, z * 0.001)) AS touches_high, count(*) FILTER (back <= 10 AND l - low <= greatest((top - low) * 0.15, z * 0.001)) AS touches_low FROM e GROUP BY symbol HAVING count(*) >= 15), "
    "f AS (SELECT *, CASE WHEN prior > 0 THEN (prior - base) / prior * 100 ELSE 0 END AS pct, CASE WHEN coalesce(ov, 0) = 0 THEN 'unknown' WHEN nv < ov * 0.9 THEN 'declining' WHEN nv > ov * 1.1 THEN 'rising' ELSE 'flat' END AS volume FROM g) "
    "SELECT symbol, base_high, base_low, base, round(CASE WHEN z <> 0 THEN base / z * 100 ELSE 0 END, 6) AS height_pct, prior, round(pct, 6) AS contraction_pct, volume, touches_high, touches_low, touches_high >= 2 OR touches_low >= 2 AS well_tested, pct > 10 AND volume IN ('declining', 'flat') AS coiling FROM f"
)
def consolidation(spark, d):
    got = S.consolidation(hours(spark, d))
    return got.withColumns({"height_pct": F.round("height_pct", 6), "contraction_pct": F.round("contraction_pct", 6)})



@query(
    f"WITH {HOURS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n, count(*) OVER w AS k, min(c) OVER w AS lo, max(c) OVER w AS hi FROM bars WINDOW w AS (PARTITION BY symbol)) "
    "SELECT symbol, CAST(least(greatest(ceil((c - lo) / ((hi - lo) / 50)) - 1, 0), 49) AS INT) AS price_bin, CAST(floor((n - 1) * 20 / k) AS INT) AS time_bucket, CAST(sum(v) AS BIGINT) AS v FROM a WHERE hi > lo GROUP BY ALL"
)
def price_time_histogram(spark, d):
    return S.price_time_histogram(hours(spark, d))


@query(
    f"WITH {DAYS}, a AS (SELECT *, date_diff('day', t, max(t) OVER (PARTITION BY symbol)) AS age FROM bars) SELECT symbol, "
    + ", ".join(f"round(sum(CASE WHEN age <= {n} THEN c * v END) / sum(CASE WHEN age <= {n} THEN v END), 6) AS line_{n}" for n in (7, 28, 365)) + " FROM a GROUP BY symbol"
)
def weighted_lines(spark, d):
    return S.weighted_lines(days(spark, d)).select("symbol", r("line_7"), r("line_28"), r("line_365"))


@query(
    f"WITH {DAYS}, a AS (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY t) AS top FROM bars), b AS (SELECT *, h - l AS risk, round(h + (h - c), 4) AS t1, round(h + 2 * (h - c), 4) AS t2 FROM a WHERE l > 0 AND l < h), "
    f"r AS (SELECT *, CASE WHEN h > c THEN {half_up('(t1 - h) / risk', 2)} END AS r1, CASE WHEN h > c THEN {half_up('(t2 - h) / risk', 2)} END AS r2, CASE WHEN h > o THEN round((round(h + (h - o), 4) - h) / risk, 2) END AS a1, CASE WHEN h > o THEN round((round(h + 2 * (h - o), 4) - h) / risk, 2) END AS a2, CASE WHEN top > h THEN {half_up('(top - h) / risk', 2)} END AS near FROM b) "
    f"SELECT symbol, {TEXT.format('t')} AS t, round(risk, 4) AS risk, r1 AS ratio1_base, r2 AS ratio2_base, a1 AS ratio1_atr, a2 AS ratio2_atr, greatest(r1, r2, a1, a2) AS best, coalesce(greatest(r1, r2, a1, a2) >= 2, false) AS meets, near AS ratio_at_resistance, CASE WHEN top > 0 THEN top <= h OR near >= 2 END AS room FROM r"
)
def breakout_plans(spark, d):
    """A breakout of each day's high with the stop at its low, the previous high as resistance."""
    x = days(spark, d).withColumn("top", F.lag("h").over(I.by()))
    x = x.withColumn("g", G.breakout_geometry(F.col("h"), F.col("l"), F.col("h") - F.col("c"), F.col("h") - F.col("o"), F.col("top"))).where("g is not null")
    return x.select("symbol", text("t"), *[f"g.{k}" for k in ("risk", "ratio1_base", "ratio2_base", "ratio1_atr", "ratio2_atr", "best", "meets", "ratio_at_resistance", "room")])


@query(
    f"WITH {HOURS}, a AS (SELECT symbol, t, c, (h + l + c) / 3 AS m, (h - l) / 4 AS sd FROM bars), b AS (SELECT *, CASE WHEN c < m THEN 'long' ELSE 'short' END AS side, CASE WHEN c < m THEN c - sd ELSE c + sd END AS stop FROM a WHERE c > 0 AND m > 0 AND sd > 0 AND c <> m) "
    f"SELECT symbol, {TEXT.format('t')} AS t, side, {half_up('stop', 4)} AS stop, {half_up('m', 4)} AS target, {half_up('abs(c - stop)', 4)} AS risk, {half_up('abs(m - c)', 4)} AS reward, {half_up('abs(m - c) / abs(c - stop)', 2)} AS ratio, abs(m - c) / abs(c - stop) >= 1.5 AS meets FROM b"
)
def reversion_plans(spark, d):
    """A return of each hour's close to its typical price, a quarter of the range as deviation."""
    x = hours(spark, d).withColumn("m", (F.col("h") + F.col("l") + F.col("c")) / 3).withColumn("side", F.when(F.col("c") < F.col("m"), "long").otherwise("short"))
    x = x.withColumn("g", G.reversion_geometry(F.col("c"), F.col("m"), (F.col("h") - F.col("l")) / 4, F.col("side"))).where("g is not null")
    return x.select("symbol", text("t"), "side", "g.*")


@query(
    f"WITH {HOURS}, b AS (SELECT * FROM bars WHERE l > 0 AND l < c AND c < h) "
    f"SELECT symbol, {TEXT.format('t')} AS t, {half_up('l', 4)} AS stop, {half_up('h', 4)} AS target, {half_up('c - l', 4)} AS risk, {half_up('h - c', 4)} AS reward, {half_up('(h - c) / (c - l)', 2)} AS ratio, (h - c) / (c - l) >= 3 AS meets FROM b"
)
def block_plans(spark, d):
    """A long entry at each hour's close, its low as stop and its high as target."""
    x = hours(spark, d).withColumn("g", G.block_geometry(F.col("c"), F.col("l"), F.col("h"))).where("g is not null")
    return x.select("symbol", text("t"), "g.*")


@query(
    f"WITH {DAYS}, a AS (SELECT symbol AS strategy, CASE WHEN c >= o THEN 'up' ELSE 'down' END AS regime, CASE WHEN v % 3 <> 0 THEN (c / nullif(o, 0) - 1) * 100 END AS return_pct, v % 2 AS active FROM bars) "
    "SELECT strategy, count(*) AS activations, count(*) FILTER (CASE WHEN return_pct IS NOT NULL THEN return_pct > 0 ELSE active > 0 END) AS effective, count(*) FILTER (active = 0) AS alert_only, round(avg(return_pct), 6) AS mean_return, "
    "string_agg(DISTINCT regime, ',' ORDER BY regime) AS regimes, round(count(*) FILTER (CASE WHEN return_pct IS NOT NULL THEN return_pct > 0 ELSE active > 0 END) / count(*), 6) AS hit_rate FROM a GROUP BY strategy"
)
def strategy_stats(spark, d):
    """Each day of a symbol as an activation; days whose volume is a multiple of three have no known return."""
    x = days(spark, d).select(
        F.col("symbol").alias("strategy"), F.when(F.col("c") >= F.col("o"), "up").otherwise("down").alias("regime"), F.when(F.col("v") % 3 != 0, (F.col("c") / F.nullif("o", F.lit(0.0)) - 1) * 100).alias("return_pct"), (F.col("v") % 2).alias("active")
    )
    return G.strategy_stats(x).select("strategy", "activations", "effective", "alert_only", r("mean_return"), F.concat_ws(",", "regimes").alias("regimes"), r("hit_rate"))



_NUMBERS = r"n AS (SELECT conv_id, turn, role, CAST(replace(x, ',', '') AS DOUBLE) AS x FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '-?\d+(?:,\d{3})*(?:\.\d+)?')) AS x FROM conversations) WHERE abs(CAST(replace(x, ',', '') AS DOUBLE)) >= 10)"


@query(f"WITH {_NUMBERS}, s AS (SELECT DISTINCT conv_id, turn, x FROM n WHERE role = 'assistant') SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM n b WHERE b.conv_id = s.conv_id AND b.turn < s.turn AND abs(b.x - s.x) <= greatest(0.01, abs(b.x) * 0.01)) THEN 1 ELSE 0 END) AS BIGINT) AS grounded FROM s GROUP BY conv_id")
def grounding(spark, d):
    return E.grounding(V.table(spark, d, "conversations"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, d):
    return V.table(spark, d, "pages").select("page_id", E.plain_text(F.col("html")).alias("text"))


@query()
def value_area(spark, d):
    return D.value_area(L.volume_profile(hours(spark, d)))


@query(
    f"WITH {DAYS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n, max(t) OVER (PARTITION BY symbol) AS z FROM bars), a AS (SELECT symbol, avg(v) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM n WHERE t < z AND v > 0) WHERE k <= 20 GROUP BY symbol HAVING count(*) >= 5), "
    "h AS (SELECT symbol, t AS tt, timezone('America/New_York', timezone('UTC', t)) AS e, CAST(sum(s) OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_volume FROM trades), m AS (SELECT *, hour(e) * 60 + minute(e) + second(e) / 60.0 - 570 AS m FROM h), "
    "c(a, x, b, y) AS (VALUES " + ", ".join(f"({p[0]}, {p[1]}, {q[0]}, {q[1]})" for p, q in zip(C.CURVE, C.CURVE[1:])) + "), "
    "f AS (SELECT m.*, CASE WHEN m < 0 THEN NULL WHEN m > 390 THEN 1.0 ELSE (SELECT min(x + (y - x) * (m - c.a) / (b - c.a)) FROM c WHERE m >= c.a AND m <= b) END AS share FROM m) "
    f"SELECT f.symbol, {TEXT.format('tt')} AS t, day_volume, round(day_volume / adv, 5) AS ratio, round(CASE WHEN share IS NOT NULL THEN day_volume / (adv * greatest(share, 0.01)) END, 5) AS pace FROM f JOIN a ON f.symbol = a.symbol"
)
def volume_pace(spark, d):
    trades = V.trades(spark, d)
    w = W.partitionBy("symbol", F.to_date("t")).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    adv = B.average_daily_volume(B.daily(trades)).where("days >= 5").select("symbol", "adv")
    return C.relative_pace(trades.select("symbol", "t", F.sum("s").over(w).alias("day_volume")), adv).select("symbol", text("t"), "day_volume", r("ratio", 5), r("pace", 5))


@query(
    f"WITH {HOURS}, k AS (SELECT symbol, min(t) AS armed_at, arg_min(c, t) AS entry, arg_min(c, t) * 0.9 AS armed, arg_min(c, t) * 3 AS target FROM bars GROUP BY symbol), h AS (SELECT b.symbol, t, c, entry, armed, target, max(c) OVER (PARTITION BY b.symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS high FROM bars b JOIN k ON b.symbol = k.symbol), "
    "s AS (SELECT *, CASE WHEN high >= 2 * entry - armed THEN round(armed + least(1.0, (high - entry) / (target - entry)) * (target - armed), 4) ELSE armed END AS stop FROM h) "
    f"SELECT symbol, {TEXT.format('t')} AS t, high, round(stop, 4) AS stop, c <= stop AS hit FROM s"
)
def ratchet_stop(spark, d):
    x = hours(spark, d)
    entry = F.min_by("c", "t")
    k = x.groupBy("symbol").agg(F.min("t").alias("armed_at"), entry.alias("entry"), (entry * 0.9).alias("armed"), (entry * 3).alias("target"))
    return R.ratchet_stop(x.select("symbol", "t", "c"), k).select("symbol", text("t"), "high", r("stop", 4), "hit")


@query(
    f"WITH {LEDGER}, w AS (SELECT account, action, ts AS started_at, lead(ts) OVER (PARTITION BY account ORDER BY seq) AS ended_at, seq FROM ledger), t AS (SELECT CAST(user_id AS VARCHAR) AS account, ts FROM events) "
    "SELECT w.account, w.seq, count(*) AS n FROM w JOIN t ON t.account = w.account AND t.ts >= w.started_at AND (w.ended_at IS NULL OR t.ts <= w.ended_at) WHERE w.action = 'buy' GROUP BY ALL"
)
def activation_events(spark, d):
    """Events of each account while it holds what it bought."""
    w = V.ledger(spark, d).withColumn("ended_at", F.lead("ts").over(W.partitionBy("account").orderBy("seq")))
    w = w.where("action = 'buy'").select("account", F.col("ts").alias("started_at"), "ended_at", "seq")
    events = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("account"), "ts")
    return G.in_windows(w, events, ["account"]).groupBy("account", "seq").agg(F.count("*").alias("n"))


@query("SELECT event_type AS symbol, count(*) AS n, count(*) FILTER (event_type IN ('purchase')) AS active, round(count(*) FILTER (event_type IN ('purchase')) / count(*), 6) AS active_rate, round((arg_max(value, ts) / nullif(arg_min(value, ts), 0) - 1) * 100, 4) AS return_pct FROM events GROUP BY event_type")
def decision_quality(spark, d):
    e = V.table(spark, d, "events")
    x = e.select("ts", F.col("event_type").alias("symbol"), F.when(F.col("event_type") == "purchase", "buy").otherwise("hold").alias("action"), F.lit("filled").alias("status"), "value")
    return G.decision_quality(x, ["symbol"]).select("symbol", "n", "active", r("active_rate"), r("return_pct", 4))


@query()
def momentum_legs(spark, d):
    return K.momentum_legs(hours(spark, d))


@query()
def liquidity_pools(spark, d):
    x = L.swings(hours(spark, d), 3)
    high = x.where("swing_high").select("symbol", F.lit("buy").alias("side"), F.col("h").alias("price"))
    return K.liquidity_pools(high.union(x.where("swing_low").select("symbol", F.lit("sell").alias("side"), F.col("l").alias("price"))))
