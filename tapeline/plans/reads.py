"""Registered queries of the composite reads and stateful rules, in the same style and dictionaries as the market queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions import clock as T
from tapeline.operators import bars as B
from tapeline.operators import folds as D
from tapeline.operators import joins as J
from tapeline.operators import levels as L
from tapeline.operators import reads as Q
from tapeline.operators import rules as R
from tapeline.operators import scans as N
from tapeline.plans.market import DAYS, HOURS, NY_DAY, QUARTERS, TEXT, TRADES, _BAR, days, half_up, hours, query, r, text
from tapeline.sources import views as V


def quarters(spark, d):
    return B.rollup(V.trades(spark, d), 15)


def _swings(k: int) -> str:
    return (
        f"a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, count(*) OVER x = {2 * k + 1} AND h = max(h) OVER x AS sh, count(*) OVER x = {2 * k + 1} AND l = min(l) OVER x AS sl FROM bars "
        f"WINDOW w AS (PARTITION BY symbol ORDER BY t), x AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))"
    )


@query(
    f"WITH {QUARTERS}, {_swings(3)}, e AS (SELECT * FROM a WHERE n >= 8 AND i > greatest(3, n - 40)), m AS (SELECT e.symbol, e.n, e.i, "
    "(SELECT arg_min(s.l, s.i) FROM a s WHERE s.symbol = e.symbol AND s.sl AND s.i < e.i AND e.l < s.l AND e.c > s.l) AS up, (SELECT arg_min(s.h, s.i) FROM a s WHERE s.symbol = e.symbol AND s.sh AND s.i < e.i AND e.h > s.h AND e.c < s.h) AS down FROM e), "
    "g AS (SELECT symbol, n, max(i) FILTER (up IS NOT NULL) AS iu, arg_max(up, i) FILTER (up IS NOT NULL) AS u, min(i) FILTER (down IS NOT NULL AND up IS NULL) AS id, arg_min(down, i) FILTER (down IS NOT NULL AND up IS NULL) AS w FROM m GROUP BY ALL) "
    "SELECT symbol, CASE WHEN iu IS NOT NULL THEN 'bullish' ELSE 'bearish' END AS type, round(coalesce(u, w), 4) AS level, n - coalesce(iu, id) AS bars_ago FROM g WHERE coalesce(iu, id) IS NOT NULL"
)
def liquidity_sweeps(spark, d):
    return Q.liquidity_sweeps(quarters(spark, d), recent_bars=40)


_CLUSTERS = (
    "tr AS (SELECT *, greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) AS tr FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t)), "
    "z AS (SELECT symbol, arg_max(c, t) AS spot, max(n) AS n, avg(tr) FILTER (n - i < least(14, n - 1)) AS atr FROM tr GROUP BY symbol), y AS (SELECT symbol, spot, n, CASE WHEN atr > 0 THEN 0.25 * atr ELSE spot * 0.001 END AS tol FROM z), "
    "q AS (SELECT symbol, h AS price, i FROM a WHERE sh UNION ALL SELECT symbol, l, i FROM a WHERE sl), p AS MATERIALIZED (SELECT q.*, y.spot, y.n, y.tol, row_number() OVER (PARTITION BY q.symbol ORDER BY price, i) AS k FROM q JOIN y ON q.symbol = y.symbol), "
    "f AS (SELECT symbol, k, price AS s, 1 AS touches, i AS latest, 1 AS cluster FROM p WHERE k = 1 UNION ALL SELECT p.symbol, p.k, CASE WHEN abs(p.price - f.s / f.touches) <= p.tol THEN f.s + p.price ELSE p.price END, CASE WHEN abs(p.price - f.s / f.touches) <= p.tol THEN f.touches + 1 ELSE 1 END, "
    "CASE WHEN abs(p.price - f.s / f.touches) <= p.tol THEN greatest(f.latest, p.i) ELSE p.i END, CASE WHEN abs(p.price - f.s / f.touches) <= p.tol THEN f.cluster ELSE f.cluster + 1 END FROM f JOIN p ON p.symbol = f.symbol AND p.k = f.k + 1), "
    "x AS (SELECT symbol, cluster, arg_max(s, k) / max(touches) AS level, max(touches) AS touches, arg_max(latest, k) AS latest FROM f GROUP BY ALL), "
    "v AS (SELECT x.symbol, level, touches, y.n - latest AS ago, y.spot FROM x JOIN y ON x.symbol = y.symbol), u AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, ago, level) AS rank FROM v)"
)


@query(
    f"WITH RECURSIVE {HOURS}, {_swings(3)}, {_CLUSTERS} "
    "SELECT symbol, round(level, 4) AS level, touches, ago AS last_test_bars_ago, CASE WHEN level > spot THEN 'resistance' ELSE 'support' END AS type, rank FROM u WHERE rank <= 6"
)
def swing_clusters(spark, d):
    return Q.swing_clusters(hours(spark, d))


_VOTE = "CASE WHEN vix < 17 THEN 2 WHEN vix < 20 THEN 1 WHEN vix < 26 THEN 0 WHEN vix < 35 THEN -2 WHEN vix IS NOT NULL THEN -3 ELSE 0 END"
_LABEL = "CASE WHEN vix < 13 THEN 'very low (complacent)' WHEN vix < 17 THEN 'low (calm)' WHEN vix < 20 THEN 'normal' WHEN vix < 26 THEN 'elevated' WHEN vix < 35 THEN 'high (fear)' ELSE 'extreme (panic)' END"


@query(
    "WITH x AS (SELECT o_orderpriority AS symbol, o_orderdate AS t, max(o_totalprice) / 15000 AS c FROM orders GROUP BY ALL), a AS (SELECT *, c - lag(c) OVER w AS d, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS back FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t)), "
    "g AS (SELECT symbol, count(*) AS n, max(c) FILTER (back = 1) AS c, max(c) FILTER (back = 6) AS c6, max(c) AS peak, avg(c) FILTER (back <= 50) AS m50, avg(c) FILTER (back <= 200) AS m200, avg(greatest(d, 0)) FILTER (back <= 14 AND d IS NOT NULL) AS gain, avg(greatest(-d, 0)) FILTER (back <= 14 AND d IS NOT NULL) AS loss FROM a GROUP BY symbol), "
    "o AS (SELECT f.c AS vix, (f.c / f.c6 - 1) * 100 AS chg, m.c AS vix3m, s.c AS spy, (s.c / s.peak - 1) * 100 AS dd, CASE WHEN s.n >= 50 THEN s.m50 END AS m50, CASE WHEN s.n >= 200 THEN s.m200 END AS m200, CASE WHEN s.loss = 0 THEN 100 ELSE 100 - 100 / (1 + s.gain / s.loss) END AS rsi FROM g f, g m, g s WHERE f.symbol = '1-URGENT' AND m.symbol = '2-HIGH' AND s.symbol = '3-MEDIUM'), "
    f"p AS (SELECT *, {_VOTE} + CASE WHEN chg > 10 THEN -1 WHEN chg < -10 THEN 1 ELSE 0 END + CASE WHEN vix3m < vix THEN -2 ELSE 0 END + CASE WHEN m200 IS NULL THEN 0 WHEN spy >= m200 THEN 1 ELSE -1 END + CASE WHEN m50 IS NULL THEN 0 WHEN spy >= m50 THEN 1 ELSE -1 END + CASE WHEN dd <= -20 THEN -2 WHEN dd <= -10 THEN -1 ELSE 0 END AS score FROM o) "
    f"SELECT CASE WHEN score >= 3 THEN 'risk-on' WHEN score <= -3 THEN 'risk-off' ELSE 'neutral / mixed' END AS risk_environment, score AS risk_score, round(vix, 6) AS vix, {_LABEL} AS vix_label, round(chg, 6) AS vix_change_pct, round(vix3m, 6) AS vix3m, CASE WHEN vix3m < vix THEN 'backwardation' ELSE 'contango' END AS term_structure, "
    "round(spy, 6) AS index_close, round(dd, 6) AS drawdown_pct, CASE WHEN m50 >= m200 THEN 'golden' WHEN m50 < m200 THEN 'death' END AS ma_cross, round(rsi, 5) AS rsi, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' END AS rsi_state FROM p"
)
def market_regime(spark, d):
    """Each order date's largest order of a priority as a close: urgent ones as volatility, high ones as its sister, medium ones as the index."""
    closes = V.targets(spark, d).groupBy(F.col("firm").alias("symbol"), F.col("date").alias("t")).agg((F.max("target") / 15000).alias("c"))
    got = Q.market_regime(closes, "1-URGENT", "2-HIGH", "3-MEDIUM")
    return got.withColumns({c: F.round(c, 5 if c == "rsi" else 6) for c in ("vix", "vix_change_pct", "vix3m", "index_close", "drawdown_pct", "rsi")})


@query(
    f"WITH {QUARTERS}, z AS (SELECT *, max(CAST(t AS DATE)) OVER (PARTITION BY symbol) AS z FROM bars), g AS (SELECT symbol, z AS day, arg_min(o, t) AS o, max(h) AS h, min(l) AS l FROM z WHERE CAST(t AS DATE) = z GROUP BY ALL), "
    f"y AS ({_BAR.format(t=NY_DAY)}) SELECT g.symbol, strftime(day, '%Y-%m-%d') AS day, coalesce(y.o, g.o) AS o, coalesce(y.h, g.h) AS h, coalesce(y.l, g.l) AS l, y.o IS NOT NULL AS from_daily FROM g LEFT JOIN y ON y.symbol = g.symbol AND CAST(y.t AS DATE) = g.day AND y.symbol <> 'purchase'"
)
def todays_range(spark, d):
    """No daily bars of one symbol, which falls back to its intraday bars."""
    got = Q.todays_range(days(spark, d).where("symbol <> 'purchase'"), quarters(spark, d))
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    f"WITH {QUARTERS}, e AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS e FROM bars), k AS (SELECT *, h - l AS size, abs(c - o) AS body, least(o, c) - l AS low, h - greatest(o, c) AS high FROM e WHERE hour(e) * 60 + minute(e) >= 570 AND hour(e) * 60 + minute(e) < 960), "
    "x AS (SELECT *, CASE WHEN size > 0 AND low >= size * 0.5 AND low > body AND high < low THEN 'bullish_rejection' WHEN size > 0 AND high >= size * 0.5 AND high > body AND low < high THEN 'bearish_rejection' END AS candle FROM k) "
    f"SELECT symbol, strftime(e, '%Y-%m-%d') AS day, {TEXT.format('t')} AS t, candle FROM x WHERE candle IS NOT NULL"
)
def rejection_candles(spark, d):
    x = Q.regular_session(quarters(spark, d)).withColumn("candle", Q.rejection(*map(F.col, "ohlc")))
    return x.where("candle is not null").select("symbol", "day", text("t"), "candle")


@query(f"WITH {QUARTERS}, z AS (SELECT *, max(t) OVER (PARTITION BY symbol) AS z FROM bars), g AS (SELECT symbol, arg_max(c, t) AS c, coalesce(arg_max(c, t) FILTER (t <= z - INTERVAL 60 minute), arg_min(c, t)) AS base FROM z GROUP BY symbol) SELECT symbol, c, base, round((c / nullif(base, 0) - 1) * 100, 6) AS momentum_pct FROM g")
def momentum_pct(spark, d):
    return Q.momentum_pct(quarters(spark, d), 60).select("symbol", "c", "base", r("momentum_pct"))


_NMS = "k AS MATERIALIZED (SELECT {keys}, i, v, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, i) AS k FROM {src}), f AS (SELECT {keys}, k, [i] AS chosen FROM k WHERE k = 1 UNION ALL SELECT {pkeys}, p.k, CASE WHEN len(list_filter(f.chosen, lambda x: abs(x - p.i) <= {width})) = 0 THEN list_append(f.chosen, p.i) ELSE f.chosen END FROM f JOIN k p ON {on} AND p.k = f.k + 1), y AS (SELECT {keys}, unnest(arg_max(chosen, k)) AS i FROM f GROUP BY {keys})"


@query(
    f"WITH RECURSIVE {QUARTERS}, e AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS e FROM bars), s AS (SELECT *, strftime(e, '%Y-%m-%d') AS day, hour(e) * 60 + minute(e) AS m FROM e WHERE hour(e) * 60 + minute(e) >= 570 AND hour(e) * 60 + minute(e) < 960), "
    "n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, day) AS n, coalesce(lag(c, 2) OVER w, first(c) OVER w) AS pa, coalesce(lead(c, 2) OVER w, last(c) OVER (PARTITION BY symbol, day ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pz FROM s WINDOW w AS (PARTITION BY symbol, day ORDER BY t)), "
    "b AS (SELECT *, median(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY symbol, day) AS base FROM n WHERE n >= 7 AND m >= 573), cand AS (SELECT *, CASE WHEN pa = 0 THEN 0 ELSE (c - pa) / pa * 10000 END AS pre, CASE WHEN c = 0 THEN 0 ELSE (pz - c) / c * 10000 END AS post FROM b WHERE base > 0 AND v >= 1.5 * base), "
    + _NMS.format(keys="symbol, day", pkeys="p.symbol, p.day", src="cand", width=2, on="p.symbol = f.symbol AND p.day = f.day")
    + f" SELECT cand.symbol, cand.day, {TEXT.format('cand.t')} AS t, {half_up('(h + l + c) / 3', 4)} AS price, {half_up('v / base', 2)} AS rel_vol, v, CASE WHEN pre > 8 AND post <= 8 THEN 'supply' WHEN pre < -8 AND post >= -8 THEN 'demand' ELSE 'unsure' END AS type FROM cand JOIN y ON cand.symbol = y.symbol AND cand.day = y.day AND cand.i = y.i"
)
def session_spikes(spark, d):
    return Q.session_spikes(quarters(spark, d), warmup=3, times=1.5, width=2).select("symbol", "day", text("t"), "price", "rel_vol", "v", "type")


@query(
    f"WITH RECURSIVE {HOURS}, a AS (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars), c AS (SELECT * FROM a WHERE v > 0), "
    + _NMS.format(keys="symbol", pkeys="p.symbol", src="c", width=5, on="p.symbol = f.symbol") + " SELECT c.symbol, c.i, c.v FROM c JOIN y ON c.symbol = y.symbol AND c.i = y.i"
)
def suppressed_spikes(spark, d):
    x = hours(spark, d).select("symbol", F.row_number().over(W.partitionBy("symbol").orderBy("t")).alias("i"), "v")
    return D.suppress_neighbours(x.where("v > 0"))


@query(
    "WITH x AS (SELECT unnest(['urgent', 'High', 'low', 'none']) AS firm) SELECT x.firm, strftime(max(o_orderdate), '%Y-%m-%d') AS date, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS target, round((arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 200000.0 - 1) * 100, 1) AS upside_pct "
    "FROM orders JOIN x ON contains(lower(o_orderpriority), lower(x.firm)) GROUP BY x.firm"
)
def analyst_targets(spark, d):
    return Q.standing_targets(V.targets(spark, d), ["urgent", "High", "low", "none"], 200000.0).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    f"WITH {DAYS}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n, lag(h) OVER o AS ph, lag(l) OVER o AS pl, lag(c) OVER o AS pc FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY t)), p AS (SELECT symbol, c, ph AS hh, pl AS ll, (ph + pl + pc) / 3 AS p FROM w WHERE n = 1 AND pc IS NOT NULL), "
    "u AS (SELECT symbol, c, unnest(['P', 'R1', 'S1', 'R2', 'S2', 'R3', 'S3']) AS level, unnest([p, 2 * p - ll, 2 * p - hh, p + (hh - ll), p - (hh - ll), hh + 2 * (p - ll), ll - 2 * (hh - p)]) AS price FROM p), s AS (SELECT *, CASE WHEN price > c THEN 'resistance' ELSE 'support' END AS side FROM u WHERE price <> c) "
    "SELECT symbol, level, round(price, 6) AS price, side, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(price - c), level) AS rank FROM s"
)
def pivots_around_close(spark, d):
    last = days(spark, d).groupBy("symbol").agg(F.max("t").alias("t"), F.max_by("c", "t").alias("c"))
    pivots = L.floor_pivots(days(spark, d)).join(last.select("symbol", "t"), ["symbol", "t"], "left_semi")
    return Q.levels_around(pivots, last).withColumn("price", F.round("price", 6))


@query(
    f"WITH {HOURS}, m AS (SELECT symbol, t, id FROM trades WHERE symbol = 'purchase'), a AS (SELECT m.*, b.t AS bt, b.c AS bc FROM m ASOF LEFT JOIN bars b ON m.symbol = b.symbol AND m.t >= b.t), z AS (SELECT a.*, f.t AS ft, f.c AS fc FROM a ASOF LEFT JOIN bars f ON a.symbol = f.symbol AND a.t <= f.t) "
    f"SELECT id, {TEXT.format('CASE WHEN bt IS NULL OR (ft IS NOT NULL AND epoch_us(ft) - epoch_us(t) < epoch_us(t) - epoch_us(bt)) THEN ft ELSE bt END')} AS t, CASE WHEN bt IS NULL OR (ft IS NOT NULL AND epoch_us(ft) - epoch_us(t) < epoch_us(t) - epoch_us(bt)) THEN fc ELSE bc END AS c FROM z"
)
def markers_on_curve(spark, d):
    """Each purchase on the nearest point of the hourly closes."""
    marks = V.trades(spark, d).where("symbol = 'purchase'").select("symbol", F.col("t").alias("at"), "id")
    return J.nearest(marks, hours(spark, d), "symbol", "at", "t", ["c"]).select("id", text("t"), "c")


@query(f"WITH {TRADES}, a AS (SELECT symbol, max(p) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN INTERVAL 600 second PRECEDING AND CURRENT ROW) >= 90 AS met FROM trades) SELECT symbol, count(*) AS n, count(*) FILTER (met) AS met FROM a GROUP BY symbol")
def price_alerts(spark, d):
    x = R.price_alert(V.trades(spark, d), "above", 90.0, 600)
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("met").alias("met"))


@query(
    f"WITH {TRADES}, d AS ({_BAR.format(t=NY_DAY)}), m AS (SELECT symbol, avg(v) AS adv FROM d GROUP BY symbol), a AS (SELECT symbol, {NY_DAY} AS day, t, CAST(sum(s) OVER (PARTITION BY symbol, {NY_DAY} ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM trades) "
    f"SELECT a.symbol, strftime(a.day, '%Y-%m-%d') AS day, {TEXT.format('min(t)')} AS t, arg_min(v, t) AS v FROM a JOIN m ON a.symbol = m.symbol WHERE v >= 1.05 * adv GROUP BY a.symbol, a.day"
)
def volume_latch(spark, d):
    """The first trade of a trading day at which its volume has passed 1.05 of the mean day's."""
    x = V.trades(spark, d).withColumn("day", F.date_format(T.ny_date(F.col("t")), "yyyy-MM-dd"))
    w = W.partitionBy("symbol", "day").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    mean = days(spark, d).groupBy("symbol").agg(F.avg("v").alias("adv"))
    rows = x.select("symbol", "day", "t", F.sum("s").over(w).alias("v")).join(mean, "symbol")
    return R.latched(rows, F.col("v") >= 1.05 * F.col("adv"), ["symbol", "day"]).select("symbol", "day", text("t"), "v")


@query(
    f"WITH {QUARTERS}, m AS (SELECT symbol, avg(c) AS mean FROM bars GROUP BY symbol), a AS (SELECT b.symbol, t, c > mean AS ok, row_number() OVER (PARTITION BY b.symbol ORDER BY t) AS n FROM bars b JOIN m ON b.symbol = m.symbol), "
    "b AS (SELECT symbol, t, n - row_number() OVER (PARTITION BY symbol ORDER BY t) AS run FROM a WHERE ok), s AS (SELECT *, min(t) OVER (PARTITION BY symbol, run) AS start FROM b) "
    f"SELECT symbol, {TEXT.format('start')} AS start, {TEXT.format('min(t)')} AS fired_at FROM s WHERE epoch_us(t) - epoch_us(start) >= 2700000000 GROUP BY symbol, start"
)
def held_conditions(spark, d):
    """Closes above their symbol's mean for 45 minutes."""
    x = quarters(spark, d)
    rows = x.join(x.groupBy("symbol").agg(F.avg("c").alias("mean")), "symbol")
    return R.held_for(rows, F.col("c") > F.col("mean"), 2700).select("symbol", text("start"), text("fired_at"))


@query()
def smart_money_setup(spark, d):
    """Days as the higher time frame, quarters of an hour as the lower one; nested zones are flattened. The parts have SQL of their own."""
    x = Q.smart_money_setup(days(spark, d), quarters(spark, d))
    return x.select("symbol", "signal", "quality", "regime", "spot", F.col("demand.top").alias("demand_top"), F.col("demand.bottom").alias("demand_bottom"), F.col("supply.bottom").alias("supply_bottom"), "price_in_block", "zone", F.concat_ws(",", "confirmations").alias("confirmations"), "entry", "stop", "target", "reward_risk", "meets")


_BUY = "least(3.0, CASE WHEN p.price > 0 THEN greatest(0.0, (f.cash - 1.15) / p.price) ELSE 0.0 END)"
_FILL = "CASE WHEN p.buy THEN " + _BUY + " ELSE least(3.0, f.held) END"


@query(
    "WITH RECURSIVE p AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS account, row_number() OVER w AS seq, row_number() OVER w % 2 = 1 AS buy, value AS price FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "f AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS seq, false AS buy, 0.0::DOUBLE AS filled, 1000.0::DOUBLE AS cash, 0.0::DOUBLE AS held FROM p "
    f"UNION ALL SELECT p.account, p.seq, p.buy, {_FILL}, CASE WHEN {_FILL} > 0 THEN f.cash - CASE WHEN p.buy THEN 1 ELSE -1 END * {_FILL} * p.price - 1.15 ELSE f.cash END, f.held + CASE WHEN p.buy THEN 1 ELSE -1 END * {_FILL} FROM f JOIN p ON p.account = f.account AND p.seq = f.seq + 1) "
    "SELECT account, seq, 'purchase' AS symbol, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS action, round(filled, 6) + 0.0 AS filled, CASE WHEN filled > 0 THEN 'filled' ELSE 'rejected' END AS status, round(cash, 6) + 0.0 AS cash_after, round(held, 6) + 0.0 AS position_after FROM f WHERE seq > 0"
)
def paper_fills(spark, d):
    got = D.paper_fills(V.account_orders(spark, d))
    return got.withColumns({c: F.round(c, 6) + 0.0 for c in ("filled", "cash_after", "position_after")})


@query(
    "WITH e AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS e FROM events), a AS (SELECT *, hour(e) * 60 + minute(e) AS m, CAST(e AS DATE) AS d FROM e), b AS (SELECT *, isodow(d) < 6 AND m >= 570 AND m < 960 AS open, d + CASE WHEN m >= 570 THEN 1 ELSE 0 END AS x FROM a), "
    "c AS (SELECT *, timezone('UTC', timezone('America/New_York', x + CASE isodow(x) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END + INTERVAL 570 minute)) AS nxt, CASE WHEN open THEN timezone('UTC', timezone('America/New_York', d + INTERVAL 570 minute)) END AS cur FROM b) "
    f"SELECT event_id, open, {TEXT.format('nxt')} AS next_open, {TEXT.format('cur')} AS session_open, CAST(floor(epoch(nxt)) - floor(epoch(ts)) AS BIGINT) AS seconds FROM c"
)
def market_hours(spark, d):
    e = V.table(spark, d, "events")
    t = F.col("ts")
    return e.select("event_id", T.is_open(t).alias("open"), T.next_open(t).alias("n"), T.session_open(t).alias("s"), T.seconds_to_open(t).alias("seconds")).select("event_id", "open", text("n").alias("next_open"), text("s").alias("session_open"), "seconds")


@query(f"WITH {QUARTERS} SELECT symbol, {TEXT.format('t')} AS t, c FROM bars WHERE t >= TIMESTAMP '2024-01-10 12:00:00' AND t < TIMESTAMP '2024-01-12 12:00:00'")
def bars_window(spark, d):
    return N.bars_window(V.trades(spark, d), "2024-01-10 12:00:00", "2024-01-12 12:00:00", 15).select("symbol", text("t"), "c")


@query(f"WITH {TRADES}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, id) AS n FROM trades WHERE t >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 8 hour AND t < TIMESTAMP '2024-01-15 12:00:00') SELECT symbol, id, p, s FROM a WHERE n <= 10000")
def trades_lookback(spark, d):
    return N.lookback(V.trades(spark, d), "2024-01-15 12:00:00").select("symbol", "id", "p", "s")


@query("WITH a AS (SELECT event_type AS symbol, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00') SELECT * FROM a WHERE rank <= 30")
def latest_news(spark, d):
    return N.news_page(V.news(spark, d), "2024-01-20 00:00:00", 99).select("symbol", "id", "rank")


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def unseen_news(spark, d):
    """Every event twice, those before the middle of the month seen."""
    x = V.news(spark, d).select("id", "created_at")
    return N.unseen(x.union(x), x.where("created_at < timestamp_ntz'2024-01-15 00:00:00'")).select("id")


@query(
    f"WITH {QUARTERS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars), e AS (SELECT id, symbol, t AS ts, p AS price FROM trades WHERE symbol = 'purchase'), "
    "k AS (SELECT e.id, max(i) AS i FROM e JOIN b ON b.symbol = e.symbol AND b.t + INTERVAL 15 minute <= e.ts GROUP BY e.id), a AS (SELECT k.id, count(*) AS n, avg(c) AS m FROM k JOIN b ON b.symbol = 'purchase' AND b.i <= k.i AND b.i > k.i - 10 GROUP BY k.id), "
    "z AS (SELECT e.id, count(*) AS n, max(h) AS h, min(l) AS l, arg_max(c, t) AS c FROM e JOIN b ON b.symbol = e.symbol AND b.t > e.ts AND b.t <= e.ts + INTERVAL 1 hour GROUP BY e.id) "
    "SELECT e.id, e.symbol, coalesce(a.n, 0) AS n_before, round(a.m, 6) AS mean_before, coalesce(z.n, 0) AS n_after, round((z.h / nullif(price, 0) - 1) * 100, 5) AS best_pct, round((z.l / nullif(price, 0) - 1) * 100, 5) AS worst_pct, z.c AS close_after FROM e LEFT JOIN a ON a.id = e.id LEFT JOIN z ON z.id = e.id"
)
def entry_context(spark, d):
    entries = V.trades(spark, d).where("symbol = 'purchase'").select("id", "symbol", F.col("t").alias("ts"), F.col("p").alias("price"))
    got = N.entry_context(entries, quarters(spark, d), 15)
    return got.withColumns({"mean_before": F.round("mean_before", 6), "best_pct": F.round("best_pct", 5), "worst_pct": F.round("worst_pct", 5)})


@query(
    f"WITH {HOURS}, d AS ({_BAR.format(t=NY_DAY)}), q AS (SELECT symbol, count(*) AS quantity FROM trades GROUP BY symbol), p AS (SELECT symbol, arg_max(p, row(t, id)) AS p FROM trades WHERE symbol IN ('click', 'view') GROUP BY symbol), b AS (SELECT symbol, arg_max(c, t) AS b FROM bars WHERE symbol <> 'error' GROUP BY symbol), c AS (SELECT symbol, arg_max(c, t) AS c FROM d GROUP BY symbol) "
    "SELECT q.symbol, quantity, coalesce(p, b, c) AS mark, round(quantity * coalesce(p, b, c), 6) AS value FROM q LEFT JOIN p ON p.symbol = q.symbol LEFT JOIN b ON b.symbol = q.symbol LEFT JOIN c ON c.symbol = q.symbol"
)
def marked_positions(spark, d):
    t = V.trades(spark, d)
    got = N.marked(t.groupBy("symbol").agg(F.count("*").alias("quantity")), t.where("symbol in ('click', 'view')"), hours(spark, d).where("symbol <> 'error'"), days(spark, d))
    return got.withColumn("value", F.round("value", 6))


@query(
    "WITH x AS (SELECT o_orderpriority AS symbol, o_orderdate AS t, max(o_totalprice) AS c FROM orders GROUP BY ALL), a AS (SELECT *, count(*) OVER w AS n, max(c) OVER w AS high, min(c) OVER w AS low FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 251 PRECEDING)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, CASE WHEN n >= 60 THEN high END AS high, CASE WHEN n >= 60 THEN low END AS low FROM a"
)
def long_ranges(spark, d):
    closes = V.targets(spark, d).groupBy(F.col("firm").alias("symbol"), F.col("date").alias("t")).agg(F.max("target").alias("c"))
    return N.long_ranges(closes).select("symbol", text("t"), "high", "low")


@query("SELECT o_orderpriority AS firm, strftime(max(o_orderdate), '%Y-%m-%d') AS date, count(*) AS n FROM orders GROUP BY firm ORDER BY max(o_orderdate) DESC, firm LIMIT 3")
def top_firms(spark, d):
    return N.top_firms(V.targets(spark, d), 3).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
