"""Registered queries of what a session is read against, in the style of the market queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import context as X
from tapeline.operators import levels as L
from tapeline.operators import options as O
from tapeline.plans.market import _GEX, HOURS, QUARTERS, TEXT, hours, query, r, text
from tapeline.plans.reads import quarters
from tapeline.sources import views as V

_SPANS = "(7), (30), (90), (365)"


@query(
    "WITH c AS (SELECT o_custkey AS symbol, o_orderdate AS t, max(o_totalprice) AS c FROM orders GROUP BY ALL), g AS (SELECT symbol, days, count(*) AS n, arg_min(c, t) AS a, arg_max(c, t) AS z, min(c) AS low, max(c) AS high "
    f"FROM c, (VALUES {_SPANS}) AS s(days) WHERE t < TIMESTAMP '1999-07-01' AND t >= TIMESTAMP '1999-07-01' - to_days(CAST(days AS INTEGER)) GROUP BY symbol, days) SELECT symbol, days, round((z / a - 1) * 100, 6) AS change_pct, low, high, z AS last FROM g WHERE n >= 2"
)
def price_context(spark, d):
    """A customer's largest order of a day is its close."""
    o = V.table(spark, d, "orders")
    closes = o.groupBy(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("t")).agg(F.max("o_totalprice").alias("c"))
    return X.price_context(closes, "1999-07-01").select("symbol", "days", r("change_pct"), "low", "high", "last")


@query(
    "WITH c AS (SELECT o_orderpriority AS s, o_orderdate AS t, max(o_totalprice) / 15000 AS c FROM orders GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t DESC) AS back, count(*) OVER (PARTITION BY s) AS n FROM c WHERE t < TIMESTAMP '1999-07-01' AND t >= TIMESTAMP '1999-06-01'), "
    "o AS (SELECT max(c) FILTER (s = '3-MEDIUM' AND back = 1 AND n >= 5) AS i, max(c) FILTER (s = '3-MEDIUM' AND back = 5) AS w, max(c) FILTER (s = '3-MEDIUM' AND back = n AND n >= 20) AS m, max(c) FILTER (s = '1-URGENT' AND back = 1) AS v, max(c) FILTER (s = '2-HIGH' AND back = 1) AS v3 FROM n) "
    "SELECT round((i / w - 1) * 100, 6) AS index_week_pct, round((i / m - 1) * 100, 6) AS index_month_pct, i AS index_close, v AS vix, CASE WHEN v > 30 THEN 'fear/spike' WHEN v > 20 THEN 'elevated' WHEN v > 15 THEN 'moderate' WHEN v <= 15 THEN 'complacency' END AS regime, "
    "CASE WHEN v IS NOT NULL THEN v3 END AS vix3m, CASE WHEN v3 > v THEN 'contango' WHEN v3 <= v THEN 'backwardation' END AS term_structure FROM o"
)
def macro_context(spark, d):
    """Closes by priority, as in market_regime."""
    closes = V.targets(spark, d).groupBy(F.col("firm").alias("symbol"), F.col("date").alias("t")).agg((F.max("target") / 15000).alias("c"))
    return X.macro_context(closes, "1-URGENT", "2-HIGH", "3-MEDIUM", "1999-07-01").withColumns({c: F.round(c, 6) for c in ("index_week_pct", "index_month_pct")})


_HISTORY = (
    "k AS (SELECT p_brand AS symbol, year(l_shipdate) AS taken, CAST(p_size AS DOUBLE) AS strike, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS call_oi, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS put_oi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), "
    "q AS (SELECT symbol, taken, arg_max(strike, row(call_oi, -strike)) AS call_wall, arg_max(strike, row(put_oi, -strike)) AS put_wall FROM k GROUP BY ALL), e AS (SELECT symbol, count(*) AS n, arg_min(call_wall, taken) AS ca, arg_max(call_wall, taken) AS cz, arg_min(put_wall, taken) AS pa, arg_max(put_wall, taken) AS pz FROM q GROUP BY symbol), "
    "h AS (SELECT symbol, CASE WHEN n < 2 THEN NULL WHEN cz > ca THEN 'rising' WHEN cz < ca THEN 'falling' ELSE 'flat' END AS call_wall_trend, CASE WHEN n < 2 THEN NULL WHEN pz > pa THEN 'rising' WHEN pz < pa THEN 'falling' ELSE 'flat' END AS put_wall_trend FROM e)"
)


def wall_history(spark, d):
    """Walls of each brand's chain by year of shipping."""
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity").cast("long")).otherwise(F.lit(0)))
    chain = rows.groupBy(F.struct(F.col("p_brand").alias("symbol"), F.year("l_shipdate").alias("taken")).alias("symbol"), F.col("p_size").cast("double").alias("strike")).agg(flag("A").alias("call_oi"), flag("R").alias("put_oi"))
    return O.walls(chain).select("symbol.*", "call_wall", "put_wall")


@query(f"WITH {_HISTORY} SELECT * FROM h")
def wall_trends(spark, d):
    return X.wall_trends(wall_history(spark, d))


@query(
    f"{_GEX}, {_HISTORY}, w AS (SELECT symbol, arg_max(strike, row(call_oi, -strike)) AS c, arg_max(strike, row(put_oi, -strike)) AS p FROM chain GROUP BY symbol), s AS (SELECT symbol, sum(net_gamma) AS net FROM b GROUP BY symbol) "
    "SELECT symbol, c AS call_wall, p AS put_wall, CASE WHEN net >= 0 THEN 'dampening' ELSE 'amplifying' END AS gamma_regime, CASE WHEN p <= 25 AND 25 <= c THEN 'inside' WHEN 25 > c THEN 'above' ELSE 'below' END AS position, "
    "CASE WHEN c > p THEN round((25 - p) / (c - p) * 100, 1) END AS range_position_pct, abs(25 - c) / c < 0.01 AS near_call_wall, abs(25 - p) / p < 0.01 AS near_put_wall, call_wall_trend, put_wall_trend FROM w JOIN s USING (symbol) LEFT JOIN h USING (symbol)"
)
def wall_reads(spark, d):
    done = X.wall_read(O.gamma_exposure(V.chain(spark, d), 25.0), 25.0, wall_history(spark, d))
    return done.drop("gamma_flip", "net_gamma")


@query(
    "WITH x AS (SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS expiry, date_diff('day', DATE '2001-09-15', CAST(l_shipdate AS DATE)) AS dte FROM lineitem), y AS (SELECT *, CASE WHEN dte BETWEEN 0 AND 45 THEN 0 WHEN dte >= 0 THEN 1 ELSE 2 END AS k FROM x) "
    "SELECT symbol, strftime(arg_min(expiry, row(k, expiry)), '%Y-%m-%d') AS expiry, CAST(arg_min(dte, row(k, expiry)) AS INTEGER) AS dte FROM y GROUP BY symbol"
)
def nearest_expiries(spark, d):
    """A part's dates of shipping as expiries, near the end of the table so that some have none ahead."""
    e = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_shipdate").alias("expiry"))
    return X.nearest_expiry(e, "2001-09-15").withColumn("expiry", F.date_format("expiry", "yyyy-MM-dd"))


@query(
    "WITH p AS (SELECT min(event_id) AS pick, lower(upper(event_type)) AS a, lower(upper(props)) AS b FROM events WHERE event_type IN ('error', 'purchase') GROUP BY event_type, props), n AS (SELECT lower(event_type) AS a, lower(props) AS b, max(event_id) AS id FROM events GROUP BY ALL) "
    f"SELECT pick, e.event_id AS id, event_type AS symbol, {TEXT.format('ts')} AS created_at FROM p JOIN n USING (a, b) JOIN events e ON e.event_id = n.id"
)
def chosen_news(spark, d):
    """Errors and purchases chosen by their kind and properties in capitals, of which the last event counts."""
    e = V.table(spark, d, "events")
    news = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("props").alias("text"), F.col("event_type").alias("symbol"), F.col("ts").alias("created_at"))
    picks = e.where("event_type in ('error', 'purchase')").groupBy(F.upper("event_type").alias("title"), F.upper("props").alias("text")).agg(F.min("event_id").alias("pick"))
    return X.chosen_news(news, picks).select("pick", "id", "symbol", text("created_at"))


@query("SELECT event_type AS symbol, CASE WHEN event_type IN ('view', 'purchase') THEN CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END ELSE 'unknown' END AS impact, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def news_impacts(spark, d):
    """Views and purchases are labelled by their value; counted by symbol and impact, with distinct users."""
    e = V.table(spark, d, "events")
    impacts = e.where("event_type in ('view', 'purchase')").select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, "positive").otherwise("negative").alias("impact"))
    labelled = X.labelled_news(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "user_id"), impacts)
    return labelled.groupBy("symbol", "impact").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    f"WITH {HOURS}, ends AS (SELECT *, coalesce(lead(t) OVER w, t + (t - lag(t) OVER w), t + INTERVAL 1 minute) AS z FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), big AS (SELECT * FROM trades WHERE s >= 80), "
    "g AS (SELECT o.symbol, o.t, quantile_cont(p, 0.2) AS a, quantile_cont(p, 0.8) AS b FROM ends o JOIN big x ON x.symbol = o.symbol AND x.t >= o.t AND x.t < o.z GROUP BY o.symbol, o.t) "
    f"SELECT symbol, {TEXT.format('t')} AS t, c >= o AS rising, least(o, c) AS base, round(abs(c - o), 6) AS height, round(coalesce(a, l + 0.2 * (h - l)), 6) AS p20, round(coalesce(b, l + 0.8 * (h - l)), 6) AS p80, a IS NOT NULL AS from_trades FROM bars LEFT JOIN g USING (symbol, t)"
)
def candle_bodies(spark, d):
    """Percentiles of large trades alone, of which an hour may have none."""
    done = X.candle_bodies(hours(spark, d), V.trades(spark, d).where("s >= 80"))
    return done.select("symbol", text("t"), "rising", "base", r("height"), r("p20"), r("p80"), "from_trades")


@query(
    f"WITH {QUARTERS}, a AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS e FROM bars), b AS (SELECT symbol, strftime(e, '%Y-%m-%d') AS day, hour(e) * 60 + minute(e) AS m FROM a WHERE hour(e) * 60 + minute(e) >= 570), g AS (SELECT symbol, day FROM b GROUP BY ALL HAVING min(m) <= 573 AND count(*) FILTER (m < 600) > 0), "
    "x AS (SELECT id, timezone('America/New_York', timezone('UTC', t)) AS e FROM trades), y AS (SELECT *, hour(e) * 60 + minute(e) AS m, isodow(e) < 6 AS open FROM x) "
    "SELECT id, CASE WHEN NOT (open AND m BETWEEN 570 AND 959 AND m NOT BETWEEN 720 AND 839) THEN 'window does not favour breakouts' WHEN strftime(e, '%Y-%m-%d') NOT IN (SELECT day FROM g) THEN 'no symbol has an opening range' END AS refused FROM y"
)
def breakout_gate(spark, d):
    """Every trade's time against the opening ranges of 30 minutes of 15-minute bars."""
    return X.breakout_gate(V.trades(spark, d).select("id", "t"), L.opening_breakout(quarters(spark, d), 30)).select("id", "refused")


@query(
    "WITH t AS (SELECT o_orderpriority AS firm, o_orderdate AS date, o_totalprice AS target, o_orderkey AS id FROM orders), p AS (SELECT firm, row_number() OVER (PARTITION BY firm ORDER BY date, id) AS step, least(greatest(date, TIMESTAMP '1996-01-01'), TIMESTAMP '2000-12-31') AS moment, target FROM t), "
    "e AS (SELECT firm, count(*) + 1 AS step, TIMESTAMP '2000-12-31' AS moment, arg_max(target, row(date, id)) AS target FROM t GROUP BY firm) SELECT firm, step, strftime(moment, '%Y-%m-%d') AS moment, target, round((target / 150000.0 - 1) * 100, 6) AS pct FROM (SELECT * FROM p UNION ALL SELECT * FROM e)"
)
def target_steps(spark, d):
    done = X.target_steps(V.targets(spark, d), "1996-01-01", "2000-12-31", 150000.0)
    return done.withColumns({"moment": F.date_format("moment", "yyyy-MM-dd"), "pct": F.round("pct", 6)})
