"""Registered queries of session levels, profit potential, irregular bars, mixtures, reports and rule sets, in the style of the market queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.operators import joins as J
from tapeline.operators import levels as L
from tapeline.operators import mixture as M
from tapeline.operators import reports as N
from tapeline.operators import rulesets as U
from tapeline.operators import session_levels as S
from tapeline.plans.market import _BAR, HOURS, QUARTERS, TEXT, TRADES, half_up, hours, query, r, text
from tapeline.plans.reads import _NMS, quarters
from tapeline.sources import views as V

_SESSION = (
    "e AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS e FROM bars), s AS (SELECT *, strftime(e, '%Y-%m-%d') AS day, hour(e) * 60 + minute(e) AS m FROM e WHERE hour(e) * 60 + minute(e) >= 570 AND hour(e) * 60 + minute(e) < 960), "
    "n AS (SELECT *, row_number() OVER w AS i, count(*) OVER d AS n, coalesce(lag(c, 2) OVER w, first(c) OVER w) AS pa, coalesce(lead(c, 2) OVER w, last(c) OVER (PARTITION BY symbol, day ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pz, "
    "min(l) OVER d AS lo, max(h) OVER d AS hi, median(CASE WHEN v > 0 AND m >= 573 THEN v END) OVER d AS base FROM s WINDOW w AS (PARTITION BY symbol, day ORDER BY t), d AS (PARTITION BY symbol, day)), "
    "b AS (SELECT * FROM n WHERE n >= 7 AND base > 0), cand AS (SELECT *, CASE WHEN pa = 0 THEN 0 ELSE (c - pa) / pa * 10000 END AS pre, CASE WHEN c = 0 THEN 0 ELSE (pz - c) / c * 10000 END AS post FROM b WHERE m >= 573 AND v >= 1.5 * base), "
)


@query(
    f"WITH RECURSIVE {QUARTERS}, {_SESSION}"
    + _NMS.format(keys="symbol, day", pkeys="p.symbol, p.day", src="cand", width=2, on="p.symbol = f.symbol AND p.day = f.day")
    + f", spikes AS (SELECT cand.symbol, cand.day, cand.t, {half_up('(h + l + c) / 3', 4)} AS price, {half_up('v / base', 2)} AS rel_vol, v, CASE WHEN pre > 8 AND post <= 8 THEN 'supply' WHEN pre < -8 AND post >= -8 THEN 'demand' ELSE 'unsure' END AS type, "
    "EXISTS (SELECT 1 FROM events n WHERE n.event_type = cand.symbol AND n.event_id % 7 = 0 AND abs(epoch_us(n.ts) - epoch_us(cand.t)) <= 900000000) AS news_driven FROM cand JOIN y ON cand.symbol = y.symbol AND cand.day = y.day AND cand.i = y.i), "
    "rest AS (SELECT symbol, day, least(greatest(CAST(floor(((h + l + c) / 3 - lo) / ((hi - lo) / 24)) AS BIGINT), 0), 23) AS bin, v, t, base, lo, hi FROM b WHERE hi > lo AND NOT EXISTS (SELECT 1 FROM spikes k WHERE k.symbol = b.symbol AND k.day = b.day AND k.t = b.t)), "
    "g AS (SELECT symbol, day, bin, sum(v) AS v, arg_max(t, (v, -epoch_us(t))) AS t, any_value(base) AS base, any_value(lo) AS lo, any_value(hi) AS hi FROM rest GROUP BY ALL), "
    "x AS (SELECT a.*, (SELECT sum(v) FROM g z WHERE z.symbol = a.symbol AND z.day = a.day) / 24 AS mean, coalesce(p.v, 0) AS pv, coalesce(q.v, 0) AS qv, lo + (a.bin + 0.5) * ((hi - lo) / 24) AS centre, (hi - lo) / 24 / 2 AS half FROM (SELECT * FROM g) a LEFT JOIN (SELECT symbol, day, bin, v FROM g) p ON p.symbol = a.symbol AND p.day = a.day AND p.bin = a.bin - 1 LEFT JOIN (SELECT symbol, day, bin, v FROM g) q ON q.symbol = a.symbol AND q.day = a.day AND q.bin = a.bin + 1), "
    f"every AS (SELECT * FROM spikes UNION ALL SELECT symbol, day, t, {half_up('centre', 4)}, {half_up('v / base', 2)}, v, 'scattered', false FROM x WHERE mean > 0 AND v >= 1.5 * mean AND v >= pv AND v >= qv AND NOT EXISTS (SELECT 1 FROM spikes k WHERE k.symbol = x.symbol AND k.day = x.day AND abs(x.centre - k.price) <= x.half)) "
    f"SELECT symbol, day, {TEXT.format('t')} AS t, price, rel_vol, CAST(v AS BIGINT) AS v, type, news_driven, coalesce(t < max(CASE WHEN news_driven THEN t END) OVER (PARTITION BY symbol, day), false) AS stale FROM every"
)
def session_levels(spark, d):
    """Every seventh event is news."""
    news = V.news(spark, d).where("id % 7 = 0")
    done = S.session_levels(quarters(spark, d), news, warmup=3, times=1.5, width=2)
    return done.select("symbol", "day", text("t"), "price", "rel_vol", "v", "type", "news_driven", "stale")


@query(
    f"WITH {HOURS}, p AS (SELECT symbol, unnest([l, h]) AS p, unnest([row(t, 0), row(t, 1)]) AS o FROM bars), q AS (SELECT * FROM p WHERE p > 0), g AS (SELECT symbol, min(p) AS lo, max(p) AS hi, arg_min(o, (p, o)) AS a, arg_min(o, (-p, o)) AS z FROM q GROUP BY symbol), "
    "x AS (SELECT q.symbol, any_value(lo) AS min, any_value(hi) AS max, max(p) FILTER (o >= a) AS max_after_min, min(p) FILTER (o <= z) AS min_before_max FROM q JOIN g ON q.symbol = g.symbol GROUP BY q.symbol) "
    "SELECT *, round(greatest((max_after_min / min - 1) * 100, (max / min_before_max - 1) * 100), 4) AS max_profit_pct FROM x"
)
def profit_potential(spark, d):
    return S.potential(hours(spark, d)).select("symbol", "min", "max", "max_after_min", "min_before_max", r("max_profit_pct", 4))


@query(
    f"WITH {TRADES}, m AS (SELECT time_bucket(INTERVAL 15 minute, t) AS t, arg_max(p, row(t, id)) AS c FROM trades WHERE symbol = 'view' GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY t) AS pos, count(*) OVER () AS size FROM m), "
    "w AS (SELECT id, t AS first_t, t + (id % 5) * INTERVAL 15 minute AS last_t, 2 + id % 9 AS n FROM trades WHERE symbol = 'purchase'), i AS (SELECT w.id, any_value(n) AS n, count(s.t) AS k, arg_min(c, s.t) AS a, arg_max(c, s.t) AS z FROM w LEFT JOIN s ON s.t BETWEEN first_t AND last_t GROUP BY w.id) "
    "SELECT i.id, k >= 2 AS same_time, round(CASE WHEN k >= 2 THEN (z / nullif(a, 0) - 1) * 100 ELSE (l.c / nullif(f.c, 0) - 1) * 100 END, 6) AS market_pct FROM i JOIN s l ON l.pos = l.size JOIN s f ON f.pos = greatest(1, f.size - i.n + 1)"
)
def market_return(spark, d):
    """Windows of up to an hour from each purchase on, against the 15-minute closes of views; those with fewer than two bars fall back to the last bars."""
    trades = V.trades(spark, d)
    windows = trades.where("symbol = 'purchase'").select("id", F.col("t").alias("first_t"), F.expr("t + make_dt_interval(0, 0, 15 * cast(id % 5 as int), 0)").alias("last_t"), (F.col("id") % 9 + 2).alias("n"))
    market = quarters(spark, d).where("symbol = 'view'").select("t", "c")
    return J.market_return(windows, market).select("id", "same_time", r("market_pct"))


_ODD = "odd AS (SELECT symbol, t FROM (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM bars) WHERE k % 5 <> 0), ends AS (SELECT symbol, t, coalesce(lead(t) OVER w, t + (t - lag(t) OVER w), t + INTERVAL 1 minute) AS z FROM odd WINDOW w AS (PARTITION BY symbol ORDER BY t))"


@query(
    f"WITH {HOURS}, {_ODD} SELECT o.symbol, {TEXT.format('o.t')} AS t, count(*) AS n, round(quantile_cont(p, 0.2), 6) AS p20, round(quantile_cont(p, 0.8), 6) AS p80 FROM ends o JOIN trades x ON x.symbol = o.symbol AND x.t >= o.t AND x.t < o.z GROUP BY o.symbol, o.t"
)
def gap_percentiles(spark, d):
    """Trade percentiles of hourly bars of which every fifth is missing, so that bars last as long as the gap after them."""
    k = F.row_number().over(W.partitionBy("symbol").orderBy("t"))
    odd = hours(spark, d).select("symbol", "t").withColumn("k", k).where("k % 5 <> 0").drop("k")
    binned = J.in_gaps(V.trades(spark, d), odd)
    g = binned.groupBy("symbol", F.col("bar_t").alias("t")).agg(F.count("*").alias("n"), F.percentile("p", 0.2).alias("p20"), F.percentile("p", 0.8).alias("p80"))
    return g.select("symbol", text("t"), "n", r("p20"), r("p80"))


@query()
def volume_mixture(spark, d):
    """Three normal distributions in each symbol's volume by price."""
    profile = L.volume_profile(hours(spark, d), 50)
    width = F.lead("low").over(W.partitionBy("symbol").orderBy("bin")) - F.col("low")
    h = profile.withColumn("width", F.coalesce(width, F.lag("low").over(W.partitionBy("symbol").orderBy("bin")) * -1 + F.col("low"))).select("symbol", (F.col("low") + F.col("width") / 2).alias("centre"), "v")
    return M.fit_mixture(h, 3).select("symbol", "component", r("weight"), r("location"), r("scale"), r("log_likelihood", 3))


def scoring_sessions(spark, d):
    """A scoring session per user and day of events: errors are tool errors and rejections, purchases are filled orders, each kind of event is one activation."""
    e = V.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    none = F.lit(0).cast("long")
    kinds = e.groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("value"), F.min("ts").alias("ts"))
    kinds = kinds.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct(
        F.col("event_type").alias("strategy"), F.when(F.col("n") > 1, "busy").when(F.col("value") > 10, "calm").alias("regime"), (F.col("value") > 20).alias("effective"), (F.col("n") - 1).alias("active_decisions"), F.when(F.col("value") <= 50, F.col("value")).alias("return_pct"),
    ))).alias("activations"))
    g = e.groupBy("user_id", "day").agg(
        F.min("ts").cast("timestamp").alias("started_at"), F.lit("live").alias("mode"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).cast("double").alias("runtime_sec"),
        F.when(of("view") > 0, F.struct(of("view").alias("scored_cycles"), F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 2).alias("mean_score"), F.min(F.when(F.col("event_type") == "view", F.col("value"))).alias("min_score"), F.array(F.min("event_type")).alias("ungrounded"))).alias("grounding"),
        F.struct(F.count("*").alias("attempts"), of("error").alias("rejections")).alias("tactics"), F.struct(of("click").alias("calls"), of("error").alias("errors"), none.alias("quote_calls"), none.alias("quote_warnings")).alias("tools"),
        F.struct(F.count("*").alias("total"), of("purchase").alias("buy_sell_filled"), none.alias("buy_sell_rejected"), none.alias("tactics_armed"), none.alias("alerts"), none.alias("forced_sleeps"), of("purchase").alias("active"), F.when(of("purchase") > 0, F.max("value")).alias("return_pct")).alias("decisions"),
    )
    return g.join(kinds, ["user_id", "day"]).select("started_at", "mode", "runtime_sec", "grounding", "tactics", "tools", "decisions", "activations")


_SESSIONS = (
    "s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS started_at, floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000) AS run, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (event_type = 'view') AS views, "
    "CAST(round(CAST(CAST(avg(value) FILTER (event_type = 'view') AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS score, min(value) FILTER (event_type = 'view') AS low, max(value) AS top, min(event_type) AS least FROM events GROUP BY 1, 2)"
)


@query(
    f"WITH {_SESSIONS}, g AS (SELECT day, count(*) AS sessions, round(sum(run), 1) AS total_runtime_sec, sum(views) AS scored_cycles, sum(score * views) / nullif(sum(views), 0) AS mean_score, min(low) AS min_score, count(DISTINCT CASE WHEN views > 0 THEN least END) AS ungrounded, sum(n) AS total, sum(errors) AS errors, sum(clicks) AS clicks, sum(bought) AS active, avg(CASE WHEN bought > 0 THEN top END) AS ret FROM s GROUP BY day HAVING sum(run) >= 3600) "
    "SELECT strftime(day, '%Y-%m-%d') AS day, sessions, total_runtime_sec, CAST(scored_cycles AS BIGINT) AS scored_cycles, round(mean_score, 6) AS mean_score, min_score, ungrounded, round(errors / total, 6) AS rejection_rate, round(errors / nullif(clicks, 0), 6) AS error_rate, CAST(active AS BIGINT) AS active, round(active / total, 6) AS active_rate, round(ret, 6) AS mean_session_return_pct FROM g"
)
def day_reports(spark, d):
    sessions = scoring_sessions(spark, d)
    done = N.due_reports(sessions, spark.createDataFrame([], "day date"))
    q = "decision_quality"
    return done.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "sessions", "total_runtime_sec", "grounding.scored_cycles", r("grounding.mean_score").alias("mean_score"), "grounding.min_score", F.size("grounding.ungrounded").cast("long").alias("ungrounded"),
        r("tactics_validation.rejection_rate").alias("rejection_rate"), r("tools.error_rate").alias("error_rate"), f"{q}.active", r(f"{q}.active_rate").alias("active_rate"), r(f"{q}.mean_session_return_pct").alias("mean_session_return_pct"),
    )


@query(
    "WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS started_at FROM events GROUP BY 1, 2), k AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS strategy, count(*) AS n, CAST(round(CAST(CAST(avg(value) AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3), "
    "a AS (SELECT k.*, s.started_at, row_number() OVER (PARTITION BY user_id, day ORDER BY strategy) AS place, CASE WHEN n > 1 THEN 'busy' WHEN value > 10 THEN 'calm' END AS regime FROM k JOIN s USING (user_id, day)), f AS (SELECT day, strategy, regime, min(row(started_at, place)) AS first FROM a WHERE regime IS NOT NULL GROUP BY ALL), "
    "o AS (SELECT day, strategy, string_agg(regime, ',' ORDER BY first) AS regimes FROM f GROUP BY ALL) "
    "SELECT strftime(a.day, '%Y-%m-%d') AS day, a.strategy, count(*) AS activations, count(*) FILTER (value > 20) AS effective, count(*) FILTER (n = 1) AS alert_only, round(count(*) FILTER (value > 20) / count(*), 6) AS effectiveness, round(avg(CASE WHEN value <= 50 THEN value END), 9) AS mean_return_pct, coalesce(any_value(regimes), '') AS regimes FROM a LEFT JOIN o ON a.day = o.day AND a.strategy = o.strategy GROUP BY a.day, a.strategy"
)
def day_strategies(spark, d):
    g = N.strategy_stats(scoring_sessions(spark, d))
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "strategy", "activations", "effective", "alert_only", r("effectiveness"), r("mean_return_pct", 9), F.array_join("regimes", ",").alias("regimes"))


#: By the last digit of event_id: a condition's field, its operator, its hold, and the fault that a set then has.
_FAULTS = {
    0: ("last_price", "below", "30", None), 1: ("mood", "below", "30", "actions[0].conditions[0]: field is unknown"), 2: ("bid_price", "at", "30", "actions[0].conditions[0]: condition must be above or below"),
    3: ("day_volume", "above", "601", "actions[0].conditions[0]: hold_sec must be between 0 and 600"), 4: ("vix", "below", "0", None), 5: ("ask_price", "above", '"x"', "actions[0].conditions[0]: hold_sec must be a number of seconds"),
}


def rule_sets(spark, d):
    """A rule set in JSON per event: its kind says the action, its id the condition; the values of sevens are missing."""
    e = V.table(spark, d, "events")
    k = F.col("event_id") % 10
    pick = lambda at: F.coalesce(*[F.when(k == n, F.lit(x[at])) for n, x in _FAULTS.items()], F.lit(_FAULTS[0][at]))
    action = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "hold").otherwise("sell")
    value = F.when(k == 7, F.lit("null")).otherwise(F.col("value").cast("string"))
    text_ = F.format_string('[{"action": "%s", "%s": %d, "conditions": [{"field": "%s", "condition": "%s", "value": %s, "hold_sec": %s}], "note": "n"}]', action, F.when(k == 8, "quantity_pct").otherwise("quantity"), (F.col("event_id") % 150), pick(0), pick(1), value, pick(2))
    return e.select(F.col("event_id").alias("set_id"), F.col("event_type").alias("symbol"), text_.alias("actions"))


_RULES = (
    "x AS (SELECT event_id AS set_id, event_type, value, event_id % 10 AS k, event_id % 150 AS q FROM events), v AS (SELECT *, CASE WHEN event_type = 'error' THEN 'actions[0]: action must be buy or sell' WHEN k <> 8 AND q <= 0 THEN 'actions[0]: quantity must be above 0' WHEN k = 8 AND (q <= 0 OR q > 100) THEN 'actions[0]: quantity_pct must be in (0, 100]' "
    "WHEN k = 7 THEN 'actions[0].conditions[0]: value must be a number' " + " ".join(f"WHEN k = {n} THEN '{f[3]}'" for n, f in _FAULTS.items() if f[3]) + " END AS error FROM x)"
)


@query(f"WITH {_RULES} SELECT set_id, error FROM v")
def rule_set_errors(spark, d):
    return U.validated(rule_sets(spark, d)).select("set_id", "error")


@query(
    f"WITH {_RULES} SELECT set_id, event_type AS symbol, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS action, CASE WHEN event_type = 'purchase' THEN 'buy ' ELSE 'sell ' END || q || CASE WHEN k = 8 THEN '%' ELSE 'sh' END AS label, 'last_price' AS field, 'below' AS condition, value FROM v WHERE error IS NULL AND k <> 4"
)
def rule_set_levels(spark, d):
    return U.price_levels(U.validated(rule_sets(spark, d)))


@query(
    f"WITH {QUARTERS}, a AS (SELECT *, timezone('America/New_York', timezone('UTC', t)) AS e FROM bars), b AS (SELECT *, strftime(e, '%Y-%m-%d') AS day, hour(e) * 60 + minute(e) AS m FROM a WHERE hour(e) * 60 + minute(e) >= 570), k AS (SELECT *, m < 600 AS inside, row_number() OVER (PARTITION BY symbol, day, m < 600 ORDER BY t DESC) AS k FROM b), "
    "g AS (SELECT symbol, day, min(m) AS first, max(h) FILTER (inside) AS high, min(l) FILTER (inside) AS low, avg(v) FILTER (inside) AS vol, count(*) FILTER (inside) AS n, count(*) FILTER (NOT inside) > 0 AS complete, arg_max(c, t) AS price, avg(v) FILTER (NOT inside AND k <= 3) AS late FROM k GROUP BY ALL), "
    "x AS (SELECT *, CASE WHEN first > 585 THEN 'bars do not reach back to the open' WHEN n = 0 THEN 'no bars in the window' END AS note FROM g) "
    "SELECT symbol, day, note, CASE WHEN note IS NULL THEN high END AS high, CASE WHEN note IS NULL THEN low END AS low, CASE WHEN note IS NULL THEN round(vol, 6) END AS avg_volume, CASE WHEN note IS NULL THEN n END AS n, CASE WHEN note IS NULL THEN complete END AS complete, CASE WHEN note IS NULL THEN price END AS price, "
    "CASE WHEN note IS NOT NULL THEN NULL WHEN NOT complete THEN 'still forming' WHEN price > high THEN 'broken out above' WHEN price < low THEN 'broken out below' ELSE 'inside_range' END AS status, CASE WHEN note IS NULL THEN round(late / nullif(vol, 0), 6) END AS volume_ratio FROM x"
)
def opening_breakouts(spark, d):
    got = L.opening_breakout(quarters(spark, d), 30, 15)
    return got.withColumns({"avg_volume": F.round("avg_volume", 6), "volume_ratio": F.round("volume_ratio", 6)})
