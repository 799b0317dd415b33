"""Registered queries of quotes, corporate actions, dividends, chain sides and source preference, in the style of the market queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import options as O
from tapeline.operators import records as E
from tapeline.operators import scans as N
from tapeline.plans.market import HOURS, TEXT, hours, query, r, text
from tapeline.sources import views as V


@query(
    "WITH q AS (SELECT event_id AS id, event_type AS symbol, CASE WHEN value - 5 > 0 THEN value - 5 END AS bp, value - 5 + (event_id % 7 - 1) * 0.25 AS a, event_id % 5 * 60 AS age FROM events), p AS (SELECT id, symbol, bp, CASE WHEN a > 0 THEN a END AS ap, age FROM q), s AS (SELECT *, ap - bp AS spread, (ap - bp) / ((ap + bp) / 2) * 100 AS pct FROM p) "
    "SELECT id, symbol, round(bp, 6) AS bp, round(ap, 6) AS ap, round(spread, 6) AS spread, round(pct, 6) AS spread_pct, concat_ws('; ', CASE WHEN spread < 0 THEN 'crossed' END, CASE WHEN pct > 1 THEN 'wide' END, CASE WHEN age > 120 THEN 'stale' END) AS warnings FROM s"
)
def quote_quality(spark, d):
    """Quotes around each event's value less five, so that some prices are not positive, with spreads from -0.25 up and ages of up to four minutes."""
    k = F.col("event_id")
    bid = F.col("value") - 5
    quotes = V.table(spark, d, "events").select(k.alias("id"), F.col("event_type").alias("symbol"), F.col("ts").alias("t"), bid.alias("bp"), (bid + (k % 7 - 1) * 0.25).alias("ap"))
    now = F.timestamp_seconds(F.unix_timestamp(F.col("t").cast("timestamp")) + F.col("id") % 5 * 60)
    return E.quote_quality(quotes, now).select("id", "symbol", r("bp"), r("ap"), r("spread"), r("spread_pct"), "warnings")


#: By o_orderstatus: the group of actions, and the date field that they carry.
_ACTIONS = {"O": ("cash_dividends", "ex_date"), "F": ("forward_splits", "process_date"), "P": ("stock_mergers", "effective_date")}


def action_payloads(spark, d):
    """One JSON payload of grouped actions per customer, from its orders; every eleventh order has no date, mergers also have a later payable date."""
    o = V.table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    later = F.when(F.col("o_orderstatus") == "P", F.date_format(F.date_add(F.to_date("o_orderdate"), 5), "yyyy-MM-dd"))
    of = lambda at: F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.lit(x[at])) for s, x in _ACTIONS.items()])
    fields = F.map_filter(F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), of(1), day, F.lit("payable_date"), later), lambda _, v: v.isNotNull())
    groups = o.select(F.col("o_custkey").alias("symbol"), of(0).alias("kind"), fields.alias("fields")).groupBy("symbol", "kind").agg(F.collect_list("fields").alias("actions"))
    return groups.groupBy("symbol").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", "actions")))).alias("json"))


@query(
    "SELECT o_custkey AS symbol, CASE o_orderstatus WHEN 'O' THEN 'cash_dividend' WHEN 'F' THEN 'forward_split' ELSE 'stock_merger' END AS type, "
    "strftime(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 5 days END, '%Y-%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS id FROM orders"
)
def corporate_actions(spark, d):
    return E.corporate_actions(action_payloads(spark, d)).select("symbol", "type", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("action")["id"].alias("id"))


@query("SELECT p_partkey AS symbol, round(sum(p_size / 10 * pow(1 + (p_partkey % 21 - 5) / 100, k)), 6) AS return_pct FROM part, range(10) AS y(k) GROUP BY p_partkey")
def dividend_returns(spark, d):
    """Ten years of yields of 0.1 to 5 percent that grow by -5 to 15 percent a year."""
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("symbol"), F.round(N.dividend_return(F.col("p_size") / 10, F.col("p_partkey") % 21 - 5), 6).alias("return_pct"))


_SIDE = "SELECT l_partkey AS symbol, CAST(l_linenumber AS DOUBLE) AS strike, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS oi, max(l_discount) AS iv FROM lineitem WHERE l_returnflag = '{}' GROUP BY ALL"


@query(
    f"WITH c AS ({_SIDE.format('A')}), p AS ({_SIDE.format('R')}) SELECT coalesce(c.symbol, p.symbol) AS symbol, coalesce(c.strike, p.strike) AS strike, coalesce(c.oi, 0) AS call_oi, coalesce(p.oi, 0) AS put_oi, coalesce(c.iv, 0) AS call_iv, coalesce(p.iv, 0) AS put_iv FROM c FULL JOIN p ON c.symbol = p.symbol AND c.strike = p.strike"
)
def chain_sides(spark, d):
    """Accepted lines as calls and returned ones as puts, by part and line number; an iv of zero is NaN, and many strikes have one side only."""
    li = V.table(spark, d, "lineitem")

    def side(flag):
        g = li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("symbol"), F.col("l_linenumber").cast("double").alias("strike"))
        iv = F.max("l_discount")
        return g.agg(F.sum(F.col("l_quantity").cast("long")).alias("oi"), F.when(iv == 0, F.lit(float("nan"))).otherwise(iv).alias("iv"))

    return O.join_sides(side("A"), side("R"))


@query(
    f"WITH {HOURS}, p AS (SELECT symbol, t, v FROM bars WHERE v >= 100), x AS (SELECT *, 0 AS source_rank FROM p UNION ALL SELECT symbol, t, CAST(n AS BIGINT), 1 FROM (SELECT symbol, time_bucket(INTERVAL 1 hour, trades.t) AS t, count(*) AS n FROM trades GROUP BY ALL)) "
    f"SELECT symbol, {TEXT.format('t')} AS t, arg_min(v, source_rank) AS v, min(source_rank) AS source_rank FROM x GROUP BY symbol, t"
)
def consolidated_volume(spark, d):
    """Hourly volume of the full tape where it has at least 100 shares, else the number of trades as the thinner source."""
    every = hours(spark, d)
    thin = V.trades(spark, d).groupBy("symbol", F.date_trunc("hour", F.col("t").cast("timestamp")).cast(every.schema["t"].dataType).alias("t")).agg(F.count("*").alias("v"))
    best = V.latest_by_rank(every.where("v >= 100").select("symbol", "t", "v"), thin, keys=["symbol", "t"])
    return best.select("symbol", text("t"), "v", "source_rank")
