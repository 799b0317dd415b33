"""Registered stream queries: each runs a stream over a table's files and returns what the watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.plans.market import TEXT, TRADES, query, text
from tapeline.streaming import ingest, run, state

#: The watermark stands at the last time, in whole milliseconds, less the delay.
_PASSED = "(SELECT date_trunc('milliseconds', max(t)) - INTERVAL 10 minute FROM trades)"


def trades(spark, d):
    e = run.table_stream(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("t"), F.col("value").alias("p"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("v"), F.col("event_id").alias("id"))


@query(
    f"WITH {TRADES}, a AS (SELECT symbol, t, id, p >= 20 AS ok, row_number() OVER (PARTITION BY symbol ORDER BY t, id) AS n FROM trades), b AS (SELECT symbol, t, n - row_number() OVER (PARTITION BY symbol ORDER BY t, id) AS run FROM a WHERE ok), s AS (SELECT *, min(t) OVER (PARTITION BY symbol, run) AS start FROM b) "
    f"SELECT symbol, {TEXT.format('start')} AS start, {TEXT.format('min(t)')} AS fired_at FROM s WHERE epoch_us(t) - epoch_us(start) >= 900000000 GROUP BY symbol, start HAVING min(t) <= {_PASSED}"
)
def stream_held_prices(spark, d):
    """Prices of at least 20 for 15 minutes."""
    return run.available(state.held_for(trades(spark, d), F.col("p") >= 20, 900)).select("symbol", text("start"), text("fired_at"))


@query(
    f"WITH {TRADES} SELECT symbol, strftime(t, '%Y-%m-%d') AS day, {TEXT.format('min(t)')} AS t, arg_min(p, row(t, id)) AS p, arg_min(id, row(t, id)) AS id FROM trades WHERE p > 60 GROUP BY symbol, strftime(t, '%Y-%m-%d') HAVING min(t) <= {_PASSED}"
)
def stream_price_latch(spark, d):
    """The first trade above 60 of each day."""
    rows = trades(spark, d).withColumn("day", F.date_format("t", "yyyy-MM-dd"))
    return run.available(state.latched(rows, F.col("p") > 60, ["symbol", "day"], ["p", "id"])).select("symbol", "day", text("t"), "p", "id")


@query(
    f"WITH {TRADES}, e AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', t)) AS DATE) AS day FROM trades), f AS (SELECT *, min(day) OVER (PARTITION BY symbol) AS first FROM e), v AS (SELECT symbol, t, id, s, sum(s) OVER (PARTITION BY symbol, day ORDER BY t, id ROWS UNBOUNDED PRECEDING) + CASE WHEN day = first AND symbol <> 'view' THEN 1000 ELSE 0 END AS day_volume FROM f) "
    f"SELECT symbol, {TEXT.format('t')} AS t, s AS v, CAST(day_volume AS BIGINT) AS day_volume FROM v WHERE t <= {_PASSED}"
)
def stream_day_volume(spark, d):
    """Volume of the session so far, seeded with 1,000 on each symbol's first day; the seed of views is of another day and counts for nothing."""
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.to_date(F.from_utc_timestamp(F.min("ts").cast("timestamp"), "America/New_York"))
    seeds = e.groupBy(F.col("event_type").alias("symbol")).agg(day.alias("day")).select("symbol", F.when(F.col("symbol") == "view", F.date_add("day", -1)).otherwise(F.col("day")).alias("day"), F.lit(1000).alias("v"))
    return run.available(state.day_volume(trades(spark, d), seeds)).select("symbol", text("t"), "v", "day_volume")


@query(
    f"WITH {TRADES}, a AS (SELECT symbol, time_bucket(INTERVAL 1 minute, t) AS t, id AS arrival, p, s FROM trades), l AS (SELECT *, epoch_us(t) < max(epoch_us(t)) OVER (PARTITION BY symbol ORDER BY arrival ROWS UNBOUNDED PRECEDING) - 57600000000 AS late FROM a), g AS (SELECT symbol, t, arg_min(p, arrival) AS c, CAST(arg_min(s, arrival) AS BIGINT) AS v FROM l WHERE NOT late GROUP BY symbol, t) "
    f"SELECT symbol, {TEXT.format('t')} AS t, c, v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM g) WHERE n <= 420"
)
def stream_bar_buffer(spark, d):
    """Each symbol's newest 420 bars, a trade being a bar of its minute."""
    p = F.col("p")
    bars = trades(spark, d).select("symbol", F.date_trunc("minute", "t").alias("t"), p.alias("o"), p.alias("h"), p.alias("l"), p.alias("c"), "v", F.col("id").alias("arrival"))
    changes = run.available(state.buffer(bars), "update")
    held = changes.groupBy("symbol", "t", "c", "v").agg(F.sum(F.when(F.col("held"), 1).otherwise(-1)).alias("n")).where("n > 0")
    return held.select("symbol", text("t"), "c", "v")


@query(f"WITH {TRADES}, w AS (SELECT unnest(['click', 'view', 'absent']) AS symbol) SELECT CAST(id AS BIGINT) AS id, symbol FROM trades JOIN w USING (symbol) WHERE p >= 0 UNION ALL SELECT id, 'click' FROM trades WHERE symbol = 'view' AND p >= 0")
def stream_news_routing(spark, d):
    """News messages in JSON, of the first symbol and, for views, of clicks too, routed to the watched symbols."""
    watched = spark.createDataFrame([("click",), ("view",), ("absent",)], "symbol string")
    x = trades(spark, d)
    names = F.when(F.col("symbol") == "view", F.array(F.col("symbol"), F.lit("click"), F.lit("VIEW"))).otherwise(F.array("symbol"))
    text_ = F.to_json(F.array(F.struct(F.lit("n").alias("T"), "id", F.lit("x").alias("headline"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), names.alias("symbols"))))
    folder = run.shared_folder(spark)
    ingest.start(x.select(text_.alias("value")), watched, f"{folder}/tables", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/tables/news").select("id", F.lower("symbol").alias("symbol"))
