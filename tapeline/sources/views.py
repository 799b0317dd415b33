"""Market views over the driver's tables; times are UTC timestamps without zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t, p, s, id) from events; s is a whole number of shares."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("t"), F.col("value").alias("p"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("s"), F.col("event_id").alias("id"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, created_at): every event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("ts").alias("created_at"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, seq, ts, symbol, action, price): each user's purchases as alternating buys and sells of one share, by time and id; seq counts within the account."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    action = F.when(n % 2 == 1, "buy").otherwise("sell")
    return e.select(F.col("user_id").cast("string").alias("account"), n.cast("long").alias("seq"), "ts", F.col("event_type").alias("symbol"), action.alias("action"), F.col("value").alias("price"))


def account_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, seq, symbol, action, quantity, price): each user's purchases as alternating buys and sells of three shares, by time."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    action = F.when(n % 2 == 1, "buy").otherwise("sell")
    return e.select(F.col("user_id").cast("string").alias("account"), n.cast("long").alias("seq"), F.col("event_type").alias("symbol"), action.alias("action"), F.lit(3.0).alias("quantity"), F.col("value").alias("price"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, strike, call_oi, put_oi, iv): an option chain per nation's region, from returned and accepted lines."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity").cast("long")).otherwise(F.lit(0)))
    return rows.groupBy(F.col("p_brand").alias("symbol"), F.col("p_size").cast("double").alias("strike")).agg(
        flag("A").alias("call_oi"), flag("R").alias("put_oi"), F.round(F.avg(F.lit(0.10) + (F.col("p_partkey") % 40) / 100), 6).alias("iv")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(firm, date, target, id): price targets from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("firm"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("target"), F.col("o_orderkey").alias("id"))


def latest_by_rank(primary: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Source fallback: per key the row of the first source that has one; of a source's rows of one key the smallest, column by column."""
    from pyspark.sql import Window as W

    every = primary.withColumn("source_rank", F.lit(0))
    for k, df in enumerate(others, 1):
        every = every.unionByName(df.withColumn("source_rank", F.lit(k)))
    n = F.row_number().over(W.partitionBy(*keys).orderBy("source_rank", *[c for c in primary.columns if c not in keys]))
    return every.withColumn("_n", n).where("_n = 1").drop("_n")
