"""One stream of raw messages, taken apart into typed tables, each message once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

KINDS = ("bars", "trades", "quotes", "news", "status")


def messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """(kind, symbol, m): the messages of raw rows, whose text is a JSON array of objects or one object; text that is neither gives none.

    m stays a variant, as keys of a message differ by case alone.
    """
    whole = F.try_parse_json(F.col(column).cast("string"))
    each = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole))
    d = raw.select(F.explode(each).alias("m")).where(F.schema_of_variant("m").startswith("OBJECT"))
    return d.select(_get("T", "string").alias("kind"), F.upper(_get("S", "string")).alias("symbol"), "m").where("kind is not null")


def _get(key: str, kind: str) -> Column:
    return F.try_variant_get("m", f"$.{key}", kind)


def _time(key: str) -> Column:
    return F.try_to_timestamp(_get(key, "string"))


def branches(found: DataFrame, watched: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of messages: bars, trades and quotes of the watched symbols, news by watched symbol, and status messages.

    watched (symbol): a static table, in any case of letters. A piece of news goes to each watched symbol that it
    names, once. Rows without a time that can be read are left out; a quote without a price above
    0 on a side has none there.
    """
    known = watched.select(F.upper("symbol").alias("symbol")).distinct()
    of = lambda kind: found.where(F.col("kind") == kind).join(known, "symbol", "left_semi").withColumn("t", _time("t")).where("t is not null")
    doubles = lambda *keys: [_get(k, "double").alias(k) for k in keys]
    price = lambda key: F.when(_get(key, "double") > 0, _get(key, "double"))
    named = F.array_distinct(F.transform(_get("symbols", "array<string>"), F.upper))
    news = found.where("kind = 'n'").select(_get("id", "long").alias("id"), _get("headline", "string").alias("headline"), _time("created_at").alias("created_at"), F.explode(named).alias("symbol"))
    return {
        "bars": of("b").select("symbol", "t", *doubles("o", "h", "l", "c", "v", "vw")),
        "trades": of("t").select("symbol", "t", *doubles("p", "s"), _get("x", "string").alias("x"), _get("i", "long").alias("id")).where("p is not null"),
        "quotes": of("q").select("symbol", "t", price("bp").alias("bid"), _get("bs", "double").alias("bid_size"), price("ap").alias("ask"), _get("as", "double").alias("ask_size")),
        "news": news.where("created_at is not null").join(known, "symbol", "left_semi").select("id", "symbol", "headline", "created_at"),
        "status": found.where(~F.col("kind").isin("b", "t", "q", "n")).select("kind", _get("msg", "string").alias("msg"), _get("code", "int").alias("code")),
    }


def start(raw: DataFrame, watched: DataFrame, folder: str, checkpoint: str, column: str = "value", **trigger) -> StreamingQuery:
    """Write the branches of a raw stream to folder/<kind>/batch=<k>.

    All tables of a batch come from one read of it. A batch that is tried again after a failure
    replaces its own folders, so every message is in its table once, over restarts too.
    """

    def write(batch: DataFrame, k: int) -> None:
        found = messages(batch, column).persist()
        for kind, rows in branches(found, watched).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{kind}/batch={k}")
        found.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
