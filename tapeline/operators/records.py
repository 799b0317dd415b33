"""Records around the market: corporate actions, quotes, transcripts and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A signed number with thousands separators and decimals; fixed value.
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"


def corporate_actions(payloads: DataFrame) -> DataFrame:
    """(symbol, json) of grouped actions to rows (symbol, type, date, action): singular type, first of the ex, effective, process and payable dates, by date with nulls last."""
    groups = F.from_json("json", "map<string, array<map<string, string>>>")
    d = payloads.select("symbol", F.explode(groups).alias("type", "actions")).select("symbol", F.regexp_replace("type", "s$", "").alias("type"), F.explode("actions").alias("action"))
    date = F.coalesce(*[F.col("action")[f"{k}_date"] for k in ("ex", "effective", "process", "payable")])
    return d.select("symbol", "type", date.cast("date").alias("date"), "action").orderBy(F.asc_nulls_last("date"))


def quote_quality(quotes: DataFrame, now: Column, wide_pct: float = 1.0, stale_s: int = 120) -> DataFrame:
    """Quotes (symbol, t, bp, ap) with spread, spread in percent of the middle and warnings; prices that are not positive become null."""
    d = quotes.withColumns({k: F.when(F.col(k) > 0, F.col(k)) for k in ("bp", "ap")})
    d = d.withColumn("spread", F.col("ap") - F.col("bp")).withColumn("spread_pct", F.col("spread") / ((F.col("ap") + F.col("bp")) / 2) * 100)
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp"))
    return d.withColumn("warnings", F.concat_ws("; ", F.when(F.col("spread") < 0, "crossed"), F.when(F.col("spread_pct") > wide_pct, "wide"), F.when(age > stale_s, "stale")))


def symbols(text: Column) -> Column:
    """Upper-case symbols of a text separated by commas, semicolons or white space, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,;\s]+"), F.upper), lambda x: x != ""))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def grounding(turns: DataFrame, least: float = 10.0) -> DataFrame:
    """Per conversation: numbers of assistant turns (absolute value at least `least`) and how many an earlier turn has shown, within 0.01 or 1 %.

    Both sides are distinct numbers per conversation; the join is within a conversation and on
    the number's neighbourhood in logarithmic buckets, so it stays an equi-join.
    """
    n = turns.select("conv_id", "turn", "role", F.explode(numbers(F.col("text"))).alias("x")).where(F.abs("x") >= least)
    bucket = F.floor(F.log(F.abs("x")) / F.log(F.lit(1.02)))
    said = n.where("role = 'assistant'").groupBy("conv_id", "turn", "x").agg(F.lit(1).alias("_")).withColumn("b", F.explode(F.sequence(bucket - 1, bucket + 1)))
    shown = n.groupBy("conv_id", F.col("x").alias("y")).agg(F.min("turn").alias("first")).withColumn("b", F.floor(F.log(F.abs("y")) / F.log(F.lit(1.02))))
    ok = said.join(shown, ["conv_id", "b"]).where((F.col("first") < F.col("turn")) & (F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(0.01), F.abs("y") * 0.01)))
    ok = ok.select("conv_id", "turn", "x").distinct().withColumn("ok", F.lit(1))
    each = said.select("conv_id", "turn", "x").distinct().join(ok, ["conv_id", "turn", "x"], "left")
    return each.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("grounded"))


def plain_text(html: Column) -> Column:
    """Tags to spaces, white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
