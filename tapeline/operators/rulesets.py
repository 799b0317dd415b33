"""Rule sets as JSON (armed actions with conditions): validation with error rows, typed actions, price levels, one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a condition may watch, and those among them that lie on the price axis.
FIELDS = (
    "last_price", "bid_price", "ask_price", "bid_size", "ask_size", "spread", "previous_minute_high", "previous_minute_low", "previous_minute_close",
    "day_volume", "volume_ratio", "rvol_pace", "momentum_pct", "portfolio_value", "vix",
)
PRICE_FIELDS = ("last_price", "bid_price", "ask_price", "previous_minute_high", "previous_minute_low", "previous_minute_close")
#: Seconds that a condition may have to hold.
LONGEST_HOLD = 600


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, path: str, kind: str) -> Column:
    return _kind(_get(v, path, "variant")).startswith(kind)


def _absent(v: Column, path: str) -> Column:
    return _kind(_get(v, path, "variant")) == "VOID"


def _number(v: Column, path: str) -> Column:
    """A finite number, also one written as a string; null for all else, booleans too."""
    x = F.when(~_is(v, path, "BOOLEAN"), F.coalesce(_get(v, path, "double"), _get(v, path, "string").try_cast("double")))
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parsed(sets: DataFrame) -> DataFrame:
    """Rows (set_id, symbol, i, action) of sets (set_id, symbol, actions as JSON): every element with its place; sets whose text is no non-empty array have one row with i null."""
    v = F.try_parse_json("actions")
    items = F.try_variant_get(v, "$", "array<variant>")
    whole = sets.select("set_id", "symbol", F.when(_kind(v).startswith("ARRAY"), items).alias("_items"))
    return whole.select("set_id", "symbol", F.posexplode_outer("_items").alias("i", "action"))


def _conditions(actions: DataFrame) -> DataFrame:
    items = F.when(_is(F.col("action"), "conditions", "ARRAY"), _get(F.col("action"), "conditions", "array<variant>"))
    return actions.select("set_id", "symbol", "i", "action", F.posexplode(items).alias("j", "condition"))


def errors(sets: DataFrame) -> DataFrame:
    """(set_id, i, j, place, error): everything that is wrong with the sets, one row each; `place` counts in the order of reading, so the smallest is what to mend first.

    A number may be written as a string; one that is not finite, or a boolean, is none.
    """
    d = parsed(sets)
    a = F.col("action")
    amount, percent = _absent(a, "quantity"), _absent(a, "quantity_pct")
    size, part = _number(a, "quantity"), _number(a, "quantity_pct")
    whole = F.col("i").isNotNull()
    of_action = [
        (0, ~whole, "actions must be a non-empty array"),
        (1, whole & ~_kind(a).startswith("OBJECT"), "must be an object"),
        (2, ~_is(a, "action", "STRING") | ~F.coalesce(_get(a, "action", "string").isin("buy", "sell"), F.lit(False)), "action must be buy or sell"),
        (3, amount == percent, "exactly one of quantity and quantity_pct must be set"),
        (4, (~amount & size.isNull()) | (~percent & part.isNull()), "quantity is no number"),
        (5, ~amount & percent & (size <= 0), "quantity must be above 0"),
        (6, ~percent & amount & ((part <= 0) | (part > 100)), "quantity_pct must be in (0, 100]"),
        (7, ~_is(a, "conditions", "ARRAY") | (F.size(_get(a, "conditions", "array<variant>")) == 0), "conditions must be a non-empty array"),
        (9, ~_absent(a, "trail") & ~_is(a, "trail", "BOOLEAN"), "trail must be a boolean"),
    ]
    c = F.col("condition")
    hold = _number(c, "hold_sec")
    of_condition = [
        (1, ~_kind(c).startswith("OBJECT"), "must be an object"),
        (2, ~F.coalesce(_get(c, "field", "string").isin(*FIELDS), F.lit(False)), "field is unknown"),
        (3, ~F.coalesce(_get(c, "condition", "string").isin("above", "below"), F.lit(False)), "condition must be above or below"),
        (4, _number(c, "value").isNull(), "value must be a number"),
        (5, ~_absent(c, "hold_sec") & hold.isNull(), "hold_sec must be a number of seconds"),
        (6, (hold < 0) | (hold > LONGEST_HOLD), f"hold_sec must be between 0 and {LONGEST_HOLD}"),
    ]
    first = d.select("set_id", "i", F.lit(None).cast("int").alias("j"), F.explode(_known(of_action, _kind(a).startswith("OBJECT"))).alias("x"))
    inner = _conditions(d.where(_kind(a).startswith("OBJECT"))).select("set_id", "i", "j", F.explode(_known(of_condition, _kind(c).startswith("OBJECT"))).alias("x"))
    at_action = F.struct(F.coalesce("i", F.lit(-1)).alias("i"), F.when(F.col("x.k") < 8, 0).otherwise(2).alias("stage"), F.lit(-1).alias("j"), F.col("x.k").alias("k"))
    at_condition = F.struct(F.col("i"), F.lit(1).alias("stage"), F.col("j"), F.col("x.k").alias("k"))
    return first.select("set_id", "i", "j", at_action.alias("place"), "x.error").unionByName(inner.select("set_id", "i", "j", at_condition.alias("place"), "x.error"))


def _known(checks: list, is_object: Column) -> Column:
    """Faults of one element; one that is no object has that fault alone."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad & (is_object | F.lit(k <= 1)), F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit(text).alias("error"))) for k, bad, text in checks]))


def validated(sets: DataFrame) -> DataFrame:
    """(set_id, symbol, error, actions): the first fault of each set with its place, or its typed actions with their conditions.

    set_id must be unique. Missing hold_sec is 0, missing trail is true, missing note is empty.
    """
    e = errors(sets).groupBy("set_id").agg(F.min(F.struct("place", "i", "j", "error")).alias("x"))
    where = F.concat_ws("", F.when(F.col("x.i").isNotNull(), F.format_string("actions[%d]", "x.i")), F.when(F.col("x.j").isNotNull(), F.format_string(".conditions[%d]", "x.j")), F.when(F.col("x.i").isNotNull(), F.lit(": ")))
    e = e.select("set_id", F.concat(where, F.col("x.error")).alias("error"))
    good = parsed(sets).join(e, "set_id", "left_anti")
    c = F.col("condition")
    rule = F.struct("j", _get(c, "field", "string").alias("field"), _get(c, "condition", "string").alias("condition"), _number(c, "value").alias("value"), F.coalesce(_number(c, "hold_sec"), F.lit(0.0)).alias("hold_sec"))
    a = F.col("action")
    rows = _conditions(good).withColumn("rule", rule).groupBy("set_id", "i").agg(
        F.first(_get(a, "action", "string")).alias("action"), F.first(_number(a, "quantity")).alias("quantity"), F.first(_number(a, "quantity_pct")).alias("quantity_pct"),
        F.first(F.coalesce(_get(a, "note", "string"), F.lit(""))).alias("note"), F.first(F.coalesce(_get(a, "trail", "boolean"), F.lit(True))).alias("trail"),
        F.transform(F.array_sort(F.collect_list("rule")), lambda x: x.dropFields("j")).alias("conditions"),
    )
    item = F.struct("i", "action", "quantity", "quantity_pct", "note", "trail", "conditions")
    typed = rows.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("i")).alias("actions"))
    return sets.select("set_id", "symbol").join(e, "set_id", "left").join(typed, "set_id", "left").select("set_id", "symbol", "error", "actions")


def _plain(x: Column) -> Column:
    """A number in its shortest form, without a point where it is whole."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e6), F.floor(x).cast("string")).otherwise(x.cast("string"))


def price_levels(valid: DataFrame) -> DataFrame:
    """(set_id, symbol, action, label, field, condition, value): conditions of valid sets that lie on the price axis, as lines of a chart."""
    d = valid.select("set_id", "symbol", F.explode("actions").alias("a")).select("set_id", "symbol", "a", F.explode("a.conditions").alias("c")).where(F.col("c.field").isin(*PRICE_FIELDS))
    size = F.when(F.col("a.quantity").isNotNull(), F.concat(_plain(F.col("a.quantity")), F.lit("sh"))).otherwise(F.concat(_plain(F.col("a.quantity_pct")), F.lit("%")))
    return d.select("set_id", "symbol", "a.action", F.concat_ws(" ", "a.action", size).alias("label"), "c.field", "c.condition", "c.value")


def summaries(valid: DataFrame) -> DataFrame:
    """(set_id, i, text): one line per action of valid sets, such as `buy 10 sh X when last_price below 180 and vix below 20 held 30s (note)`."""
    d = valid.select("set_id", "symbol", F.posexplode("actions").alias("i", "a"))
    of = F.when(F.col("a.action") == "sell", "position").otherwise("cash")
    size = F.when(F.col("a.quantity").isNotNull(), F.concat(_plain(F.col("a.quantity")), F.lit(" sh"))).otherwise(F.concat(_plain(F.col("a.quantity_pct")), F.lit("% of "), of))
    said = F.transform("a.conditions", lambda c: F.concat(F.concat_ws(" ", c["field"], c["condition"], _plain(c["value"])), F.when(c["hold_sec"] > 0, F.concat(F.lit(" held "), _plain(c["hold_sec"]), F.lit("s"))).otherwise("")))
    text = F.concat(F.concat_ws(" ", "a.action", size, "symbol", F.lit("when"), F.array_join(said, " and ")), F.when(F.col("a.note") != "", F.concat(F.lit(" ("), F.col("a.note"), F.lit(")"))).otherwise(""))
    return d.select("set_id", "i", text.alias("text"))
