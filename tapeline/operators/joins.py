"""As-of, nearest and interval joins as unions, windows and bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Seconds of a time slice, the most of one key that a task takes at once.
SLICE = 86_400


def _slice(t, seconds: int):
    return F.floor(F.unix_micros(t.cast("timestamp")) / (seconds * 1_000_000))


def around(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: list[str], seconds: int = SLICE, clip: bool = False) -> DataFrame:
    """left with `_prev` and `_next`: structs (_at, take) of the right rows latest at or before and earliest at or after each row; right must be unique by (by, right_on).

    Keys are cut into time slices, so a key is as many tasks' work as it has slices. A slice gets
    the last right row before it and the first after it as edges, from one row per key and slice;
    within it one sort finds both. No range join, and no task with a whole key. clip: before a
    key's first right row, `_prev` is that row.
    """
    row = F.struct(F.col(right_on).alias("_at"), *take)
    whole = F.struct(*left.columns)
    empty = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    a = left.select(F.col(by).alias("_by"), _slice(F.col(left_on), seconds).alias("_s"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), whole.alias("_l"), empty(right, row).alias("_r"))
    b = right.select(F.col(by).alias("_by"), _slice(F.col(right_on), seconds).alias("_s"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), empty(left, whole).alias("_l"), row.alias("_r"))
    known = b.where("_t is not null")
    ends = known.groupBy("_by", "_s").agg(F.min_by("_r", "_t").alias("_low"), F.max_by("_r", "_t").alias("_high"), F.lit(False).alias("_wanted"))
    wanted = a.select("_by", "_s", empty(right, row).alias("_low"), empty(right, row).alias("_high"), F.lit(True).alias("_wanted")).distinct()
    per_slice = ends.union(wanted).groupBy("_by", "_s").agg(F.first("_low", True).alias("_low"), F.first("_high", True).alias("_high"), F.max("_wanted").alias("_wanted"))
    w = W.partitionBy("_by").orderBy("_s")
    before = F.last("_high", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    if clip:
        before = F.coalesce(before, F.first("_low", True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    per_slice = per_slice.withColumns({"_before": before, "_after": F.first("_low", True).over(w.rowsBetween(1, W.unboundedFollowing))}).where("_wanted")
    edge = lambda c, side: per_slice.where(F.col(c).isNotNull()).select("_by", "_s", empty(left, F.col(left_on)).alias("_t"), F.lit(side).alias("_side"), empty(left, whole).alias("_l"), F.col(c).alias("_r"))
    line = a.unionByName(b).unionByName(edge("_before", -1)).unionByName(edge("_after", 2))
    place = F.when(F.col("_side") == 2, 1).when(F.col("_side") == -1, -1).otherwise(0)
    back = W.partitionBy("_by", "_s").orderBy(place, "_t", "_side")
    ahead = W.partitionBy("_by", "_s").orderBy(place.desc(), F.desc("_t"), "_side")
    found = line.withColumns({"_prev": F.last("_r", True).over(back.rowsBetween(W.unboundedPreceding, 0)), "_next": F.last("_r", True).over(ahead.rowsBetween(W.unboundedPreceding, 0))})
    timeless = F.col("_t").isNull()
    return found.where("_side = 1").select("_l.*", (F.col("_prev") if clip else F.when(~timeless, F.col("_prev"))).alias("_prev"), F.when(~timeless, F.col("_next")).alias("_next"))


def _taken(found: DataFrame, left: DataFrame, which, right_on: str, take: list[str]) -> DataFrame:
    d = found.withColumn("_m", which)
    return d.select(*[F.col(f"`{c}`") for c in left.columns], F.col("_m._at").alias(right_on), *[F.col(f"_m.{c}").alias(c) for c in take])


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: list[str], clip: bool = False, seconds: int = SLICE) -> DataFrame:
    """left with the columns `take` of the latest right row at or before it; right must be unique by (by, right_on).

    clip: a left row before the first right row takes the first. In time slices (see around).
    """
    return _taken(around(left, right, by, left_on, right_on, take, seconds, clip), left, F.col("_prev"), right_on, take)


def nearest(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: list[str], seconds: int = SLICE) -> DataFrame:
    """left with the columns `take` of the right row nearest in time, the earlier of two equally near; right must be unique by (by, right_on). In time slices (see around)."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    later = F.col("_prev").isNull() | (micros("_next._at") - micros(left_on) < micros(left_on) - micros("_prev._at"))
    return _taken(around(left, right, by, left_on, right_on, take, seconds), left, F.when(F.col("_next").isNotNull() & later, F.col("_next")).otherwise(F.col("_prev")), right_on, take)


def numbered(rows: DataFrame, by: str, on: str, name: str = "pos", seconds: int = SLICE) -> DataFrame:
    """rows with their position from 1 in order of time within their key, counted slice by slice; times must be unique within a key."""
    d = rows.withColumn("_s", _slice(F.col(on), seconds))
    w = W.partitionBy(by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    bases = d.groupBy(by, "_s").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_s").alias("_slice"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(by, "_s").orderBy(on)))
    d = d.join(bases, d[by].eqNullSafe(F.col("_by")) & F.col("_s").eqNullSafe(F.col("_slice")))
    return d.select(*rows.columns, (F.col("_base") + F.col("_k")).alias(name))


def in_gaps(points: DataFrame, bars: DataFrame, seconds: int = SLICE) -> DataFrame:
    """points (symbol, t, ...) with `bar_t`, the start of the bar whose time up to the next bar holds them, however irregular bars are.

    The last bar lasts as long as the gap before it, a single one a minute. Points before the first
    bar or after the last one's end are left out; bars must be unique by (symbol, t).
    """
    last = bars.groupBy("symbol").agg(F.max("t").alias("_z"))
    second = bars.join(last, "symbol").where("t < _z").groupBy("symbol").agg(F.max("t").alias("_y"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = last.join(second, "symbol", "left").select("symbol", (2 * micros("_z") - F.coalesce(micros("_y"), micros("_z") - 60_000_000)).alias("_end"))
    found = asof_backward(points, bars.select("symbol", F.col("t").alias("bar_t")), "symbol", "t", "bar_t", [], seconds=seconds)
    return found.where("bar_t is not null").join(ends, "symbol").where(micros("t") < F.col("_end")).drop("_end")


def market_return(windows: DataFrame, market: DataFrame, seconds: int = SLICE) -> DataFrame:
    """windows (id, first_t, last_t, n) with the market's move in percent over the same time.

    market: one series (t, c). The move runs from the first bar in [first_t, last_t] to the last. Where
    a time is missing or fewer than two bars lie within, it runs over the market's last n bars;
    null where those are fewer than two too, or start at 0. Bars are found by time slices and
    by their numbers, so no window is joined with a range of bars.
    """
    series = numbered(market.withColumn("_m", F.lit(1)), "_m", "t", seconds=seconds)
    w = windows.withColumn("_m", F.lit(1))
    take = ["pos", "c"]
    w = around(w, series, "_m", "first_t", "t", take, seconds).withColumn("_a", F.col("_next")).drop("_prev", "_next")
    w = around(w, series, "_m", "last_t", "t", take, seconds).withColumn("_z", F.col("_prev")).drop("_prev", "_next")
    w = w.withColumn("_n", F.col("_z.pos") - F.col("_a.pos") + 1)
    size = series.groupBy("_m").agg(F.max("pos").alias("_size"), F.max_by("c", "pos").alias("_last"))  # one row
    w = w.join(size, "_m", "left")
    w = w.withColumn("_from", F.greatest(F.lit(1), F.col("_size") - F.col("n") + 1))
    first = series.select(F.col("pos").alias("_from"), F.col("c").alias("_first"))
    w = w.join(first, "_from", "left")
    inside = F.coalesce(F.col("_n") >= 2, F.lit(False))
    start = F.when(inside, F.col("_a.c")).when(F.col("_size") - F.col("_from") >= 1, F.col("_first"))
    end = F.when(inside, F.col("_z.c")).otherwise(F.col("_last"))
    return w.select(*windows.columns, F.when(start != 0, (end / start - 1) * 100).alias("market_pct"), inside.alias("same_time"))


def within(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, seconds: int) -> DataFrame:
    """Pairs of equal key whose times differ by at most `seconds`: an equi-join on time buckets of that width, each right row in three."""
    bucket = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / seconds)
    a = left.withColumn("_b", bucket(F.col(left_on)))
    b = right.withColumn("_b", F.explode(F.sequence(bucket(F.col(right_on)) - 1, bucket(F.col(right_on)) + 1)))
    gap = F.abs(F.unix_micros(F.col(left_on).cast("timestamp")) - F.unix_micros(F.col(right_on).cast("timestamp")))
    return a.join(b, [by, "_b"]).where(gap <= seconds * 1_000_000).drop("_b")


def in_bins(points: DataFrame, bars: DataFrame, minutes: int) -> DataFrame:
    """points (symbol, t, ...) with `bar_t`, the start of the regular bar that holds them: an equi-join on the floored time."""
    at = F.window("t", f"{minutes} minutes").getField("start")
    return points.withColumn("bar_t", at).join(bars.select("symbol", F.col("t").alias("bar_t")), ["symbol", "bar_t"], "left_semi")


def first_after(ledger: DataFrame, action: str = "sell") -> DataFrame:
    """Each buy (account, symbol, seq, price) with the first later row of the given action, by account and symbol in ledger order."""
    w = W.partitionBy("account", "symbol").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    exit_ = F.first(F.when(F.col("action") == action, F.struct("seq", "price")), ignorenulls=True).over(w)
    return ledger.withColumn("_x", exit_).where("action = 'buy'").select("account", "symbol", "seq", "price", F.col("_x.seq").alias("exit_seq"), F.col("_x.price").alias("exit_price"))


def running_sums(rows: DataFrame, by: str, on: str, names: list[str], seconds: int = SLICE) -> DataFrame:
    """rows with the columns `names` replaced by their running sums in order of `on` (unique within a key), slice by slice: sums of earlier slices and a window within the slice."""
    d = rows.withColumn("_s", _slice(F.col(on), seconds))
    earlier = W.partitionBy(by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    base = d.groupBy(by, "_s").agg(*[F.sum(c).alias(c) for c in names])
    base = base.select(F.col(by).alias("_by"), F.col("_s").alias("_slice"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in names])
    inside = W.partitionBy(by, "_s").orderBy(on).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({c: F.sum(c).over(inside) for c in names}).join(base, d[by].eqNullSafe(F.col("_by")) & F.col("_s").eqNullSafe(F.col("_slice")))
    return d.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in names else F.col(f"`{c}`") for c in rows.columns])


def carried_in(targets: DataFrame, start: str) -> DataFrame:
    """Targets from `start` on, and each firm's standing target at the start (the latest before it, ties by id)."""
    before = targets.where(F.col("date") < F.lit(start).cast("timestamp_ntz"))
    standing = before.groupBy("firm").agg(F.max_by(F.struct("date", "target", "id"), F.struct("date", "id")).alias("r")).select("firm", "r.*", F.lit(True).alias("carried"))
    return standing.unionByName(targets.where(F.col("date") >= F.lit(start).cast("timestamp_ntz")).withColumn("carried", F.lit(False)).select("firm", "date", "target", "id", "carried"))


def coverage(rows: DataFrame) -> DataFrame:
    """The grid of symbols and dates between the first and last, with the rows of each; the grid is the only cross join and has symbols times days rows."""
    day = F.to_date("t")
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("z")).select(F.explode(F.sequence("a", "z")).alias("d"))
    grid = rows.select("symbol").distinct().crossJoin(ends)
    n = rows.groupBy("symbol", day.alias("d")).agg(F.count("*").alias("n"))
    return grid.join(n, ["symbol", "d"], "left").select("symbol", "d", F.coalesce("n", F.lit(0)).alias("n"), (F.weekday("d") < 5).alias("is_weekday"))
