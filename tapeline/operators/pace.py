"""Volume pace: the expected share of a day's volume by the clock, and volume against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clock import eastern

#: Minutes after 09:30 New York time, and the share of an average day's volume by then; fixed values.
CURVE = [
    (0, 0.000), (5, 0.040), (15, 0.090), (30, 0.150), (60, 0.240), (90, 0.310), (120, 0.370), (150, 0.430),
    (180, 0.480), (210, 0.530), (240, 0.580), (270, 0.640), (300, 0.710), (330, 0.790), (360, 0.880), (390, 1.000),
]


def expected_share(t: Column) -> Column:
    """Linear between the curve's points; null before the open, 1 from the close on."""
    e = eastern(t)
    m = F.hour(e) * 60 + F.minute(e) + F.second(e) / 60 - 570
    out = F.when(m < 0, F.lit(None).cast("double"))
    for (a, x), (b, y) in zip(CURVE, CURVE[1:]):
        out = out.when(m <= b, x + (y - x) * (m - a) / (b - a))
    return out.otherwise(1.0)


def relative_pace(volumes: DataFrame, adv: DataFrame) -> DataFrame:
    """volumes (symbol, t, day_volume) with adv (symbol, adv): ratio to the average day, and to its expected share by t (at least 1 %)."""
    share = F.greatest(expected_share(F.col("t")), F.lit(0.01))
    share = F.when(expected_share(F.col("t")).isNotNull(), share)
    d = volumes.join(adv, "symbol")
    return d.select("symbol", "t", "day_volume", (F.col("day_volume") / F.nullif("adv", F.lit(0.0))).alias("ratio"), (F.col("day_volume") / (F.nullif("adv", F.lit(0.0)) * share)).alias("pace"))
