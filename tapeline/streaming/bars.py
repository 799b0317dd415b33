"""Streaming twins: roll-up of a trade stream, de-duplication and a stateful trailing stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rollup(trades: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """The batch roll-up on a stream of (id, symbol, t, p, s), each trade counted once; bars close when the watermark passes them."""
    one = trades.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late).dropDuplicatesWithinWatermark(["id"])
    bars = one.groupBy("symbol", F.window("t", f"{minutes} minutes").alias("w")).agg(
        F.min_by("p", F.struct("t", "id")).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", F.struct("t", "id")).alias("c"), F.sum("s").alias("v")
    )
    return bars.select("symbol", F.col("w.start").alias("t"), "o", "h", "l", "c", "v")


def trailing_stop(prices: DataFrame, percent: float = 5.0) -> DataFrame:
    """(symbol, t, p) to the first price of each symbol that falls the given percent below its running high; then the high starts anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else float("-inf")
        out = []
        for rows in batches:
            for t, p in rows.sort_values("t")[["t", "p"]].itertuples(index=False):
                if p <= high * (1 - percent / 100):
                    out.append((key[0], t, p, high))
                    high = float("-inf")
                else:
                    high = max(high, p)
        state.update((high,))
        yield pd.DataFrame(out, columns=["symbol", "t", "p", "high"])

    schema = "symbol string, t timestamp, p double, high double"
    typed = prices.select("symbol", F.col("t").cast("timestamp").alias("t"), "p")
    return typed.groupBy("symbol").applyInPandasWithState(step, schema, "high double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available now into a table of results in memory; for tests and small backfills."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
