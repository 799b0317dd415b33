"""A store of bars as gzip JSON by symbol and day that is built up incrementally, and journals of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol string, day date, t timestamp, o double, h double, l double, c double, v long"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a store; a filter on symbol or day reads only their folders. A store that doesn't exist yet is empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], BARS)
    return spark.read.schema(BARS).json(path)


def missing_days(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The wanted (symbol, day) that a store lacks."""
    return wanted.select("symbol", "day").distinct().join(held.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")


def add_missing(spark: SparkSession, path: str, bars: DataFrame) -> DataFrame:
    """Append the (symbol, UTC day) of bars that the store lacks, one folder each, and return the store. Days it holds stay as they are, null keys are left out.

    Overwrites the folders of missing days only, so a run that died may be repeated.
    """
    b = bars.select("symbol", F.to_date("t").alias("day"), F.col("t").cast("timestamp").alias("t"), "o", "h", "l", "c", "v").where("symbol is not null and day is not null")
    fresh = b.join(missing_days(b, read_bars(spark, path)), ["symbol", "day"], "left_semi")
    (
        fresh.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip").partitionBy("symbol", "day").json(path)
    )
    return read_bars(spark, path)


def append_journal(rows: DataFrame, path: str) -> None:
    """Append rows to a journal of JSON lines."""
    rows.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: str, newest: str | None = None) -> DataFrame:
    """Rows of a journal, malformed lines left out; sorted newest first by a column where one is named."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if newest is None else rows.orderBy(F.desc(newest))
