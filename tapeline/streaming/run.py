"""Running a stream over what is there, into a shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tapeline.streaming.state import use_rocksdb

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the warehouse where that is unset; it goes when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    folder = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB state store for the streams started inside; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for all that is available now, each batch written once to a shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={k}")

    with rocksdb(spark):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(stream.columns)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parquet*")
