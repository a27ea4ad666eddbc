"""Run a streaming DataFrame over all that its source holds now, into a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, ts as TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, which operators with several state variables need."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """What the stream emits in append mode once its source is read, as a table in the shared folder."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """The last row that the stream emits for each key in update mode."""
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/_batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    rows = spark.read.parquet(out)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")
