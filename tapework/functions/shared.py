"""A folder that driver and executors share, for tables between jobs and for streams' checkpoints; slices of Arrow arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or in local mode (tests) where that is unset in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what is read many times: it is made once, also if executors are lost.

    What its files take says little of what its rows take in memory, so a join doesn't send it to every task.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def files(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path, as Hadoop has it, and the path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with all in it; whether there was one."""
    system, place = files(spark, path)
    return system.delete(place, True)


def slices(values: pa.Array, most_bytes: int = 1 << 20) -> Iterator[pa.Array]:
    """An array in stretches of about so many bytes, at least one, so that few of its values are Python objects at once."""
    step = max(1, len(values) * most_bytes // max(1, values.nbytes))
    for at in range(0, max(1, len(values)), step):
        yield values.slice(at, step)
