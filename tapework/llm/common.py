"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as blank between words and around lines: space and the controls 9 to 13.
BLANK = b" \t\n\x0b\x0c\r"
BLANK_CLASS = r"\x20\x09-\x0D"

_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) one of our own where it is unset."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_folders[app]


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by cut(), when nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case, so that an operator's own columns can take them."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the measure for how finely work is dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def some_at_a_time(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of texts of about so many bytes, and the row that each begins at, so that what is worked on at once stays small."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    for end in (np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes, append=-1)) + 1).tolist():
        yield at, texts.slice(at, end - at)
        at = end


def total_before(df: DataFrame, value: str, name: str, by: list[str], part: str, number: str) -> DataFrame:
    """df with the sum of value over the rows of equal `by` that come earlier in the order of part and number.

    Parts are summed up first, so that a window holds the parts of a group, or the numbers of a part, but never all rows.
    """
    keys = {c: f"_key{k}" for k, c in enumerate([*by, part])}
    parts = df.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*[keys[c] for c in by]).orderBy(keys[part]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_parts_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, part).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("_here_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return here.join(parts, same).select(*df.columns, (F.col("_parts_before") + F.col("_here_before")).cast("long").alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def over_texts(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str) -> Callable[[Column], Column]:
    """A column function of a text column by make()(texts), which is made once in each task and gets a few MB of texts at a time.

    Only the texts go to Python, and only the answers come back. It counts as nondeterministic, so that the optimizer
    doesn't put it in two places and work twice.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        answer = make()
        for texts in batches:
            parts = [answer(part) for _, part in some_at_a_time(texts)]
            yield pa.concat_arrays(parts) if parts else answer(texts)

    return run.asNondeterministic()
