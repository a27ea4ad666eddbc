"""Published stages: results that are stored once for an item, stage, input and version, however many runs publish them.

A table is a folder of runs, whose files never change, and of numbered manifests. A manifest says for each stage, version and slot (a
hash of the key) which run's folder holds its rows. A run writes the slots that it changes, each with the rows that stay, and then puts the
next manifest in place; if another run has taken that number, it starts over from what that one has published. So readers see all of a run
or nothing, and two runs at once store a key once. The driver holds one manifest: slots of stages and versions, never keys or rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import files, remove, stored

#: Slots of a new stage; a stage keeps its own number.
SLOTS = 64
MOST_TRIES = 20
#: A column of every row, for the hash of the input it was made of.
INPUT = "_input_hash"


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last manifest; (0, {}) if there is none."""
    system, place = files(spark, f"{path}/manifests")
    if not system.exists(place):
        return 0, {}
    last = max((f.getPath().getName() for f in system.listStatus(place) if f.getPath().getName().endswith(".json")), default=None)
    if last is None:
        return 0, {}
    return int(last.removesuffix(".json")), json.loads(spark.read.text(f"{path}/manifests/{last}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> bool:
    """Put manifest `number` in place; False if there is one. It is written under another name and renamed, which fails where the name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    system, draft = files(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number:020d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(final).toUri(), conf)
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(final), option)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        system.delete(draft, False)
        return False
    return True


def _rows(spark: SparkSession, path: str, entry: dict | None, slots: Iterable[str] | None = None) -> DataFrame | None:
    """The rows of a stage and version, or of some of its slots, with INPUT."""
    folders = [f"{path}/run={run}/slot={slot}" for slot, run in (entry or {}).get("slots", {}).items() if slots is None or slot in slots]
    if entry is None:
        return None
    shape = T.StructType.fromJson(entry["schema"])
    return spark.read.schema(shape).parquet(*folders) if folders else spark.createDataFrame([], shape)


def _slot(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(n)).cast("string")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= a[c].eqNullSafe(b[c])
    return out


def _replace(spark: SparkSession, path: str, number: int, manifest: dict, name: str, entry: dict, rows: DataFrame, touched: list[str]) -> bool:
    """Write rows as the whole of the touched slots of a stage, and commit that. Without success the files go again.

    Rows are dealt by slot; a large slot is split over several tasks.
    """
    run = uuid.uuid4().hex
    rows.hint("rebalance", F.col("slot")).write.partitionBy("slot").parquet(f"{path}/run={run}")
    system, place = files(spark, f"{path}/run={run}")
    written = {f.getPath().getName().removeprefix("slot=") for f in system.listStatus(place) if f.isDirectory()}
    slots = {k: v for k, v in entry["slots"].items() if k not in touched} | {k: run for k in written}
    if _commit(spark, path, number + 1, manifest | {name: entry | {"slots": slots}}):
        return True
    remove(spark, f"{path}/run={run}")
    return False


def publish_stage(df: DataFrame, path: str, stage: str, version: str, key: list[str], input_hash: Column | None = None, slots: int = SLOTS) -> int:
    """Store the rows of df that the stage and version don't have yet for their key and input; how many that were.

    input_hash: what a row was made from, as a hash (null is a value of its own). A stored row of the same key and hash is reused, one with another hash
    is replaced. Without it a key that is there is reused. Of rows of df that repeat a key one is taken. A key may hold nulls. Runs
    that publish at once get their turns, as the module says; an empty df makes an empty stage. Columns of a later run must be those of the first.
    """
    spark, name = df.sparkSession, json.dumps([stage, version])
    fresh = stored(df.withColumn(INPUT, (F.lit(None) if input_hash is None else input_hash).cast("string")).dropDuplicates(key))
    shape = fresh.schema
    for _ in range(MOST_TRIES):
        number, manifest = _latest(spark, path)
        known = _rows(spark, path, manifest.get(name))
        entry = manifest.get(name) or {"schema": shape.jsonValue(), "n": slots, "slots": {}}
        new = fresh.withColumn("slot", _slot(key, entry["n"]))
        if known is not None:
            new = stored(new.join(known, _same(new, known, [*key, INPUT]), "left_anti"))
        counts = {r["slot"]: r["n"] for r in new.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        if known is not None and not counts:
            return 0
        rows = new
        if known is not None:
            held = _rows(spark, path, entry, counts)
            rows = new.unionByName(held.join(new, _same(held, new, key), "left_anti").withColumn("slot", _slot(key, entry["n"])))
        if _replace(spark, path, number, manifest, name, entry, rows, list(counts)):
            return sum(counts.values())
    raise RuntimeError(f"other runs published to {path} {MOST_TRIES} times meanwhile")


def read_stage(spark: SparkSession, path: str, stage: str, version: str) -> DataFrame:
    """The rows of a published stage, as the last manifest has them."""
    rows = _rows(spark, path, _latest(spark, path)[1].get(json.dumps([stage, version])))
    if rows is None:
        raise ValueError(f"{path} has no stage {stage} of version {version}")
    return rows.drop(INPUT)


def forget_published(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """Delete rows whose columns are in keys, from all stages and versions; how many. Only slots that hold such rows are rewritten, and files
    that no manifest names any more are deleted (see clean()), so the rows are gone from the folder too. Stages without these columns stay.
    """
    wanted, deleted = stored(keys.distinct()), 0
    for name in list(_latest(spark, path)[1]):
        for _ in range(MOST_TRIES):
            number, manifest = _latest(spark, path)
            entry = manifest[name]
            if not set(keys.columns) <= set(T.StructType.fromJson(entry["schema"]).names) or not entry["slots"]:
                break
            every = _rows(spark, path, entry).withColumn("slot", F.regexp_extract(F.col("_metadata.file_path"), r"/slot=([^/]+)/", 1))
            counts = {r["slot"]: r["n"] for r in every.join(wanted, _same(every, wanted, keys.columns), "left_semi").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not counts:
                break
            rest = _rows(spark, path, entry, counts).withColumn("slot", F.regexp_extract(F.col("_metadata.file_path"), r"/slot=([^/]+)/", 1))
            if _replace(spark, path, number, manifest, name, entry, rest.join(wanted, _same(rest, wanted, keys.columns), "left_anti"), list(counts)):
                deleted += sum(counts.values())
                break
        else:
            raise RuntimeError(f"other runs published to {path} {MOST_TRIES} times meanwhile")
    clean(spark, path)
    return deleted


def clean(spark: SparkSession, path: str) -> None:
    """Delete manifests but the last, and what it doesn't name of the runs. Not while others publish to the table or read what they began to read before."""
    number, manifest = _latest(spark, path)
    named = {f"run={run}/slot={slot}" for entry in manifest.values() for slot, run in entry["slots"].items()}
    runs = {name.split("/")[0] for name in named}
    system, place = files(spark, path)
    for run in system.listStatus(place):
        name = run.getPath().getName()
        if name.startswith("run=") and name not in runs:
            system.delete(run.getPath(), True)
        elif name in runs:
            for slot in system.listStatus(run.getPath()):
                if slot.isDirectory() and f"{name}/{slot.getPath().getName()}" not in named:
                    system.delete(slot.getPath(), True)
    for file in system.listStatus(files(spark, f"{path}/manifests")[1]):
        if file.getPath().getName() != f"{number:020d}.json":
            system.delete(file.getPath(), False)
