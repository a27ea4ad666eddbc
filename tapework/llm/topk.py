"""Exact top-k search by inner product with a pivot table.

Every vector's distances to many pivots are computed once and written beside it. By the triangle inequality the largest
difference between a query's and a vector's distances to a pivot is a lower bound of their distance, hence an upper bound of
their inner product.

Bounds eliminate twice. Vectors are dealt to blocks in the order of their nearest pivot and the distance to it, and queries
likewise; a block's ranges of distances bound all of its vectors at once, and a query goes only to blocks whose bound reaches
its first threshold, the k-th best score in a sample. Vectors meet only the query blocks that sent them a query. Within a
block a query evaluates candidates in the order of their bounds and stops when the next bound is below its k-th best
score so far. Only the best k of each meeting are shuffled on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget

PIVOTS = 32
#: Vectors that pivots and the first thresholds are taken from.
SAMPLE = 2_048
#: Vectors and queries of a block about, and candidates that are evaluated at once.
BLOCK = 8_192
QUERY_BLOCK = 4_096
CHUNK = 64
#: Blocks whose ranges a task compares with a block of queries.
RANGES = 256


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors of the sample that are far from each other, one after the other."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(pivots: dict[int, np.ndarray], samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds the distances, the nearest pivot and its distance, the squared norm, and of queries the first threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, dims, rows = batch.column("whole").to_pylist(), batch.column("dim").to_pylist(), batch.column("row").to_pylist()
            data, out, cells, near, norms, first = [], [], [], [], [], []
            for v, d, row, asks in zip(whole, dims, rows, batch.column("is_query").to_pylist(), strict=True):
                x = np.array(v, "<i8")
                far = np.linalg.norm(pivots[d] - x, axis=1) if d in pivots else np.zeros(0)
                data.append(x.tobytes())
                out.append(far.tobytes())
                cells.append(int(far.argmin()) if len(far) else -1)
                near.append(float(far.min()) if len(far) else 0.0)
                norms.append(float((x.astype(float) ** 2).sum()))
                sample_rows, sample = samples.get(d, (np.zeros(0, np.int64), np.zeros((0, d), np.int64)))
                # k vectors of the sample reach this, so nothing below it can be among the best.
                first.append(_kth(_dot(sample[sample_rows != row], x), k) if asks else 0.0)
            own = [pa.array(data, pa.binary()), pa.array(out, pa.binary()), pa.array(cells, pa.int32()), *(pa.array(c, pa.float64()) for c in (near, norms, first))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "dim", "is_query")), *own], ["row", "vec_id", "dim", "is_query", "data", "distances", "cell", "near", "norm", "first"])

    return run


def _matrix(column: pd.Series, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(n, -1)


def _dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integers."""
    high = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * max(1, int(np.abs(query).max(initial=0))) * max(1, len(query))
    if high < 2**62:
        return rows @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows], object)


def _kth(scores: np.ndarray, k: int) -> float:
    return -np.inf if len(scores) < k else float(np.partition(scores.astype(float), len(scores) - k)[len(scores) - k])


def _bound(query_norms: np.ndarray, norms: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The most that inner products can be, by squared norms and a lower bound of the distance; with room for rounding."""
    bound = (query_norms + norms - apart**2) / 2
    return bound + 1e-6 * (1 + np.abs(query_norms) + np.abs(norms))


def _range_of_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    d = _matrix(rows["distances"], "<f8", len(rows))
    low, high = (f(axis=0) if d.shape[1] else np.zeros(0) for f in (d.min, d.max)) if len(rows) else (np.zeros(0),) * 2
    return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "low": [low.tobytes()], "high": [high.tobytes()], "norm": [rows["norm"].max()]})


def _route(queries: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    """The blocks that each query has to go to."""
    if not len(queries) or not len(ranges):
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("row", "query_block", "block")})
    d, low, high = _matrix(queries["distances"], "<f8", len(queries)), _matrix(ranges["low"], "<f8", len(ranges)), _matrix(ranges["high"], "<f8", len(ranges))
    out, norms, first = [], queries["norm"].to_numpy(), queries["first"].to_numpy()
    for at, (lo, hi, norm) in enumerate(zip(low, high, ranges["norm"].to_numpy(), strict=True)):
        apart = np.maximum(d - hi, lo - d).max(axis=1, initial=0)
        out.append((np.flatnonzero(_bound(norms, norm, apart) >= first), at))
    asked = np.concatenate([q for q, _ in out])
    block = np.repeat(ranges["block"].to_numpy(), [len(q) for q, _ in out])
    return pd.DataFrame({"row": queries["row"].to_numpy()[asked], "query_block": queries["query_block"].iloc[0], "block": block}).astype("int64")


def _search(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(block):
            q, x = _matrix(queries["data"], "<i8", len(queries)), _matrix(block["data"], "<i8", len(block))
            dq, dx = _matrix(queries["distances"], "<f8", len(queries)), _matrix(block["distances"], "<f8", len(block))
            ids, rows, norms = block["vec_id"].to_numpy(), block["row"].to_numpy(), block["norm"].to_numpy()
            for n in range(len(q)):
                own, best = queries["row"].iloc[n], queries["first"].iloc[n]
                bound = _bound(queries["norm"].iloc[n], norms, np.abs(dx - dq[n]).max(axis=1, initial=0))
                order = np.flatnonzero((bound >= best) & (rows != own))
                order = order[np.argsort(-bound[order], kind="stable")]
                got_at, got = [], []
                for at in range(0, len(order), CHUNK):
                    if bound[order[at]] < best:
                        break
                    part = order[at : at + CHUNK]
                    got_at.append(part)
                    got.append(_dot(x[part], q[n]))
                    best = max(best, _kth(np.concatenate(got), k))
                if got:
                    at, scores = np.concatenate(got_at), np.concatenate(got)
                    top = np.lexsort((ids[at], -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k])
                    if any(abs(int(s)) >= 2**63 for s in scores[top]):
                        raise OverflowError(f"a score of vector {queries['vec_id'].iloc[n]} doesn't fit 64 bits")
                    out["query_row"] += [own] * len(top)
                    out["query_id"] += [queries["vec_id"].iloc[n]] * len(top)
                    out["vec_id"] += ids[at[top]].tolist()
                    out["score"] += [int(s) for s in scores[top]]
        return pd.DataFrame(out).astype({"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


def usable(vector: str) -> Column:
    """True for vectors that are there and have finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of each query, by integer inner product, ties to the smaller vec_id.

    vectors: vec_id and embedding; each component x becomes floor(scale * x), x as double. Candidates of a query are all rows
    but its own; rows that repeat a vec_id are candidates, and queries, of their own. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part. Vectors meet only vectors of as many components.
    A query with fewer candidates returns all. A component or one of the best scores that doesn't fit 64 bits raises an error.
    Other columns don't matter, whatever they are named. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    clean = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    too_large = F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long")
    whole = F.transform("embedding", lambda x: F.when(F.abs(F.lit(scale) * x.cast("double")) < 2.0**63, F.floor(F.lit(scale) * x.cast("double"))).otherwise(too_large))
    rows = clean.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"), whole.alias("whole"))
    rows = cut(rows)
    sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("row", "dim", "whole").collect()
    samples = {}
    for dim in {r["dim"] for r in sample}:
        of = [r for r in sample if r["dim"] == dim]
        samples[dim] = (np.array([r["row"] for r in of], np.int64), np.array([r["whole"] for r in of], np.int64).reshape(len(of), dim))
    chosen = {d: choose_pivots(x.astype(float), pivots) for d, (_, x) in samples.items()}
    shape = "row long, vec_id long, dim int, is_query boolean, data binary, distances binary, cell int, near double, norm double, first double"
    # A dimension that the sample lacks has no pivots, so its vectors are bounded by their norms alone.
    table = cut(rows.mapInArrow(_distances(chosen, samples, k), shape))
    forget(rows)
    placed, asking = _dealt(table, BLOCK, "block"), _filled(_dealt(table.where("is_query"), QUERY_BLOCK, "query_block"), QUERY_BLOCK, "query_block")
    forget(table)
    routed = cut(_routes(placed, asking))
    queries = asking.join(routed, ["row", "query_block"])
    wanted = routed.join(asking.select("row", "dim"), "row").select("block", "query_block", "dim").distinct()
    by = ["block", "query_block", "dim"]
    met = queries.groupBy(*by).cogroup(placed.join(wanted, ["block", "dim"]).groupBy(*by)).applyInPandas(_search(k), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(table: DataFrame, rows: int, name: str) -> DataFrame:
    """The table in blocks of about so many rows of one dimension that are near to each other: what shares a partition shares a block."""
    n = max(1, -(-table.count() // rows))
    dealt = table.repartitionByRange(n, "dim", "cell", "near", "row").withColumn(name, F.spark_partition_id().cast("long"))
    return cut(dealt.select(name, "row", "vec_id", "dim", "data", "distances", "norm", "first"))


def _filled(dealt: DataFrame, rows: int, name: str) -> DataFrame:
    """The same with neighbouring blocks as one until it is full, as a session may deal rows out more finely than asked."""
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    sizes = dealt.groupBy(F.col(name).alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.floor(F.coalesce(before, F.lit(0)) / rows).alias("_block"))
    filled = cut(dealt.join(sizes, F.col(name) == F.col("_part")).withColumn(name, F.col("_block")).drop("_part", "_block"))
    forget(dealt)
    return filled


def _routes(placed: DataFrame, asking: DataFrame) -> DataFrame:
    """row, query_block and block: the blocks that a query's bound doesn't rule out. Ranges of blocks meet queries some at a time."""
    ranges = cut(placed.select("block", "dim", "distances", "norm").groupBy("block", "dim").applyInPandas(_range_of_block, "block long, dim int, low binary, high binary, norm double"))
    some = F.floor(F.col("block") / RANGES).alias("some")
    meet = cut(asking.select("query_block", "dim").distinct().join(ranges.select(some, "dim").distinct(), "dim"))
    left = asking.select("query_block", "row", "dim", "distances", "norm", "first").join(meet, ["query_block", "dim"])
    right = ranges.select(some, "block", "dim", "low", "high", "norm").join(meet, ["some", "dim"])
    by = ["query_block", "some", "dim"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_route, "row long, query_block long, block long")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of every embedding whose vec_id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


#: The same rows in DuckDB.
OP9_SQL = r"""
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole AS q JOIN whole AS c ON q.row <> c.row AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
