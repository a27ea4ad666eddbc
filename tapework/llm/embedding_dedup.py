"""Embedding near-dedup by a forest of random-projection trees.

In each tree, a node of too many vectors is split by their projections on a random direction, one for each tree and level; the
thresholds are quantiles of a sample of the node, and vectors between them go to both sides (spill), so that near ones are
rarely parted. Vectors are compared within leaves, in blocks, by cosine in double precision. A pair that meets in several
leaves is counted in the first of them only, so links are counted without writing out pairs; what leaves the leaf is each
vector's number of links and a spanning forest of them. The forests' union is followed to components.

Scale: trees grow round by round over a table of projections, some levels in each, and every node is sampled anew, so leaves
keep their size however many vectors there are. The spill shrinks with the depth, so a vector is in a bounded number of leaves
(about 3 of each tree). No tree goes to the driver: a row meets the thresholds of its own node.

Skew: equal vectors of a label are one row with a count before the trees see them. A node that no direction splits (nearly
equal vectors) is compared in pairs of blocks, each pair in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget
from .components import connected_components

TREES = 8
#: Rows that a leaf shall have about, and beyond which a node is split again.
LEAF_ROWS = 256
MOST_ROWS = 2 * LEAF_ROWS
#: Rows of a node's sample about, the least that a split is made on, and levels that are grown in a round.
SAMPLE = 1_024
LEAST_SAMPLE = 16
LEVELS = 5
#: Half of the share of a node's rows that go to both sides, at the root, and what becomes of it from level to level.
SPILL, SPILL_SHRINKS = 0.15, 0.75
MOST_LEVELS = 48
BLOCK = 1_024
NODE = ["label", "size", "tree", "path"]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_range(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor all vanish; cosines are the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _project(trees: int, levels: int):
    """A row for each vector and tree, at the tree's root, with the projections for all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes, data = batch.column("size").to_numpy(), batch.column("data").to_pylist()
            for size in np.unique(sizes).tolist():
                of, dim = np.flatnonzero(sizes == size), size // 8
                if size not in directions:
                    directions[size] = np.concatenate([np.random.default_rng([11, tree]).normal(size=(levels, dim)) for tree in range(trees)]).T
                p = _unit(np.frombuffer(b"".join(data[k] for k in of), "<f8").reshape(len(of), dim)) @ directions[size]
                rows = pa.array(np.repeat(of, trees))
                p = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * levels), pa.array(p.astype(np.float32).ravel()))
                own = [pa.array(np.tile(np.arange(trees, dtype=np.int32), len(of))), pa.array(np.ones(len(rows), np.int64)), p]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("rep", "label", "size")), *own], ["rep", "label", "size", "tree", "path", "p"])

    return run


def grow(p: np.ndarray, n: int, first: int, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """Thresholds (low, high) of a node's next levels, in the order of a heap; NaN where a leaf is.

    p: the sample's projections for all levels, n: the node's rows, first: its level.
    """
    out = np.full(2 * (2**LEVELS - 1), np.nan)

    def split(at: np.ndarray, heap: int, level: int) -> None:
        if n * len(at) / len(p) <= leaf_rows or len(at) < LEAST_SAMPLE or heap >= 2**LEVELS or level >= p.shape[1]:
            return
        spill = SPILL * SPILL_SHRINKS**level
        low, high = np.quantile(p[at, level], (0.5 - spill, 0.5 + spill))
        left, right = p[at, level] <= high, p[at, level] >= low
        if left.all() or right.all():  # nothing to tell apart
            return
        out[2 * heap - 2 : 2 * heap] = low, high
        split(at[left], 2 * heap, level + 1)
        split(at[right], 2 * heap + 1, level + 1)

    split(np.arange(len(p)), 1, first)
    return out


def _grow(leaf_rows: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *node, n = key
        thresholds = grow(np.stack(rows["p"].to_numpy()), int(n), int(node[-1]).bit_length() - 1, leaf_rows)
        return pd.DataFrame([[*node, thresholds]], columns=[*NODE, "thresholds"])

    return run


def descend(p: np.ndarray, thresholds: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) for every leaf that each row comes to from the node of its path."""
    level = np.frexp(path.astype(float))[1] - 1
    row, heap, depth, rows, paths = np.arange(len(p)), np.ones(len(p), np.int64), 0, [], []
    while len(row):
        low, high = (thresholds[row, 2 * heap - 2], thresholds[row, 2 * heap - 1]) if depth < LEVELS else (np.full(len(row), np.nan),) * 2
        leaf = np.isnan(low)
        rows.append(row[leaf])
        paths.append((path[row[leaf]] << depth) + heap[leaf] - (1 << depth))
        row, heap, low, high = row[~leaf], heap[~leaf], low[~leaf], high[~leaf]
        value = p[row, level[row] + depth] if len(row) else np.zeros(0)
        left, right = value <= high, value >= low
        row, heap, depth = np.concatenate([row[left], row[right]]), np.concatenate([2 * heap[left], 2 * heap[right] + 1]), depth + 1
    return np.concatenate(rows) if rows else row, np.concatenate(paths) if paths else heap


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            p, thresholds = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("p", "thresholds"))
            rows, paths = descend(p, thresholds, batch.column("path").to_numpy())
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("rep", "label", "size", "tree")), pa.array(paths), batch.column("p").take(at)], ["rep", "label", "size", "tree", "path", "p"])


def find_leaves(reps: DataFrame, trees: int) -> DataFrame:
    """rep, label, size and code: the leaves that each vector (rep, label, size, data) comes to. A label's vectors may be one leaf."""
    groups = cut(reps.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")))
    used = [groups]
    most = groups.agg(F.max("n")).first()[0] or 0
    whole = reps.join(groups, ["label", "size"])
    leaves = [whole.where(F.col("n") <= LEAF_ROWS).select("rep", "label", "size", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("path"))]
    if most > LEAF_ROWS:
        levels = min(MOST_LEVELS, int(np.ceil(np.log2(most / LEAF_ROWS))) * 2 + LEVELS)
        shape = f"rep long, label {reps.schema['label'].dataType.simpleString()}, size int, tree int, path long, p array<float>"
        rows = cut(whole.where(F.col("n") > LEAF_ROWS).select("rep", "label", "size", "data").mapInArrow(_project(trees, levels), shape))
        bound = LEAF_ROWS
        while True:
            used.append(rows)
            big = cut(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound))
            if big.isEmpty():
                leaves.append(rows.select("rep", *NODE))
                break
            used.append(big)
            counted = rows.join(big, NODE, "left")
            leaves.append(counted.where("n is null").select("rep", *NODE))
            open_ = counted.where("n is not null")
            sample = open_.where(F.pmod(F.xxhash64("rep", "tree", "path"), F.lit(1 << 30)) < F.lit((1 << 30) * SAMPLE) / F.col("n"))
            grown = cut(sample.groupBy(*NODE, "n").applyInPandas(_grow(LEAF_ROWS), ", ".join(f"{c} {reps.schema[c].dataType.simpleString() if c == 'label' else 'long' if c == 'path' else 'int'}" for c in NODE) + ", thresholds array<double>"))
            used.append(grown)
            met = open_.join(grown, NODE, "left")
            first = F.get("thresholds", F.lit(0))  # a node that isn't split has none
            split = first.isNotNull() & ~F.isnan(F.coalesce(first, F.lit(0.0)))
            leaves.append(met.where(~split).select("rep", *NODE))
            rows, bound = cut(met.where(split).select("rep", *NODE, "p", "thresholds").mapInArrow(_descend, shape)), MOST_ROWS
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    out = cut(out.select("rep", "label", "size", F.xxhash64("tree", "path").alias("code")))
    for table in used:
        forget(table)
    return out


def _compare(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        code, first_block, last_block = (int(k) for k in key[-3:])
        n, blocks = len(rows), rows["block"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(rows["data"]), "<f8").reshape(n, -1)
        norms, copies, reps = np.linalg.norm(x, axis=1), rows["copies"].to_numpy(np.int64), rows["rep"].to_numpy(np.int64)
        width = max(map(len, rows["codes"]))
        codes = np.full((n, width), -1, np.int64)
        held = np.zeros((n, width), bool)
        for k, c in enumerate(rows["codes"]):
            codes[k, : len(c)], held[k, : len(c)] = c, True
        counted, linked = np.zeros(n, np.int64), np.zeros(n, bool)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            hit = (x[a] @ x[b].T) / (norms[a][:, None] * norms[b][None, :]) >= least
            # Two blocks meet here for the pairs between them; those within a block meet elsewhere.
            return hit if first_block == last_block else hit & (blocks[a][:, None] != blocks[b][None, :])

        every = np.arange(n)
        for at in range(0, n, BLOCK):
            for to in range(at, n, BLOCK):
                hit = near(every[at : at + BLOCK], every[to : to + BLOCK])
                i, j = np.nonzero(np.triu(hit, 1) if at == to else hit)
                i, j = i + at, j + to
                linked[i] = linked[j] = True
                first = np.zeros(len(i), np.int64)  # the smallest code that both have
                open_ = np.ones(len(i), bool)
                for k in range(width):
                    mine = codes[i, k]
                    shared = open_ & held[i, k] & ((codes[j] == mine[:, None]) & held[j]).any(axis=1)
                    first[shared], open_[shared] = mine[shared], False
                here = ~open_ & (first == code)
                np.add.at(counted, i[here], copies[j[here]])
                np.add.at(counted, j[here], copies[i[here]])
        parent = np.full(n, -1, np.int64)
        open_ = linked.copy()
        while open_.any():
            front = np.flatnonzero(open_)[:1]
            open_[front] = False
            while len(front):
                reached = []
                for at in range(0, len(front), BLOCK):
                    part, rest = front[at : at + BLOCK], np.flatnonzero(open_)
                    for to in range(0, len(rest), BLOCK):
                        cols = rest[to : to + BLOCK]
                        hit = near(part, cols)
                        found = hit.any(axis=0)
                        parent[cols[found]] = part[hit[:, found].argmax(axis=0)]
                        open_[cols[found]] = False
                        reached.append(cols[found])
                front = np.concatenate(reached) if reached else np.zeros(0, np.int64)
        out = pd.DataFrame({"rep": reps, "links": counted, "other": np.where(parent >= 0, reps[parent], reps)})
        return out[(out["links"] > 0) | (out["other"] != out["rep"])]

    return run


def _meetings(reps: DataFrame, trees: int) -> DataFrame:
    """A row for each vector and each place where it is compared: a leaf, or of a leaf of too many rows a pair of blocks."""
    leaves = find_leaves(reps, trees)
    wide = leaves.groupBy("label", "size", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS)
    blocks = F.coalesce(F.ceil(F.col("n") / MOST_ROWS), F.lit(1)).cast("int")
    placed = leaves.join(wide, ["label", "size", "code"], "left").select("rep", F.struct("code", blocks.alias("blocks")).alias("place"))
    places = placed.groupBy("rep").agg(F.sort_array(F.collect_list("place")).alias("places"))  # some for each tree
    each = reps.select("rep", "label", "size", "copies", "data").join(places, "rep").select("*", F.col("places.code").alias("codes"), F.explode("places").alias("place"))
    each = each.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("place.blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("place.blocks") - 1)))
    return each.select("rep", "label", "size", "copies", "data", "codes", "block", F.col("place.code").alias("code"), F.least("block", "other").alias("first_block"), F.greatest("block", "other").alias("last_block"))


def embedding_dedup(vectors: DataFrame, least: float = 0.98, trees: int = TREES) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id reachable) and kept, for each row.

    vectors: vec_id, embedding and label. Rows are linked if their labels are equal and not null, their vectors are of as many
    components, and the cosine in double precision is at least `least`. Vectors that are null, zero or hold null or
    non-finite components link with nothing, not even with copies. Equal vectors of a label are linked, repeated rows
    too. Huge and tiny components count like any others. kept: vec_id is component_id. A null vec_id never names a component
    and is not kept. Other columns don't matter, whatever they are named. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding", "label")
    whole = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    nonzero = F.exists("embedding", lambda x: x != 0)
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(nonzero, F.lit(False))
    marked = vectors.select("vec_id", "label", F.when(good, whole).alias("v"))
    marked = marked.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1), "label"))})
    groups = marked.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = groups.withColumn("rep", F.monotonically_increasing_id())

    def to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_in_range(np.array([v], "<f8"))[0].tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(data, pa.binary())], [*names, "data"])

    names = ["rep", "k1", "k2", "least_id", "copies", "label"]
    label_type = vectors.schema["label"].dataType.simpleString()
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    reps = cut(groups.select(*names, "v").mapInArrow(to_binary, f"rep long, k1 long, k2 long, least_id {id_type}, copies long, label {label_type}, data binary").withColumn("size", F.length("data")))

    found = cut(_meetings(reps, trees).groupBy("label", "size", "code", "first_block", "last_block").applyInPandas(_compare(least), "rep long, links long, other long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("rep <> other"), "rep", "other").withColumnRenamed("node", "rep")
    named = reps.select("rep", "k1", "k2", "least_id", "copies").join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("smallest_id"))
    named = named.join(smallest, "component").join(links, "rep", "left")
    named = named.select("k1", "k2", "smallest_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.select("vec_id", "k1", "k2").join(cut(named), ["k1", "k2"], "left")
    component = F.coalesce("smallest_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at a cosine of 0.98 within their label."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


#: The same rows in DuckDB, for tables of up to some thousand rows: it compares all pairs of a label.
OP6_SQL = r"""
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
), usable AS (
  SELECT * FROM good WHERE v IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.row AS a, b.row AS b, b.vec_id AS other FROM usable AS a JOIN usable AS b
    ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v)
   AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reach AS (
  SELECT row, row AS at FROM good
  UNION
  SELECT reach.row, links.b FROM reach JOIN links ON reach.at = links.a
), smallest AS (
  SELECT reach.row, min(good.vec_id) AS component_id FROM reach JOIN good ON reach.at = good.row GROUP BY reach.row
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = good.row) AS n_links, component_id, vec_id = component_id AS kept
FROM good JOIN smallest USING (row)
"""
