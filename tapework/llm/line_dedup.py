"""Line dedup: lines found in many documents lose every occurrence.

Every document's distinct line keys are written once as 128-bit hashes. Their counts fill a sharded index:
a shard has a minimal perfect hash over its distinct keys, a 32-bit fingerprint array and a count array.
Documents probe the shards with the hashes of their lines; lines themselves are never joined.

Skew: a key in more than one of HOT_SHARE probes is hot. As the counts add up to the number of probes there are
at most HOT_SHARE hot keys. They have a shard of the same form of their own, which goes to every task and is probed there with
the lines of whole texts; the other keys are probed where their shard is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, cut, some_at_a_time, text_or_empty, unused, without
from .mph import MinimalPerfectHash, fingerprints

KEYS_PER_SHARD = 32_768
LEAST_SHARDS = 64
HOT_SHARE = 65_536
#: A key in so few probes doesn't make a shard uneven, however few probes there are.
LEAST_HOT = 4_096


def line_key(line: bytes) -> bytes:
    """A line's key: blanks stripped at both ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> np.ndarray:
    """Both halves of 128-bit hashes."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in some_at_a_time(batch.column("text")):
                counts, digests = [], []
                for text in texts.cast(pa.binary()).to_pylist():
                    keys = [k for k in {line_key(x) for x in text.split(b"\n")} if _long_enough(k, min_chars)]
                    digests += map(_hash, keys)
                    counts.append(len(keys))
                rows, h = pa.array(row + np.repeat(np.arange(len(counts)), counts)), _halves(digests)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "text_hash", "high", "low"])

    return run


class CountIndex:
    """Counts by line hash: minimal perfect hash, fingerprint array and count array."""

    def __init__(self, mph: MinimalPerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.mph, self.prints, self.counts = mph, prints, counts

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> CountIndex:
        high, low = high.astype(np.int64).view(np.uint64), low.astype(np.int64).view(np.uint64)
        mph = MinimalPerfectHash.build(high, low)
        at = mph.lookup(high, low)
        prints, counts = np.zeros(len(high), np.uint32), np.zeros(len(high), np.uint32)
        prints[at], counts[at] = fingerprints(high, low), np.minimum(n, 2**32 - 1)
        return cls(mph, prints, counts)

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where it is not indexed."""
        if not len(high) or not self.mph.n:
            return np.zeros(len(high), np.int64)
        high, low = high.astype(np.int64).view(np.uint64), low.astype(np.int64).view(np.uint64)
        at = self.mph.lookup(high, low)
        known = (at >= 0) & (self.prints[at] == fingerprints(high, low))
        return np.where(known, self.counts[at].astype(np.int64), 0)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    index = CountIndex.build(rows["high"].to_numpy(), rows["low"].to_numpy(), rows["n"].to_numpy())
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "mph": [index.mph.to_bytes()], "prints": [index.prints.tobytes()], "counts": [index.counts.tobytes()]})


def _probe_shard(min_docs: int):
    def run(probes: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(shards):
            return probes.iloc[:0][["doc_id", "text_hash"]].assign(hit=pd.Series([], dtype=object))
        row = shards.iloc[0]
        index = CountIndex(MinimalPerfectHash.from_bytes(row["mph"]), np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32))
        high, low = probes["high"].to_numpy(np.int64), probes["low"].to_numpy(np.int64)
        often = index.count(high, low) >= min_docs
        return probes.loc[often, ["doc_id", "text_hash"]].assign(hit=[h.tobytes() for h in np.stack([high, low], axis=1)[often].astype("<i8")])

    return run


def _drop_lines(min_docs: int, min_chars: int, hot: Broadcast):
    """A column function: kept_text, n_lines and n_dropped of a text and the hits that the shards had for it."""

    @F.arrow_udf("kept_text string, n_lines long, n_dropped long")
    def drop(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        mph, prints, counts = hot.value
        index = CountIndex(MinimalPerfectHash.from_bytes(mph), np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32))

        def answer(texts: pa.Array, found: pa.Array) -> pa.Array:
            lines = [t.split(b"\n") for t in texts.cast(pa.binary()).to_pylist()]
            digests = [_hash(k) if _long_enough(k := line_key(x), min_chars) else None for of in lines for x in of]
            asked = [d for d in digests if d is not None]
            often = iter((index.count(*_halves(asked).T) >= min_docs).tolist())
            kept, n_dropped, at = [], [], 0
            for of, hits in zip(lines, found.to_pylist(), strict=True):
                hits = set(hits or ())
                # The hot shard is asked for every line, whatever the other shards say.
                left = [x for x, d in zip(of, digests[at : at + len(of)], strict=True) if d is None or not (next(often) | (d in hits))]
                at += len(of)
                n_dropped.append(len(of) - len(left))
                kept.append(b"\n".join(left))
            fields = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(of) for of in lines], pa.int64()), pa.array(n_dropped, pa.int64())]
            return pa.StructArray.from_arrays(fields, ["kept_text", "n_lines", "n_dropped"])

        for texts, found in batches:
            parts = [answer(part, found.slice(row, len(part))) for row, part in some_at_a_time(texts)]
            yield pa.concat_arrays(parts) if parts else answer(texts, found)

    return drop.asNondeterministic()


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with kept_text, n_lines (before dropping) and n_dropped.

    A text is split at line feeds; a null or empty text is one empty line. A line's key is the line without blanks at its
    ends, A-Z in lower case. Keys of at least min_chars code points that at least min_docs documents (rows; a repeated
    row counts again) hold lose all their lines in every document. Other lines stay as they are, joined by line feeds.
    Columns of docs that are named like an output column are replaced, all others stay; doc_id may be null. A very long text
    is a row like any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = without(docs, "kept_text", "n_lines", "n_dropped")
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lines = cut(keyed.mapInArrow(_line_keys(min_chars), f"doc_id {id_type}, text_hash long, high long, low long"))
    counts = cut(lines.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")))
    total = lines.count()
    hot_over = max(total // HOT_SHARE, LEAST_HOT)
    hot = counts.where(F.col("n") > hot_over).toPandas()  # at most HOT_SHARE rows
    hot_index = CountIndex.build(hot["high"].to_numpy(), hot["low"].to_numpy(), hot["n"].to_numpy())
    hot_shard = spark.sparkContext.broadcast((hot_index.mph.to_bytes(), hot_index.prints.tobytes(), hot_index.counts.tobytes()))

    n_shards = max(LEAST_SHARDS, -(-total // KEYS_PER_SHARD))
    shard = F.pmod(F.col("high"), F.lit(n_shards)).alias("shard")
    index = counts.where(F.col("n") <= hot_over).select(shard, "high", "low", "n").groupBy("shard").applyInPandas(_build_shard, "shard long, mph binary, prints binary, counts binary")
    probes = lines.select(shard, "doc_id", "text_hash", "high", "low")
    if len(hot):
        probes = probes.join(F.broadcast(spark.createDataFrame(hot[["high", "low"]], "high long, low long")), ["high", "low"], "left_anti").select("shard", "doc_id", "text_hash", "high", "low")
    hits = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe_shard(min_docs), f"doc_id {id_type}, text_hash long, hit binary")
    hit_id, hit_hash, found, out = (unused(docs, c) for c in ("hit_doc_id", "hit_text_hash", "line_hits", "line_answer"))
    by_doc = hits.groupBy(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash)).agg(F.collect_set("hit").alias(found))

    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64(text_or_empty()) == F.col(hit_hash)), "left")
    answered = joined.withColumn(out, _drop_lines(min_docs, min_chars, hot_shard)(text_or_empty(), F.col(found)))
    return answered.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(out)[c].alias(c) for c in ("kept_text", "n_lines", "n_dropped")])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in at least 10 documents go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = line_dedup(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rn) >= 10
), marked AS (
  SELECT keyed.*, often.k IS NOT NULL AS dropped FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rn
"""
