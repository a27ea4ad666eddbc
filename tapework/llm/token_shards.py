"""Token ids in shards with keyed access: minimal perfect hashes take a document's key to its shard, and to its place there.

Format: a table of shards in ascending order of doc_id, and an index over all keys. A key is a doc_id and the number of
earlier documents with that doc_id, so repeated doc_ids are kept apart.

A shard holds the raw ids of its documents one after the other (payload: unsigned, little-endian, 16 bits where the
vocabulary allows and else 32). By the number that its hash gives a key (of a doc_id and the earlier ones in the shard) it holds
the key's 32-bit fingerprint, its first id and its number of ids. doc_ids lists its documents in order.

The index is dealt out to buckets by a hash of the key. By the number that a bucket's hash gives a key it holds the key's
fingerprint, shard, and number among the equal doc_ids of the shard. So a key is found by reading one bucket and one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, some_at_a_time, text_or_empty, total_before
from .mph import MinimalPerfectHash, fingerprints
from .tokens import encoder

#: Ids after which a shard ends, and keys of a bucket of the index.
IDS_PER_SHARD = 4_000_000
KEYS_PER_BUCKET = 32_768
SHARD_SCHEMA = "shard long, part long, n_ids long, n_docs long, id_bytes int, doc_ids array<bigint>, mph binary, prints binary, starts binary, counts binary, payload binary"
_NULL_KEY = np.uint64(0xD1B54A32D192ED03)


def _halves(doc_ids: np.ndarray, null: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of keys."""
    return np.where(null, 0, doc_ids).astype(np.int64).view(np.uint64), earlier.astype(np.uint64) ^ np.where(null, _NULL_KEY, np.uint64(0))


def _own_keys(doc_ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the keys of a shard's documents, and how many earlier ones in the shard have the same doc_id."""
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    values = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    same = np.concatenate([[False], (values[1:] == values[:-1]) & (null[1:] == null[:-1])])[: len(values)]
    earlier = np.arange(len(values)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(values))))
    return *_halves(values, null, earlier), earlier


class KeyTable:
    """A minimal perfect hash over keys with their fingerprints."""

    def __init__(self, mph: bytes, prints: bytes):
        self.mph, self.prints = MinimalPerfectHash.from_bytes(mph), np.frombuffer(prints, "<u4")

    @staticmethod
    def build(high: np.ndarray, low: np.ndarray, *values: np.ndarray) -> list[bytes]:
        """The table's two parts, and each of values in the order of the keys' numbers."""
        mph = MinimalPerfectHash.build(high, low)
        at, out = mph.lookup(high, low), []
        for v in (fingerprints(high, low), *values):
            placed = np.empty_like(v)
            placed[at] = v
            out.append(placed.tobytes())
        return [mph.to_bytes(), *out]

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that the table doesn't have."""
        if not len(self.prints):
            return np.full(len(high), -1)
        at = self.mph.lookup(high, low)
        return np.where((at >= 0) & (self.prints[at] == fingerprints(high, low)), at, -1)


class TokenShard:
    """One shard, with access by key in constant time."""

    def __init__(self, id_bytes: int, mph: bytes, prints: bytes, starts: bytes, counts: bytes, payload: bytes):
        self.keys = KeyTable(mph, prints)
        self.starts, self.counts = np.frombuffer(starts, "<i8"), np.frombuffer(counts, "<i8")
        self.payload = np.frombuffer(payload, "<u2" if id_bytes == 2 else "<u4")

    def ids(self, doc_id: int | None, earlier: int = 0) -> np.ndarray | None:
        """The ids of the document with so many earlier ones of its doc_id in the shard, or None."""
        at = int(self.keys.find(*_halves(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([earlier])))[0])
        return None if at < 0 else self.payload[int(self.starts[at]) : int(self.starts[at] + self.counts[at])]


def _shard_row(part: int, number: int, doc_ids: list[pa.Array], ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    keys, n, payload = pa.concat_arrays(doc_ids), np.concatenate(counts), np.concatenate(ids)
    high, low, _ = _own_keys(keys)
    table = KeyTable.build(high, low, np.cumsum(n) - n, n)
    values = [[(part << 32) + number], [part], [len(payload)], [len(keys)], [payload.itemsize], [keys], *[[x] for x in table], [payload.tobytes()]]
    types = [*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [c.strip().split(" ")[0] for c in SHARD_SCHEMA.split(",")])


def _write_shards(vocabulary: str, end_id: int, ids_per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids, ids, counts, held = [], [], [], 0
        for batch in batches:
            for row, texts in some_at_a_time(batch.column("text")):
                flat, starts = encode.with_end(texts, end_id)
                at = 0
                while at < len(texts):
                    # Documents up to the one with which the shard is full.
                    end = min(len(texts), int(np.searchsorted(starts, starts[at] + ids_per_shard - held)))
                    doc_ids.append(batch.column("doc_id").slice(row + at, end - at))
                    ids.append(flat[starts[at] : starts[end]])
                    counts.append(np.diff(starts[at : end + 1]))
                    held, at = held + len(ids[-1]), end
                    if held >= ids_per_shard:
                        yield _shard_row(part, number, doc_ids, ids, counts)
                        doc_ids, ids, counts, held, number = [], [], [], 0, number + 1
        if held:
            yield _shard_row(part, number, doc_ids, ids, counts)

    return run


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None, ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """Encode whole texts and write them as shards, in ascending doc_id order; shard numbers ascend with doc_id.

    Ids are those of the vocabulary file by the tokenizers library, without special tokens, and end_id at the end of each
    document; a null text is an empty one and so has end_id alone. Rows without doc_id come last; rows of equal doc_id
    follow each other in the order of a hash of the text, over as many shards as they need. doc_id is of an integer
    type, else ValueError. Other columns don't matter, whatever they are named. A very long text is encoded whole and is in
    one shard, which it makes longer. An empty table gives no shards. path: where the table goes; by default the cluster's
    shared folder.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be of an integer type")
    # Equal rows are told apart by where they were read, so that many of them are dealt to many tasks.
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumns({"tie": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("spread")]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(dealt.mapInArrow(_write_shards(vocabulary, end_id, ids_per_shard), SHARD_SCHEMA), path)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids = batch.column("doc_ids")[row].values
            shard = TokenShard(batch.column("id_bytes")[row].as_py(), *(batch.column(c)[row].as_py() for c in ("mph", "prints", "starts", "counts", "payload")))
            high, low, earlier = _own_keys(doc_ids)
            at = shard.keys.find(high, low)
            starts, counts = shard.starts[at], shard.counts[at]
            words = memoryview(shard.payload.astype("<u4")).cast("B")
            crcs = [zlib.crc32(words[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            number = pa.array(np.full(len(at), batch.column("shard")[row].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([number, doc_ids, *(pa.array(v, pa.int64()) for v in (earlier, starts, counts, crcs))], ["shard", "doc_id", "in_shard", "start_in_shard", "n_tokens", "ids_crc32"])


def _keys(shards: DataFrame) -> DataFrame:
    """doc_id, earlier, shard and in_shard (the earlier ones of the doc_id in the shard) of every document."""
    # Only a shard's first and last doc_id can be of other shards as well.
    ends = shards.select("shard", "part", "doc_ids", F.explode(F.array_distinct(F.array(F.get("doc_ids", F.lit(0)), F.get("doc_ids", F.col("n_docs").cast("int") - 1)))).alias("doc_id"))
    runs = ends.select("shard", "part", "doc_id", F.size(F.filter("doc_ids", lambda x: x.eqNullSafe(F.col("doc_id")))).cast("long").alias("n"))
    runs = total_before(runs, "n", "before", ["doc_id"], "part", "shard").where("before > 0").select(F.col("shard").alias("_shard"), F.col("doc_id").alias("_doc_id"), "before")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].values
                n = pa.array(np.full(len(doc_ids), batch.column("shard")[row].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([n, doc_ids, pa.array(_own_keys(doc_ids)[2], pa.int64())], ["shard", "doc_id", "in_shard"])

    own = shards.select("shard", "doc_ids").mapInArrow(number, "shard long, doc_id long, in_shard long")
    joined = own.join(runs, (own["shard"] == runs["_shard"]) & own["doc_id"].eqNullSafe(runs["_doc_id"]), "left")
    return joined.select("doc_id", (F.col("in_shard") + F.coalesce("before", F.lit(0))).alias("earlier"), "shard", "in_shard")


def _asked(n: int) -> list[Column]:
    """A key's bucket, and the key without nulls."""
    doc_id, earlier = F.col("doc_id").cast("long"), F.col("earlier").cast("long")
    return [F.pmod(F.xxhash64(doc_id, earlier), F.lit(n)).cast("long").alias("bucket"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), earlier.alias("earlier")]


def _frame_halves(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _halves(rows["doc_id"].to_numpy(np.int64), rows["no_id"].to_numpy(bool), rows["earlier"].to_numpy(np.int64))


def write_index(shards: DataFrame, path: str | None = None) -> DataFrame:
    """The index over the keys of all shards: a row for each bucket; n_buckets is the same in all of them."""
    n = max(1, -(-(shards.agg(F.sum("n_docs")).first()[0] or 0) // KEYS_PER_BUCKET))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        table = KeyTable.build(*_frame_halves(rows), rows["shard"].to_numpy("<i8"), rows["in_shard"].to_numpy("<i8"))
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "n_buckets": [n], **{k: [v] for k, v in zip(("mph", "prints", "shards", "in_shards"), table, strict=True)}})

    keyed = _keys(shards).select(*_asked(n), "shard", "in_shard")
    return cut(keyed.groupBy("bucket").applyInPandas(build, "bucket long, n_buckets long, mph binary, prints binary, shards binary, in_shards binary"), path)


def locate(index: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (doc_id, earlier) that the index has, with shard and in_shard."""
    some = index.select("n_buckets").first()
    n = some[0] if some else 1

    def probe(asked: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        asked = asked[["doc_id", "no_id", "earlier"]]
        if not len(asked) or not len(bucket):
            return asked.iloc[:0].assign(shard=0, in_shard=0)
        row = bucket.iloc[0]
        at = KeyTable(row["mph"], row["prints"]).find(*_frame_halves(asked))
        return asked.assign(shard=np.frombuffer(row["shards"], "<i8")[at], in_shard=np.frombuffer(row["in_shards"], "<i8")[at])[at >= 0]

    found = keys.select(*_asked(n)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, "doc_id long, no_id boolean, earlier long, shard long, in_shard long")
    return found.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "earlier", "shard", "in_shard")


def lookup(shards: DataFrame, index: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, earlier and ids (bytes) of the keys (doc_id, earlier) that there are, by one bucket and one shard for each."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = TokenShard(batch.column("id_bytes")[row].as_py(), *(batch.column(c)[row].as_py() for c in ("mph", "prints", "starts", "counts", "payload")))
                asked = batch.column("asked")[row].as_py()
                ids = [shard.ids(a["doc_id"], a["in_shard"]).tobytes() for a in asked]
                yield pa.RecordBatch.from_arrays([pa.array([a["doc_id"] for a in asked], pa.int64()), pa.array([a["earlier"] for a in asked], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "earlier", "ids"])

    # A shard's documents are bounded, and so is what is asked of it at once.
    asked = locate(index, keys.select("doc_id", "earlier").distinct()).groupBy("shard").agg(F.collect_list(F.struct("doc_id", "earlier", "in_shard")).alias("asked"))
    return shards.join(asked, "shard").mapInArrow(take, "doc_id long, earlier long, ids binary")


def read_shards(shards: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, earlier, shard, start (ids of all documents before), n_tokens and ids_crc32 of every document, by keyed access.

    Every key is asked for in the index; the document is the one that the key has in the shard that the index names.
    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    bases = total_before(shards.select("shard", "part", "n_ids"), "n_ids", "base", [], "part", "shard").select(F.col("shard").alias("_shard"), "base")
    found = shards.mapInArrow(_read_shards, "shard long, doc_id long, in_shard long, start_in_shard long, n_tokens long, ids_crc32 long")
    located = locate(index, _keys(shards).select("doc_id", "earlier")).select(F.col("shard").alias("_shard"), F.col("in_shard").alias("_in_shard"), F.col("doc_id").alias("_doc_id"), "earlier")
    same = (found["shard"] == located["_shard"]) & (found["in_shard"] == located["_in_shard"]) & found["doc_id"].eqNullSafe(located["_doc_id"])
    read = found.join(located, same).drop("_shard").join(bases, F.col("shard") == F.col("_shard"))
    return read.select("doc_id", "earlier", "shard", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in shards, read back by key."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_shards(shards, write_index(shards)).select("doc_id", "start", "n_tokens", "ids_crc32")
