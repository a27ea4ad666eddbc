"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Texts are encoded once into a table of pieces; a text longer than a sequence is cut at whole sequences. The histogram of
piece lengths, at most as many rows as a sequence has tokens, is packed as patterns with counts: lengths are placed
longest first, each into the shortest pack that there is, or a new one where it doesn't fit. Patterns are joined back
to pieces by the piece's rank among those of its length.

The table of places that goes to every task doesn't grow with the documents: there are at most as many patterns as lengths (a
step either uses up a length or a pattern), and lengths in a pattern that differ add up to no more than a sequence.

Skew: ranks are a running count within the task that wrote a piece plus the counts of earlier tasks, so a length that
most pieces have is counted in all tasks at once.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, some_at_a_time, text_or_empty
from .tokens import encoder


def pack_lengths(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many packs follow each, for histogram[length] pieces of each length."""
    packs: dict[int, Counter] = defaultdict(Counter)  # by space that is left
    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, p in packs.items() if p), default=0)
            if room < length:
                packs[size - length][(length,)] += left
                break
            pattern, count = next(iter(packs[room].items()))
            used = min(count, left)
            # As many of the length as fit evenly: the shortest pack stays the shortest while it is over the next.
            packs[room][pattern] -= used
            if not packs[room][pattern]:
                del packs[room][pattern]
                if not packs[room]:
                    del packs[room]
            packs[room - length][(*pattern, length)] += used
            left -= used
    return [(pattern, count) for room in sorted(packs) for pattern, count in sorted(packs[room].items(), reverse=True) if count]


class Places:
    """Where the piece of a rank among those of its length goes: a table of stretches of ranks, one for each length in each pattern."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows, used, sequence = [], Counter(), 0
        for pattern, count in patterns:
            offset = 0
            for length, times in Counter(pattern).items():
                rows.append((length, used[length], times, sequence, offset))
                used[length] += count * times
                offset += length * times
            sequence += count
        self.n_sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.times, self.sequence, self.offset = table.T
        self.key = (self.length << 44) + self.first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset."""
        at = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, side="right") - 1
        within = rank - self.first[at]
        return self.sequence[at] + within // self.times[at], self.offset[at] + within % self.times[at] * length


def _ranks(lengths: np.ndarray) -> np.ndarray:
    """Each one's number among the equal ones before it."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(heads, np.diff(np.append(heads, len(ordered))))
    return out


def _pieces(vocabulary: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ranks, part = encoder(vocabulary), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for row, texts in some_at_a_time(batch.column("text")):
                ids, starts = encode.with_end(texts, end_id)
                totals = np.diff(starts)
                times = -(-totals // size)
                of = np.repeat(np.arange(len(totals)), times)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)) * size
                length = np.minimum(size, totals[of] - start)
                cuts = np.append(starts[of] + start, len(ids)).tolist()
                words = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(words[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                own = {"start": start, "length": length, "doc_tokens": totals[of], "ids_crc32": np.array(crcs, np.int64), "local_rank": ranks[length] + _ranks(length), "part": np.full(len(of), part)}
                ranks += np.bincount(length, minlength=size + 1)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.array(cuts, np.int64).astype(np.int32) * np.int32(ids.itemsize)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + of)), *(pa.array(v, pa.int64()) for v in own.values()), data], ["doc_id", *own, "ids"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """One row for each piece of a document's ids: doc_id, start, length, doc_tokens, ids (bytes), ids_crc32, sequence_id and offset.

    The ids of a text (null: empty) by the vocabulary file of the tokenizers library, without special tokens, and end_id at
    their end; so an empty text is one id. Each id is in exactly one piece. start is the place of the piece in its
    document, offset in its sequence; a sequence's pieces follow without gaps from 0, and sequence ids have no gaps.
    Ids are unsigned, little-endian, of 16 bits where the vocabulary allows and else of 32; ids_crc32 is the
    unsigned crc32 of the piece as 32-bit ids. Repeated rows are documents of their own; doc_id may be null.
    An empty table gives no rows. Columns of docs other than doc_id and text don't matter, whatever they are named.
    A very long text is encoded whole, by the task that reads it. Patterns depend on the numbers of lengths alone; which
    of equally long pieces goes where depends on how the table is dealt out to tasks.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_or_empty().alias("text"))
    pieces = cut(read.mapInArrow(_pieces(vocabulary, end_id, size), f"doc_id {id_type}, start long, length long, doc_tokens long, ids_crc32 long, local_rank long, part long, ids binary"))
    by_part = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    shared = spark.sparkContext.broadcast(Places(pack_lengths(histogram, size)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = shared.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # The table of earlier counts grows with the tasks, so it is merged, not broadcast.
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("_place", place("length", F.col("before") + F.col("local_rank")))
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "_place.sequence_id", "_place.offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
