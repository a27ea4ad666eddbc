"""Language identification by bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of the n-grams that are typical of it. The filters lie bit-sliced in one table: a slot
holds a bitmask with a bit for each language, so the masks of an n-gram's slots, ANDed, name at once all
languages that contain it. A text is decided by the number of its n-grams that each language claims (the popcount of the
language's bit over the text's masks), corrected for the share that its filter claims by mistake.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import over_texts, some_at_a_time, text_or_empty, unused, without
from .labelled import held_out

#: Documents of each language that the filters are filled from, and languages in a word of a mask (a signed number).
SAMPLE_PER_LANGUAGE = 1_000
WORD = 63
#: Slots of the filters, as a power of two, and slots that an n-gram sets.
SLOT_BITS = 21
PROBES = 2
SIZES = (3, 4)
#: An n-gram is typical of a language that uses it at least this much as often as any does, and at least so many times.
TYPICAL = 0.5
LEAST_COUNT = 3
UNDETERMINED = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the texts' words, lower-cased and with a blank at both ends, and the text each is of."""
    cleaned = [" " + _NO_LETTER.sub(" ", t.lower()) + " " for t in texts]
    code = np.frombuffer("".join(cleaned).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in cleaned])
    hashes, owners = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ code[k : len(code) - n + 1 + k]) * _ODD
                h ^= h >> np.uint64(29)
        # Blanks stand only at the ends of an n-gram, and an n-gram is of one text.
        inner = code[1 : len(code) - n + 2] != 32
        for k in range(2, n - 1):
            inner &= code[k : len(code) - n + 1 + k] != 32
        inner &= owner[: len(code) - n + 1] == owner[n - 1 :]
        hashes.append(h[inner])
        owners.append(owner[: len(code) - n + 1][inner])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def slots(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th slot of each n-gram."""
    with np.errstate(over="ignore"):
        x = (hashes + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class LanguageFilters:
    """languages: their names in order of their bits; table: for each 63 languages a row with the mask of each slot."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        filled = np.array([np.count_nonzero(table[bit // WORD] & (1 << bit % WORD)) for bit in range(len(languages))]) / table.shape[1]
        self.by_mistake = filled**PROBES

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1: how far it is ahead of the next."""
        h, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        share, at = np.zeros((len(texts), len(self.languages))), [slots(h, k) for k in range(PROBES)]
        for bit in range(len(self.languages)):
            if bit % WORD == 0:
                masks = self.table[bit // WORD][at[0]]
                for k in range(1, PROBES):
                    masks &= self.table[bit // WORD][at[k]]
            claimed = np.bincount(owner, weights=(masks >> (bit % WORD)) & 1, minlength=len(texts))
            wrong = self.by_mistake[bit]
            share[:, bit] = np.clip((claimed / np.maximum(total, 1) - wrong) / max(1 - wrong, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        first = share[np.arange(len(texts)), best]
        share[np.arange(len(texts)), best] = -1
        second = np.maximum(share.max(axis=1), 0)
        score = np.where(first > 0, first / np.maximum(first + second, 1e-9), 0.0)
        letters = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in some_at_a_time(batch.column("text"), 1_000_000):
            bits = batch.column("bit").slice(row, len(texts)).to_numpy()
            h, owner = grams(texts.to_pylist())
            for bit in np.unique(bits).tolist():
                gram, n = np.unique(h[bits[owner] == bit], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), bit)), pa.array(gram.view(np.int64)), pa.array(n)], ["bit", "gram", "n"])


def _set_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column("gram").to_numpy().view(np.uint64)
        for k in range(PROBES):
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(slots(h, k)), batch.column("mask")], ["word", "slot", "mask"])


def fit_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageFilters:
    """Filters from whole texts of at most per_language documents of each lang, taken by a hash of the text.

    docs: doc_id, text and lang of the rows to learn from; rows without text or lang teach nothing.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Copies teach nothing more, so a language's size is its number of distinct texts.
    counts = rows.select("lang", F.xxhash64("text").alias("at")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas()
    languages = sorted(counts["lang"].tolist())
    words = -(-len(languages) // WORD)
    if not languages:
        return LanguageFilters([], np.zeros((1, 2**SLOT_BITS), np.int64))
    bits = {lang: bit for bit, lang in enumerate(languages)}
    # A text is in the sample if its hash is below a share that gives so many with room to spare; the bound is then held by rank.
    wanted = max(1.5 * per_language, per_language + 10 * per_language**0.5 + 50)
    shares = docs.sparkSession.createDataFrame([(lang, bits[lang], min(1.0, wanted / n)) for lang, n in zip(counts["lang"], counts["n"].tolist(), strict=True)], "lang string, bit long, share double")
    few = rows.select("lang", "text", F.xxhash64("text").alias("at")).join(F.broadcast(shares), "lang")
    few = few.where(F.pmod("at", F.lit(1_000_000)) < F.col("share") * 1_000_000).dropDuplicates(["lang", "at"])
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("at", F.lit(1_000_000)), "at")))
    sample = ranked.where(F.col("rank") <= per_language).select("bit", "text")
    grams_ = sample.mapInArrow(_count_grams, "bit long, gram long, n long").groupBy("bit", "gram").agg(F.sum("n").alias("n"))
    totals = grams_.groupBy("bit").agg(F.sum("n").alias("total"))
    often = grams_.join(F.broadcast(totals), "bit").withColumn("share", F.col("n") / F.col("total"))  # a row for each language
    typical = often.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where((F.col("n") >= LEAST_COUNT) & (F.col("share") >= TYPICAL * F.col("most")))
    word = F.expr(f"bit div {WORD}").alias("word")
    masks = typical.groupBy(word, "gram").agg(F.bit_or(F.expr(f"shiftleft(1L, cast(bit % {WORD} as int))")).alias("mask"))
    filled = masks.mapInArrow(_set_slots, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    table, got = np.zeros((words, 2**SLOT_BITS), np.int64), filled.toPandas()  # at most a row for each word and slot
    table[got["word"].to_numpy(np.int64), got["slot"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    return LanguageFilters(languages, table)


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """docs with lang_pred and score.

    Whole texts are looked at, however long, and nothing but the text counts. A text that is null or has no letter is `und`
    with score 0, and so is every text if no language was learned. Equal texts get equal answers, repeated rows too; ties go
    to the first language by name. An empty table gives no rows. Columns of docs that are named like an output column are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table))

    def make():
        here = LanguageFilters(*shared.value)

        def answer(texts: pa.Array) -> pa.Array:
            names, scores = [], []
            for _, part in some_at_a_time(texts, 1_000_000):
                name, score = here.decide(part.to_pylist())
                names += name
                scores.append(score)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

        return answer

    answered = unused(docs, "_answer")
    found = without(docs, "lang_pred", "score").withColumn(answered, over_texts(make, "lang_pred string, score double")(text_or_empty()))
    return found.withColumns({c: F.col(answered)[c] for c in ("lang_pred", "score")}).drop(answered)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(fold=3, remainder=1)
    found = identify(docs.select("doc_id", "text"), fit_languages(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
