"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every shingle hash below a fixed part of the range of 64 bits, so it grows with its text, fingerprints of a
text's parts merge to that of the whole, and a short text's containment in a long one is estimated from hashes that both would have kept.
A text whose hashes are all above that threshold keeps its least one; a merged fingerprint does the same, so merging stays exact.

A shingle's hash is a sum of its words' 64-bit hashes, each times an odd number of its place, modulo 2**64.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_texts, partitions, some_at_a_time, table, text_or_empty
from .flat import runs_of

#: Of the hashes, one in so many is kept.
SCALE = 8
SHINGLE = 5
DIGITS = 16


def multipliers(shingle: int) -> list[int]:
    """An odd number of 61 bits for each place of a shingle: powers of 5 are odd, and the twelfth power starts a well-mixed row."""
    return [pow(5, 12 + 7 * k, 2**61) for k in range(1, shingle + 1)]


def sketches(texts: pa.Array, shingle: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of all texts, ascending in each, and where each text's begin, with the end as one more.

    Words stand between blanks, A-Z in lower case. A text of fewer words than a shingle is one shingle; one without words has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.string())))
    words = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    real = np.not_equal(pc.binary_length(words).to_numpy(), 0)
    if not real.all():  # a blank text, and blanks at either end, give empty words
        bounds, words = runs_of(real)[bounds], words.filter(pa.array(real))
    words = words.dictionary_encode()
    digests = b"".join(hashlib.md5(w).digest()[:8] for w in words.dictionary.cast(pa.binary()).to_pylist())
    hashes = np.frombuffer(digests, ">u8").astype(np.uint64)[words.indices.to_numpy()]
    n = np.diff(bounds)
    total = np.zeros(len(hashes), np.uint64)
    left = np.repeat(bounds[1:], n) - np.arange(len(hashes))  # words from here to the text's end
    for k, c in enumerate(multipliers(shingle)):
        total[: max(0, len(hashes) - k)] += np.where(left[: max(0, len(hashes) - k)] > k, hashes[k:] * np.uint64(c), np.uint64(0))
    owner = np.repeat(np.arange(len(n)), n)
    whole = (left >= shingle) | (np.arange(len(hashes)) == bounds[owner])
    total, owner = total[whole], owner[whole]
    low = total < np.uint64(2**64 // scale)
    none = (np.bincount(owner[low], minlength=len(n)) == 0) & (n > 0)
    if none.any():
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(total, heads)
        low |= none[owner] & (total == np.repeat(least, np.diff(np.append(heads, len(owner)))))
    total, owner = total[low], owner[low]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = (np.diff(owner, prepend=-1) != 0) | (np.diff(total, prepend=np.uint64(0)) != 0)
    return total[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def _written(hashes: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Sketches as strings of 16 lowercase hex digits a hash."""
    digits, at = hashes.astype(">u8").tobytes().hex(), (bounds * DIGITS).tolist()
    return [digits[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many hashes the k-th sketches of a and of b have in common."""
    n = len(a[1]) - 1
    rows = np.concatenate([np.repeat(np.arange(n), np.diff(x[1])) for x in (a, b)])
    hashes = np.concatenate([a[0], b[0]])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    return np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])], minlength=n)


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    both = _shared(a, b)
    either = np.diff(a[1]) + np.diff(b[1]) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def fingerprint(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The text's fingerprint: its kept hashes in ascending order, 16 lowercase hex digits each. Null and blank texts have an empty one."""
    return over_texts(lambda: lambda texts: pa.array(_written(*sketches(texts, shingle, scale)), pa.string()), "string")(F.coalesce(text, F.lit("")))


def hashes_of(fingerprint: Column) -> Column:
    """A fingerprint's hashes, as hex digits."""
    return F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the shared part of two texts' shingles in their union, from fingerprints; 1 for two empty ones."""
    both = F.size(F.array_intersect(hashes_of(a), hashes_of(b)))
    either = F.size(hashes_of(a)) + F.size(hashes_of(b)) - both
    return F.when(either > 0, both / F.greatest(either, F.lit(1))).otherwise(1.0)


def containment(part: Column, whole: Column) -> Column:
    """Estimate of the part of the first text's shingles that the second has; 1 where the first has none."""
    n = F.size(hashes_of(part))
    return F.when(n > 0, F.size(F.array_intersect(hashes_of(part), hashes_of(whole))) / F.greatest(n, F.lit(1))).otherwise(1.0)


def merged(fingerprints: Column, scale: int = SCALE) -> Column:
    """The fingerprint of several texts' shingles together, from an array of theirs."""
    every = F.array_sort(F.array_distinct(F.flatten(F.transform(fingerprints, hashes_of))))
    low = F.filter(every, lambda h: h < F.lit(f"{2**64 // scale:0{DIGITS}x}"))
    return F.array_join(F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1)), "")


MADE = ["n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edit(text: str, following: str) -> str:
    """The text whose last quarter of code points gives way to as many of the following text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(rows: pa.RecordBatch, shingle: int, scale: int) -> pa.RecordBatch:
    """doc_id and MADE of all rows but the last, each by the text that follows it."""
    hashes, bounds = sketches(rows.column("text"), shingle, scale)
    n, texts = len(rows) - 1, rows.column("text").to_pylist()
    own, after = (hashes[: bounds[n]], bounds[: n + 1]), (hashes[bounds[1] :], bounds[1:] - bounds[1])
    edited = pa.array(list(map(_edit, texts[:-1], texts[1:])), pa.string())
    changed = sketches(edited, shingle, scale)
    columns = [pa.array(list(map(len, texts[:-1])), pa.int64()), edited, pa.array(_written(*own), pa.string()), pa.array(_written(*changed), pa.string()), pa.array(_likeness(own, changed)), pa.array(_likeness(own, after))]
    return pa.RecordBatch.from_arrays([rows.column("doc_id").slice(0, n), *columns], ["doc_id", *MADE])


def _walk(shingle: int, scale: int):
    """Rows come in order, range by range; each range ends in a borrowed row, the first of the next range, which gives nothing itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at, texts in some_at_a_time(batch.column("text")):
                rows = batch.slice(at, len(texts))
                if last is not None:
                    rows = pa.Table.from_batches([last, rows]).combine_chunks().to_batches()[0]
                last = rows.slice(len(rows) - 1)
                if len(rows) > 1:
                    own = pc.invert(rows.column("borrowed").slice(0, len(rows) - 1))
                    yield _compared(rows, shingle, scale).filter(own)

    return run


def _ranges(keys: list[tuple]):
    """The range of each key, and for the first key of a range the range before too, which borrows it; the last range is before the first."""
    first = {key: k for k, key in enumerate(keys)}

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, hashes in batches:
            out = []
            for doc_id, text_hash in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
                key = (doc_id is None, *([] if doc_id is None else [doc_id]), text_hash)
                k = bisect_right(keys, key) - 1
                out.append([k, (k - 1) % len(keys)] if key in first else [k])
            yield pa.array(out, pa.list_(pa.int32()))

    return run.asNondeterministic()


def edited_fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs (doc_id and text are read).

    The next document is that of the next doc_id; rows of equal doc_id follow each other by a hash of their text, rows without doc_id come
    last, and the first comes after the last. In edited_text the last quarter of the text's code points (rounded down) gives way to as many of the
    next text's first, or all of that. near_edited and near_next are likenesses() of the fingerprint to that of the edited and of the next text.
    Null texts are empty ones: their fingerprint is empty, like only to another empty one. An empty table gives no rows.

    The table is dealt into as many ranges of doc_id as the session has shuffle partitions; the driver holds the first id of each. Texts are
    shuffled once, to their range, and the first text of each range also to the one before; ranges are then walked in order.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    named = F.col("doc_id").isNull().alias("unnamed")
    spread = read.select("doc_id", "text_hash").repartitionByRange(partitions(spark), *order)
    firsts = spread.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(named, "doc_id", "text_hash")).alias("first")).select("first.*").collect()
    keys = sorted((r["unnamed"], *([] if r["unnamed"] else [r["doc_id"]]), r["text_hash"]) for r in firsts)
    to = F.posexplode(_ranges(keys)(F.col("doc_id"), F.col("text_hash"))).alias("turn", "range")
    dealt = read.select("doc_id", "text", "text_hash", to).withColumn("borrowed", F.col("turn") > 0)
    in_order = dealt.repartition(partitions(spark), "range").sortWithinPartitions("range", "borrowed", *order).select("doc_id", "text", "borrowed")
    shape = f"doc_id {id_type}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order.mapInArrow(_walk(shingle, scale), shape)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of five-word shingles of every document and its edited text."""
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


_PRODUCTS = " + ".join(f"({f'coalesce(lead(w, {k}) OVER o, 0)' if k else 'w'} * {c}::HUGEINT) % 18446744073709551616" for k, c in enumerate(multipliers(SHINGLE)))
OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following
  FROM documents
), edited AS (
  SELECT *, left(text, length(text) - length(text) // 4) || left(following, length(text) // 4) AS edited_text FROM docs
), texts AS (
  SELECT doc_id, 'own' AS kind, text FROM edited UNION ALL SELECT doc_id, 'edited', edited_text FROM edited
), split AS (
  SELECT doc_id, kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM texts
), words AS (
  SELECT doc_id, kind, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM split
), vocabulary AS (
  SELECT word, ('0x' || substr(md5(word), 1, 16))::UBIGINT::HUGEINT AS w FROM (SELECT DISTINCT word FROM words)
), shingles AS (
  SELECT doc_id, kind, i, n, ({_PRODUCTS}) % 18446744073709551616 AS h FROM words JOIN vocabulary USING (word) WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)
), hashed AS (
  SELECT DISTINCT doc_id, kind, h FROM shingles WHERE i <= greatest(n - {SHINGLE}, 0)
), least_of AS (
  SELECT doc_id, kind, min(h) AS least FROM hashed GROUP BY ALL
), kept AS (
  SELECT doc_id, kind, h FROM hashed JOIN least_of USING (doc_id, kind) WHERE h < {2**64 // SCALE} OR (h = least AND least >= {2**64 // SCALE})
), written AS (
  SELECT doc_id, kind, string_agg(lpad(lower(hex(h::UBIGINT)), {DIGITS}, '0'), '' ORDER BY h) AS digits, list(h) AS hashes FROM kept GROUP BY ALL
), compared AS (
  SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited_text) AS edited_sha256, coalesce(a.digits, '') AS fingerprint, coalesce(b.digits, '') AS edited_fingerprint,
    coalesce(len(a.hashes), 0) AS n_a, coalesce(len(b.hashes), 0) AS n_b, coalesce(len(c.hashes), 0) AS n_c,
    coalesce(len(list_intersect(a.hashes, b.hashes)), 0) AS ab, coalesce(len(list_intersect(a.hashes, c.hashes)), 0) AS ac
  FROM edited e LEFT JOIN written a ON a.doc_id = e.doc_id AND a.kind = 'own' LEFT JOIN written b ON b.doc_id = e.doc_id AND b.kind = 'edited' LEFT JOIN written c ON c.doc_id = e.next_id AND c.kind = 'own'
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN n_a + n_b = 0 THEN 1.0 ELSE ab::DOUBLE / (n_a + n_b - ab) END::DOUBLE AS near_edited, CASE WHEN n_a + n_c = 0 THEN 1.0 ELSE ac::DOUBLE / (n_a + n_c - ac) END::DOUBLE AS near_next
FROM compared
"""
