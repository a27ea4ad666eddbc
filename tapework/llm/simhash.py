"""SimHash near-dedup: fingerprints of 64 bits that differ in few bits are linked, and links are followed.

Links are found by meet-in-the-middle ball hashing on the fingerprint's halves. Two fingerprints within a radius of 3
bits have one half of 32 bits within half of it, 1 bit. So every distinct fingerprint emits, for each half, all
variants of that half within 1 bit; variants are shuffled, and where a fingerprint's variant meets another's own half
the pair is verified over all 64 bits. (Balls over the whole word would be 2,146 rows for each fingerprint
instead of 66, several times the text itself; the links are the same.)

Skew: equal fingerprints are one row before anything is emitted, so a group of copies is one fingerprint however large it
is. Where many fingerprints meet, a spanning forest of the links is emitted, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, partitions, some_at_a_time, text_or_empty, without
from .components import connected_components

SEED = 42
CHUNK = 65_536
#: Rows and columns of one block of the comparison within a meeting point.
BLOCK = 2_048
#: Rows that are held against a block at once.
PART = 256
#: Sketches: mixes of 64 bits, keys of them and their bits, and bits of a key that variants flip.
MIXES, KEYS, KEY_BITS, DOUBTFUL = 4, 9, 28, 6
#: Rows of a meeting place that a task holds; more are dealt to blocks of so many.
CROWD = 8_192
#: Texts of a block of a candidate group about.
GROUP = 256


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a UTF-8 text. A bit is 1 if it is set in over half of the hashes of the shingles, repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle) for _, texts in some_at_a_time(batch.column("text")) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "text_hash", "print"])

    return run


def _variants() -> Column:
    """For each half: the half itself, and the 32 values one bit away; as (place, other)."""

    def around(k: int, half: Column) -> list[Column]:
        place = F.lit(k << 32).cast("long")
        flips = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
        own = F.array(F.struct(half.bitwiseOR(place).alias("place"), F.lit(0).alias("other")))
        return [own, F.transform(flips, lambda flip: F.struct(half.bitwiseXOR(flip).bitwiseOR(place).alias("place"), F.lit(1).alias("other")))]

    return F.explode(F.concat(*around(0, F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))), *around(1, F.shiftrightunsigned("print", 32))))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _span(own: np.ndarray, others: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect what the pairs (own, own) and (own, other) within radius connect. Works block by block."""
    everyone = np.unique(np.concatenate([own, others]))
    is_own, open_ = np.isin(everyone, own), np.ones(len(everyone), bool)
    a, b = [], []
    while open_.any():
        seed = np.flatnonzero(open_)[:1]
        open_[seed] = False
        front = seed
        while len(front):
            reached = []
            for at in range(0, len(front), BLOCK):
                part = front[at : at + BLOCK]
                rest = np.flatnonzero(open_)
                for to in range(0, len(rest), BLOCK):
                    cols = rest[to : to + BLOCK]
                    hit = _near(everyone[part], everyone[cols], radius) & (is_own[part][:, None] | is_own[cols][None, :])
                    found = hit.any(axis=0)
                    if found.any():
                        new = cols[found]
                        a.append(everyone[part[hit[:, found].argmax(axis=0)]])
                        b.append(everyone[new])
                        open_[new] = False
                        reached.append(new)
            front = np.concatenate(reached) if reached else np.zeros(0, np.int64)
    return a, b


def _meet(radius: int):
    """Rows arrive sorted by (place, other): a place matters where an own half comes first and somebody else follows."""

    def groups(place: np.ndarray, other: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(place):
            return
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(place)]]))
        a, b = [], []
        useful = (other[heads] == 0) & (sizes > 1)
        for head, size in zip(heads[useful].tolist(), sizes[useful].tolist(), strict=True):
            if size == 2:
                if (int(prints[head]) ^ int(prints[head + 1])).bit_count() <= radius:
                    a.append(prints[head : head + 1])
                    b.append(prints[head + 1 : head + 2])
                continue
            rows, own = prints[head : head + size], other[head : head + size] == 0
            x, y = _span(rows[own], rows[~own], radius)
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [batch.column("place").to_numpy(), batch.column("other").to_numpy(), batch.column("print").to_numpy().view(np.uint64)]
            if not len(new[0]):
                continue
            last = int(np.searchsorted(new[0], new[0][-1]))  # the last place may go on in the next batch
            if last or (held and held[-1][0][-1] != new[0][0]):
                yield from groups(*(np.concatenate(x) for x in zip(*held, [c[:last] for c in new], strict=True)))
                held = []
            held.append([c[last:] for c in new])
        if held:
            yield from groups(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def simhash_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """left and right: links that connect the distinct values of print (64 bits as a long) within radius bits, 3 at most."""
    if not 0 <= radius <= 3:
        raise ValueError("one bit in a half covers a radius of up to 3")
    emitted = prints.select("print").distinct().select("print", _variants().alias("v")).select("v.place", "v.other", "print")
    dealt = emitted.repartition(partitions(prints.sparkSession), "place").sortWithinPartitions("place", "other")
    return dealt.mapInArrow(_meet(radius), "left long, right long")


def _grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows' prints (doc_id, text_hash, print), and for each distinct print its component and that one's first document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    prints = cut(read.mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, text_hash long, print long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    least = cut(prints.groupBy("print").agg(first))
    nodes = connected_components(simhash_links(least, radius), "left", "right")
    grouped = least.join(nodes.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("first"))
    return prints, cut(grouped.select("print", "component").join(smallest, "component"))


def simhash_components(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, print and component_id for each row of docs.

    Texts are whole UTF-8 texts with A-Z in lower case, cut into words at blanks; shingles of so many words, repeats
    counted, are hashed by XXH64. A text of fewer words is one shingle; null, empty or blank texts have fingerprint zero,
    which links like any other. Fingerprints that differ in at most radius bits are linked. component_id is the smallest
    doc_id reachable over links, itself included; null where no member has a doc_id. Repeated rows are rows of their own.
    An empty table gives no rows.
    """
    prints, named = _grouped(docs, shingle, radius)
    return prints.join(named, "print").select("doc_id", "print", F.col("first.doc_id").alias("component_id"))


def simhash_dedup(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, with all columns of docs.

    Of rows that repeat that doc_id the one with the smallest hash of the text stays, and of equal rows one. Rows without
    doc_id stay only in components that have no other. See simhash_components() for the rest.
    """
    _, named = _grouped(docs, shingle, radius)
    keep = named.select(F.col("first.doc_id").alias("_keep_id"), F.col("first.text_hash").alias("_keep_hash")).distinct()
    own = without(docs, "_keep_id", "_keep_hash", "_text_hash").withColumn("_text_hash", F.xxhash64(text_or_empty()))
    kept = own.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text_hash") == F.col("_keep_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of a set of hashes each of their 64 bits is set, then the same for three further mixes of them: 256 counts."""
    mixes = [hashes]
    with np.errstate(over="ignore"):
        for _ in range(MIXES - 1):
            m = (mixes[-1] ^ (mixes[-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixes.append(m ^ (m >> np.uint64(31)))
    ones = np.zeros(64 * MIXES, np.int64)
    for at in range(0, len(hashes), CHUNK):
        some = np.column_stack([m[at : at + CHUNK] for m in mixes])
        # A byte for each bit, eight of them added at a time: up to 255 rows can't carry over.
        lanes = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def sketch(hashes: np.ndarray) -> bytes:
    """256 bits, each set if it is in over half of the hashes, and for each key of 28 bits the places of its most doubtful bits."""
    ones = bit_counts(hashes)
    margin = np.abs(2 * ones - len(hashes))[: KEYS * KEY_BITS].reshape(KEYS, KEY_BITS)
    doubtful = np.argsort(margin, axis=1, kind="stable")[:, :DOUBTFUL].astype(np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes() + doubtful.tobytes()


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(shingles(t, shingle)) for _, texts in some_at_a_time(batch.column("text")) for t in texts.cast(pa.binary()).to_pylist()]
            prints = np.frombuffer(b"".join(s[:16] for s in made), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(made, pa.binary())], ["doc_id", "text_hash", "print", "second", "sketch"])

    return run


def places(sketches: list[bytes]) -> np.ndarray:
    """A row for each sketch: for each of its keys the key itself and all variants with one or two of its most doubtful bits flipped."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    bits = np.unpackbits(rows[:, : 8 * MIXES], axis=1, bitorder="little")[:, : KEYS * KEY_BITS].reshape(-1, KEYS, KEY_BITS)
    own = bits @ (1 << np.arange(KEY_BITS, dtype=np.int64)) | (np.arange(KEYS, dtype=np.int64) << KEY_BITS)
    flips = 1 << rows[:, 8 * MIXES :].reshape(-1, KEYS, DOUBTFUL).astype(np.int64)
    some = [np.zeros_like(own), *(flips[:, :, k] for k in range(DOUBTFUL)), *(flips[:, :, j] | flips[:, :, k] for k in range(DOUBTFUL) for j in range(k))]
    return np.concatenate([own ^ flip for flip in some], axis=1).astype(np.uint32).view(np.int32)


def _emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            where = places(some.column("sketch").to_pylist())
            who = np.repeat(np.arange(len(where)), where.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(where.ravel()), *(pa.array(some.column(n).to_numpy()[who]) for n in ("text_hash", "print", "second"))], ["place", "text_hash", "print", "second"])


def _hits(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b (print and second) that are within radius, and within 2 * radius + 2 over both prints."""
    x, y = np.nonzero(_near(a[0], b[0], radius))
    both = np.bitwise_count(a[0][x] ^ b[0][y]) + np.bitwise_count(a[1][x] ^ b[1][y]) <= 2 * radius + 2
    return x[both], y[both]


def _like_first(prints: list[np.ndarray], first: np.ndarray | int, radius: int) -> np.ndarray:
    """Whether each row is as near as a link asks to the row first of it."""
    apart, more = (np.bitwise_count(p ^ p[first]).astype(np.int64) for p in prints)
    return (apart <= radius) & (apart + more <= 2 * radius + 2)


def _rest_links(rest: np.ndarray, ids: np.ndarray, prints: list[np.ndarray], others: np.ndarray, other_prints: list[np.ndarray], radius: int) -> tuple[list, list]:
    """Links between the rows numbered in rest and all others, block by block; only those that join what isn't joined yet."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = k = root.get(up, up)
        return k

    a, b = [], []
    for at in range(0, len(rest), PART):
        part = rest[at : at + PART]
        for to in range(0, len(others), BLOCK):
            x, y = _hits([p[part] for p in prints], [p[to : to + BLOCK] for p in other_prints], radius)
            for i, j in zip(ids[part[x]].tolist(), others[y + to].tolist(), strict=True):
                if (p := find(i)) != (q := find(j)):
                    root[q] = p
                    a.append(i)
                    b.append(j)
    return a, b


_FOUND = "left long, right long, place int, block int, rest_block int, print long, second long"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _meet_wide(radius: int):
    """Rows arrive sorted by (place, text_hash). All rows of a place are held against its first; what isn't like that one against all.

    Gives links, as left and right. Of a place with more than CROWD rows no more than those are held: its rows are given as left,
    place, block, print and second, with the first row as right, or where they aren't like it with rest_block instead.
    """

    def links(left, right) -> pa.RecordBatch:
        n = len(left)
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), *empty], _FOUND_NAMES)

    def small(place: np.ndarray, ids: np.ndarray, prints: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole places."""
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.append(heads, len(place)))
        first = np.repeat(heads, sizes)
        like = _like_first(prints, first, radius)
        linked = np.flatnonzero(like & (first != np.arange(len(place))))
        left, right = [ids[first[linked]]], [ids[linked]]
        unlike = np.flatnonzero(~like & (np.repeat(sizes, sizes) > 2))
        for head in np.unique(first[unlike]).tolist():
            end = head + int(sizes[np.searchsorted(heads, head)])
            rest = np.flatnonzero(~like[head:end])
            here = [p[head:end] for p in prints]
            a, b = _rest_links(rest, ids[head:end], here, ids[head:end], here, radius)
            left.append(np.array(a, np.int64))
            right.append(np.array(b, np.int64))
        if sum(map(len, left)):
            yield links(np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        crowd = None  # place, id and prints of the first row, rows so far and rows unlike it

        def crowded(place: np.ndarray, ids: np.ndarray, *prints: np.ndarray) -> pa.RecordBatch:
            nonlocal crowd
            if crowd is None:
                crowd = [place[0], ids[0], [p[:1] for p in prints], 0, 0]
            n = len(ids)
            like = _like_first([np.concatenate([f, p]) for f, p in zip(crowd[2], prints, strict=True)], 0, radius)[1:]
            block, rest = (crowd[3] + np.arange(n)) // CROWD, (crowd[4] + np.cumsum(~like) - 1) // CROWD
            crowd[3], crowd[4] = crowd[3] + n, crowd[4] + int((~like).sum())
            columns = [pa.array(ids), pa.array(np.full(n, crowd[1]), mask=~like), pa.array(place), pa.array(block.astype(np.int32)), pa.array(rest.astype(np.int32), mask=like)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(p.view(np.int64)) for p in prints)], _FOUND_NAMES)

        for batch in batches:
            new = [batch.column("place").to_numpy(), batch.column("text_hash").to_numpy(), *(batch.column(c).to_numpy().view(np.uint64) for c in ("print", "second"))]
            if not len(new[0]):
                continue
            if crowd is not None:
                end = int(np.searchsorted(new[0], crowd[0], "right"))
                if end:
                    yield crowded(*(c[:end] for c in new))
                if end == len(new[0]):
                    continue
                crowd, new = None, [c[end:] for c in new]
            last = int(np.searchsorted(new[0], new[0][-1]))  # the last place may go on in the next batch
            if held and (last or held[-1][0][-1] != new[0][0]):
                yield from small(*_joined(held, [c[:last] for c in new]))
                held = []
            elif last:
                yield from small(new[0][:last], new[1][:last], [c[:last] for c in new[2:]])
            held.append([c[last:] for c in new])
            if sum(len(h[0]) for h in held) > CROWD:
                for part in held:
                    yield crowded(*part)
                held = []
        if held:
            yield from small(*_joined(held, [c[:0] for c in held[0]]))

    return run


def _joined(held: list[list[np.ndarray]], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    place, ids, *prints = (np.concatenate(x) for x in zip(*held, more, strict=True))
    return place, ids, prints


def _crowd_links(radius: int):
    """Links between a block of a crowded place's rows that aren't like its first one and a block of all its rows."""

    def run(rest: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if len(rest) and len(members):
            (ids, prints), (others, other_prints) = ((t["left"].to_numpy(), [t[c].to_numpy().view(np.uint64) for c in ("print", "second")]) for t in (rest, members))
            a, b = _rest_links(np.arange(len(ids)), ids, prints, others, other_prints, radius)
        return pa.table({"left": pa.array(a, pa.int64()), "right": pa.array(b, pa.int64())})

    return run


def wide_links(texts: DataFrame, radius: int) -> DataFrame:
    """left and right: links that connect the texts (text_hash, print, second, sketch) that meet and are within radius bits of print, and 2 * radius + 2 of both.

    Texts meet in variants of keys of 28 bits. At a wide radius many prints of 64 bits are near by chance; the second print lets
    nearly none of those pass. A place that more than CROWD texts share is dealt to blocks.
    """
    emitted = texts.select("text_hash", "print", "second", "sketch").mapInArrow(_emit_places, "place int, text_hash long, print long, second long")
    dealt = emitted.repartition(partitions(texts.sparkSession), "place").sortWithinPartitions("place", "text_hash")
    found = cut(dealt.mapInArrow(_meet_wide(radius), _FOUND))
    crowd = found.where("place IS NOT NULL").select("place", "block", "rest_block", "left", "print", "second")
    blocks = crowd.groupBy("place").agg((F.max("block") + 1).alias("blocks"), (F.max("rest_block") + 1).alias("rest_blocks")).where("rest_blocks IS NOT NULL")
    key = ["place", "rest_block", "block"]
    every = {"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "rest_block": F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1))}
    side = lambda rows, name: rows.join(blocks, "place").withColumn(name, every[name]).select(*key, "left", "print", "second").toDF(*key, "left", "print", "second")
    asked, others = side(crowd.where("rest_block IS NOT NULL"), "block"), side(crowd, "rest_block")
    more = asked.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(_crowd_links(radius), "left long, right long")
    return found.where("right IS NOT NULL").select("left", "right").unionByName(more)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles share at least this part of their union; empty ones are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = int(np.isin(a, b, assume_unique=True, kind="sort").sum())
    return both >= least * (len(a) + len(b) - both)


def _texts(rows: pa.Table, shingle: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """text_hash, both prints and the sets of shingles of texts."""
    return rows["text_hash"].to_numpy(), [rows[c].to_numpy().view(np.uint64) for c in ("print", "second")], [shingles(t.encode(), shingle) for t in rows["text"].to_pylist()]


def _linked(hashes: list, others: list) -> pa.Table:
    return pa.table({"text_hash": pa.array(hashes, pa.int64()), "other": pa.array(others, pa.int64())})


def _verify_block(shingle: int, radius: int, least: float):
    """A group of one block is walked from text to similar text; of a larger one each block's texts are held against its leader.

    Gives text_hash and other: a link, or the text itself, or null where a text of a larger group isn't like its leader.
    """

    def run(members: pa.Table, leader: pa.Table) -> pa.Table:
        if not len(members):
            return _linked([], [])
        hashes, prints, sets = _texts(members, shingle)
        if members["blocks"][0].as_py() > 1:
            own, own_prints, own_sets = _texts(leader, shingle)
            _, near = _hits([p[:1] for p in own_prints], prints, radius)
            like = {k for k in near.tolist() if similar(own_sets[0], sets[k], least)}
            return _linked(hashes.tolist(), [int(own[0]) if k in like else None for k in range(len(hashes))])
        open_, other = np.ones(len(hashes), bool), hashes.copy()
        for seed in np.argsort(hashes).tolist():
            if not open_[seed]:
                continue
            open_[seed], front = False, [seed]
            while front:
                at = front.pop()
                rest = np.flatnonzero(open_)
                _, near = _hits([p[at : at + 1] for p in prints], [p[rest] for p in prints], radius)
                for to in rest[near].tolist():
                    if similar(sets[at], sets[to], least):
                        open_[to], other[to] = False, hashes[seed]
                        front.append(to)
        return _linked(hashes.tolist(), other.tolist())

    return run


def _verify_rest(shingle: int, radius: int, least: float):
    """Links between texts that aren't like their group's leader and a block of the group; those that join what isn't joined yet."""

    def run(rest: pa.Table, members: pa.Table) -> pa.Table:
        left, right = [], []
        if len(rest) and len(members):
            (a, a_prints, a_sets), (b, b_prints, b_sets) = _texts(rest, shingle), _texts(members, shingle)
            root: dict[int, int] = {}

            def find(k: int) -> int:
                while (up := root.get(k, k)) != k:
                    root[k] = k = root.get(up, up)
                return k

            for x, y in zip(*(p.tolist() for p in _hits(a_prints, b_prints, radius)), strict=True):
                p, q = find(int(a[x])), find(int(b[y]))
                if p != q and similar(a_sets[x], b_sets[y], least):
                    root[q] = p
                    left.append(int(a[x]))
                    right.append(int(b[y]))
        return _linked(left, right)

    return run


def _verified(members: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    """text_hash and component of the texts that verified links join. members: component, text_hash, print, second, text and _first.

    A group of many texts is dealt to blocks. Every block is held against the group's first text, which most are like; those that
    aren't meet all blocks of their group. No task has more than two blocks, and links are followed as a table.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("_first").isNull(), "_first", "text_hash")).alias("least"))
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = cut(members.drop("_first").join(sizes.select("component", blocks.alias("blocks"), F.col("least.text_hash").alias("leader")), "component").withColumn("block", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int")))
    leaders = dealt.where("text_hash = leader").select("component", "text_hash", "print", "second", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    key, shape = ["component", "block"], "text_hash long, other long"
    found = cut(dealt.groupBy(*key).cogroup(leaders.groupBy(*key)).applyInArrow(_verify_block(shingle, radius, least), shape))
    rest = dealt.join(found.where("other IS NULL").select("text_hash"), "text_hash")
    counts = rest.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("rest_blocks"))
    rest = cut(rest.join(counts, "component").withColumn("rest_block", F.pmod(F.xxhash64("text_hash", F.lit(1)), F.col("rest_blocks")).cast("int")))
    key = ["component", "rest_block", "block"]
    asked = rest.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = dealt.join(counts, "component").withColumn("rest_block", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)))
    more = asked.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(_verify_rest(shingle, radius, least), shape)
    nodes = connected_components(found.where("other IS NOT NULL").unionByName(more), "text_hash", "other")
    for table in (dealt, found, rest):
        forget(table)
    return nodes.withColumnRenamed("node", "text_hash")


def near_dedup(docs: DataFrame, shingle: int = 5, radius: int = 17, least: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest doc_id, with all columns of docs.

    Texts are linked if their fingerprints meet and are near (see wide_links(); here of the distinct shingles) and their sets of
    shingles share at least `least` of their union; links are followed. Which row stays is as in simhash_dedup().
    Fingerprints alone make candidate groups, whose distinct texts are compared by their shingles, in blocks (see _verified()).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    prints = read.mapInArrow(_sketches(shingle), f"doc_id {id_type}, text_hash long, print long, second long, sketch binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    texts = cut(prints.groupBy("text_hash", "print", "second", "sketch").agg(first))
    links = wide_links(texts, radius)
    nodes = connected_components(links, "left", "right").withColumnRenamed("node", "text_hash")
    forget(links)
    group = texts.join(nodes, "text_hash").select("text_hash", "print", "second", "component", F.col("first.doc_id").alias("_first"))
    # Of a text's copies the one with the first doc_id brings the text; rows that repeat it too are dropped.
    brought = read.join(group, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["text_hash"])
    roots = _verified(brought.select("component", "text_hash", "print", "second", "text", "_first"), shingle, radius, least).withColumnRenamed("component", "root")
    named = texts.join(roots, "text_hash", "left").groupBy(F.coalesce("root", "text_hash").alias("root")).agg(F.min("first").alias("first"))
    keep = named.select(F.col("first.doc_id").alias("_keep_id"), F.col("first.text_hash").alias("_keep_hash"))
    own = without(docs, "_keep_id", "_keep_hash", "_text_hash").withColumn("_text_hash", F.xxhash64(text_or_empty()))
    kept = own.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text_hash") == F.col("_keep_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of documents, linked at 3 or fewer bits."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
