"""Periodic runs of words, found by block convolution.

A run with smallest period q is at least four periods long. At the dyadic scale L with L <= q < 2L it holds two consecutive blocks that
begin at multiples of L, and both occur again q words on. So at every scale each block (its first 32 words, if L is more) is held
against the windows that follow it at distances L to 2L - 1: the sum of squared differences of word codes at every distance is two
sums of squares less twice a correlation, and the correlations are number-theoretic transforms modulo 65537. Where the
sum is zero for two blocks in a row, the distance seeds an extension, which compares the words themselves; so the codes, of 16 bits,
can't give a wrong run, and equal words never give a sum other than zero, so none is missed. All texts of a batch are one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, some_at_a_time, table, text_or_empty, unused, without
from .flat import runs_of
from .mph import mix

#: Arithmetic is modulo this prime; 3 generates all its residues, so transforms of every power of two to 2**16 exist.
PRIME, GENERATOR = 65537, 3
#: Words of a block at most, and windows that are transformed at once.
BLOCK, WINDOWS = 32, 2_048
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = f"struct<n_words: bigint, runs: array<{RUN}>, collapsed: string>"
FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN_TYPE)), ("collapsed", pa.string())])


def _mod(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2**52, in place, as what they leave modulo the prime, give or take the prime once; exact."""
    quotient = x * (1 / PRIME)
    np.rint(quotient, out=quotient)
    quotient *= PRIME
    x -= quotient
    return x


@lru_cache(maxsize=16)
def _matrices(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of this size, and the first half of the rows of the inverse one; products with them are sums below 2**39, exact in doubles."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    powers = np.array([pow(root, k, PRIME) for k in range(size)], np.int64)
    forward = powers[np.outer(np.arange(size), np.arange(size)) % size]
    back = powers[-np.outer(np.arange(size), np.arange(size // 2)) % size] * pow(size, PRIME - 2, PRIME) % PRIME
    return forward.astype(float), back.astype(float)


def _slices(x: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, width)[starts]


def matches(codes: np.ndarray, blocks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances from scale to 2 * scale - 1 at which a block's sum of squared differences is zero modulo the prime.

    codes: residues with room for 2 * scale + 2 * BLOCK beyond any block.
    """
    width = min(scale, BLOCK)
    forward, back = _matrices(2 * width)
    windows = scale // width
    squares = runs_of(_mod(codes**2)).astype(float)
    squares = _mod(squares[width:] - squares[:-width])  # of the words from each place on, a block long
    starts, distances = [], []
    together = max(1, WINDOWS // windows)
    for at in range(0, len(blocks), together):
        own = blocks[at : at + together]
        # The reversed transform of a block makes a convolution a correlation.
        block = _mod(_slices(codes, own, width) @ forward[:width])
        block = block[:, -np.arange(2 * width) % (2 * width)]
        for first in range(0, windows, WINDOWS):
            ahead = scale + width * np.arange(first, min(windows, first + WINDOWS))
            place = (own[:, None] + ahead[None, :]).ravel()
            window = _mod(_slices(codes, place, 2 * width) @ forward).reshape(len(own), len(ahead), -1)
            window *= block[:, None, :]
            total = (_mod(window).reshape(-1, 2 * width) @ back).reshape(len(own), len(ahead), -1)
            total *= -2
            total += _slices(squares, place, width).reshape(total.shape)
            total += squares[own][:, None, None]
            x, y = np.nonzero(_mod(total).reshape(len(own), -1) == 0)
            starts.append(own[x])
            distances.append(ahead[0] + y)
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _chains(starts: np.ndarray, distances: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of every row of two or more consecutive blocks that match at the same distance."""
    order = np.lexsort((starts, distances))
    starts, distances = starts[order], distances[order]
    after = (np.diff(starts) == scale) & (np.diff(distances) == 0)
    head = (np.append(after, False) & ~np.append(False, after))[: len(starts)]
    return starts[head], distances[head]


def _extent(ids: np.ndarray, start: int, distance: int) -> tuple[int, int]:
    """The longest stretch around start whose words equal those `distance` further on, as the run's first word and end."""
    end, step = start, 64
    while True:
        step = min(2 * step, len(ids) - distance - end)
        equal = ids[end : end + step] == ids[end + distance : end + distance + step]
        if not equal.all():
            end += int(equal.argmin())
            break
        end += step
        if not step:
            break
    begin, step = start, 64
    while begin:
        step = min(2 * step, begin)
        unequal = ids[begin - step : begin] != ids[begin - step + distance : begin + distance]
        if unequal.any():
            begin -= int(unequal[::-1].argmax())
            break
        begin -= step
    return begin, end + distance


def find_runs(ids: np.ndarray, bounds: np.ndarray, least_length: int = 6, least_periods: int = 4) -> np.ndarray:
    """All runs of the texts whose words are ids[bounds[k]:bounds[k + 1]], as rows (start, end, period), sorted.

    Equal words have equal ids. A run has a smallest period q, max(least_length, least_periods * q) words or more, and can't be made longer.
    """
    if least_periods < 4:
        raise ValueError("blocks at one scale find runs of four periods or more")
    sizes = np.diff(bounds)
    # A word of its own kind between texts: no run goes over it.
    apart = np.insert(ids, bounds[1:], -1 - np.arange(len(sizes)))
    text = np.insert(np.repeat(np.arange(len(sizes)), sizes), bounds[1:], np.arange(len(sizes)))
    found: dict[tuple[int, int], int] = {}
    covered, period = np.zeros(len(apart), np.int64), np.ones(len(apart), np.int64)
    longest = int(sizes.max(initial=0))
    room = 1
    while room <= longest // least_periods:
        room *= 2
    residues = (mix(apart.astype(np.uint64)) % np.uint64(PRIME)).astype(np.float64)
    residues = np.concatenate([residues, np.zeros(2 * room + 2 * BLOCK)])
    scale = 1
    while scale * least_periods <= longest:
        blocks = np.arange(0, len(apart), scale)
        blocks = blocks[sizes[text[blocks]] >= scale * least_periods]
        heads = _chains(*matches(residues, blocks, scale), scale)
        known = (covered[heads[0]] > heads[0] + heads[1]) & (heads[1] % period[heads[0]] == 0)
        for start, distance in zip(heads[0][~known].tolist(), heads[1][~known].tolist(), strict=True):
            if covered[start] > start + distance and distance % period[start] == 0:
                continue  # inside a run that this scale has found
            begin, end = _extent(apart, start, distance)
            if end - begin >= max(least_length, least_periods * distance) and (begin, end) not in found:
                found[begin, end] = distance
                part = covered[begin:end] < end
                period[begin:end][part] = distance
                covered[begin:end][part] = end
        scale *= 2
    rows = np.array(sorted((a, b, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)
    rows[:, :2] -= text[rows[:, 0]][:, None]  # the words between texts
    return rows


def _collapse(texts: pa.Array, least_length: int, least_periods: int) -> pa.StructArray:
    """FOUND_TYPE of each text."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    # A blank text, and blanks at either end, give empty words.
    real = np.not_equal(pc.binary_length(words).to_numpy(), 0)
    if not real.all():
        bounds = runs_of(real)[bounds]
        words = words.filter(pa.array(real))
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = find_runs(ids, bounds, least_length, least_periods)
    owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
    # Words that a run holds after its first period, as a difference array.
    difference = np.zeros(len(ids) + 1, np.int64)
    np.add.at(difference, runs[:, 0] + runs[:, 2], 1)
    np.add.at(difference, runs[:, 1], -1)
    kept = np.cumsum(difference)[: len(ids)] == 0
    left = pa.ListArray.from_arrays(pa.array(runs_of(kept)[bounds], pa.int32()), words.filter(pa.array(kept)))
    listed = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - bounds[owner], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(RUN_TYPE))
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(bounds))), pa.int32()), listed)
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), listed, pc.binary_join(left, " ")], fields=list(FOUND_TYPE))


def _over(least_length: int, least_periods: int):
    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_collapse(part, least_length, least_periods) for _, part in some_at_a_time(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], FOUND_TYPE)

    return run.asNondeterministic()


def periodic_runs(docs: DataFrame, least_length: int = 6, least_periods: int = 4) -> DataFrame:
    """docs with n_words, runs (array of start, length and period, by start, then period) and collapsed.

    Words are what stands between blanks (space and the controls 9 to 13) of the whole text; null, empty and blank texts have none. A run is
    a stretch of words with smallest period q, of max(least_length, least_periods * q) words or more, that no neighbouring word extends with
    that period. collapsed joins by one space the words that no run holds after its first period. Texts of any length are taken whole, in
    tasks that hold few MB, or one longer text, at a time. Repeated rows give equal rows, an empty table none; columns of docs with the
    names of the new ones are replaced.
    """
    made = ["n_words", "runs", "collapsed"]
    docs = without(docs, *made)
    found = unused(docs, "_found")
    out = docs.withColumn(found, _over(least_length, least_periods)(text_or_empty()))
    return out.select(*docs.columns, *[F.col(f"{found}.{name}").alias(name) for name in made])


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for one in ten ids, by crc32 of the id, its words from a place on repeat with a period, both from the same number."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(copies, 1, n - a)), " "))

    # An array of one holds the words, so that they are split off once.
    split = F.array(F.filter(F.split(text, f"[{BLANK_CLASS}]+"), lambda w: w != ""))
    return F.coalesce(F.when(h % 10 == 0, F.get(F.transform(split, repeated), F.lit(0))), text)


def longest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the one that starts first, then that of the smaller period. Null if there is none."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (more > 0), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, of which one in ten has a planted one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), text_or_empty()).alias("text"))
    found = periodic_runs(docs).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
