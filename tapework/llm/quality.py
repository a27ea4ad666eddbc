"""Quality classifier by Bradley-Terry ranking.

From pairs of a document that is preferred (label 1) to another (label 0), weights are learned by logistic loss on the
difference of their features; a document's score is its weighted sum, so that the difference of two scores is the log odds of
the preference. The threshold is where the fewest labelled rows are on the wrong side, and scores are shifted and squashed so
that it lies at a given number between 0 and 1. All labelled rows are learned from, each in several pairs.

Features are ratios of the whole text (letter cases, signs, repeated words, lines and word triples, lengths), each as ten
ranges between quantiles, so that a score can bend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget, over_texts, partitions, some_at_a_time, text_or_empty, without
from .labelled import held_out

#: Pairs that each labelled row is in at least, pairs that few rows give at least, and ranges of a feature.
PARTNERS = 2
PAIRS = 20_000
RANGES = 10

#: Groups of bytes whose shares are features.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,", b"!", b"?", b";:'\"-()", b"#$%&*@", b"|", b"/\\_=+<>[]{}^~`", bytes(range(128, 256))]
_SHARES = np.zeros((256, len(_GROUPS)))
for _k, _bytes in enumerate(_GROUPS):
    _SHARES[list(_bytes), _k] = 1


def features(text: bytes) -> list[float]:
    """Numbers that describe a whole UTF-8 text."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    shares = seen @ _SHARES / n
    letters = seen[seen > 0] / n
    words, lines = text.split(), text.split(b"\n")
    n_words = max(1, len(words))
    distinct, triples = set(words), set(zip(words, words[1:], words[2:], strict=False))
    upper = sum(map(bytes.isupper, words))
    alphabetic = sum(map(bytes.isalpha, words))
    filled = [x for x in lines if x.strip()]
    return [
        *shares,
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n_words,
        len(distinct) / n_words,
        len(triples) / max(1, len(words) - 2) if len(words) > 2 else 1.0,
        upper / n_words,
        alphabetic / n_words,
        len(set(filled)) / max(1, len(filled)),
        np.log1p(len(text) / len(lines)),
        float(-(letters * np.log2(letters)).sum()) if len(text) else 0.0,
        max(map(len, distinct), default=0) / 20,
    ]


class BradleyTerry:
    """Weights over ranges of features. fit_quality() learns them; without both classes every score is neutral."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, shift: float = 0.0, scale: float = 1.0, at: float = 0.5):
        self.edges, self.weights, self.shift, self.scale, self.at = edges, weights, shift, scale, at

    def ranges(self, x: np.ndarray) -> np.ndarray:
        """How far each value is through each range of its feature: 0 below, 1 above."""
        low, high = self.edges[:, :-1], self.edges[:, 1:]
        width = np.maximum(high - low, 1e-9)
        return np.clip((x[:, :, None] - low[None]) / width[None], 0, 1).reshape(len(x), -1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.ranges(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(x) - self.shift) + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _bins(values: np.ndarray) -> np.ndarray:
    """Numbers of bins in the order of the values: the first bits of a value, so that a bin is at most 0.4 % wide."""
    bits = (values + 0.0).astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> 15


def learned_rows(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """label, part, number and x (features) of every labelled document that isn't held out, as a table; number counts from 1 within a label and part.

    A doc_id that several documents have gives one row, that of the text with the smallest hash. Texts are described where they are read;
    only features are shuffled.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(column).cast("int").alias("label")).distinct()
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, some in some_at_a_time(batch.column("text")):
                x = pa.array([features(t) for t in some.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, len(x)) for c in ("doc_id", "h")] + [x], ["doc_id", "h", "x"])

    described = texts.mapInArrow(describe, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long, x array<double>")
    rows = described.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min_by("x", F.struct("h", "x")).alias("x"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(partitions(docs.sparkSession))))
    order = Window.partitionBy("label", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    return cut(rows.select("label", "part", F.row_number().over(order).cast("long").alias("number"), "x"))


def _edges(rows: DataFrame) -> np.ndarray:
    """The borders of each feature's ranges: quantiles of all rows, up to the width of a bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                each = pd.DataFrame({"feature": np.tile(np.arange(x.shape[1]), len(x)), "bin": _bins(x.ravel()), "value": x.ravel()})
                found = each.groupby(["feature", "bin"], as_index=False).agg(n=("value", "size"), least=("value", "min"), most=("value", "max"))
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    counted = rows.select("x").mapInArrow(count, "feature long, bin long, n long, least double, most double")
    counted = counted.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas()  # bins, not rows
    edges = []
    for _, one in counted.sort_values(["feature", "bin"]).groupby("feature"):
        upto, most = one["n"].cumsum().to_numpy(), one["most"].to_numpy()
        inner = most[np.searchsorted(upto, np.linspace(0, 1, RANGES + 1)[1:-1] * upto[-1])]
        # The last range reaches the largest value, also where most rows have the same.
        edges.append([one["least"].iloc[0], *inner, max(inner[-1] + 1e-9, most[-1])])
    return np.array(edges)


def _pairs(rows: DataFrame, counts: dict[int, int], least: int = PAIRS) -> DataFrame:
    """good and bad, features of a row of each class, as a table: every row is in at least PARTNERS pairs, if the other class has so many.

    A row of the larger class meets rows of the smaller at several distances from its own rank, counted around.
    """
    spark = rows.sparkSession
    parts = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("label", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(F.broadcast(parts), ["label", "part"]).select("label", (F.col("before") + F.col("number") - 1).alias("rank"), "x")
    larger, smaller = (1, 0) if counts[1] >= counts[0] else (0, 1)
    few = counts[smaller]
    times = min(few, max(PARTNERS, -(-least // counts[larger])))
    steps = spark.range(times).select((F.col("id") * (few // times)).alias("step"))
    names = {1: "good", 0: "bad"}
    many = ranked.where(F.col("label") == larger).crossJoin(F.broadcast(steps)).select(F.pmod(F.col("rank") + F.col("step"), F.lit(few)).alias("rank"), F.col("x").alias(names[larger]))
    return cut(many.join(ranked.where(F.col("label") == smaller).select("rank", F.col("x").alias(names[smaller])), "rank").select("good", "bad"))


def _sums(pairs: DataFrame, model: BradleyTerry) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Number of pairs, and sums over them of the logistic loss, its gradient and its second derivatives at the model's weights."""
    k = len(model.weights)

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, first, second = 0, 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                d = model.ranges(_matrix(some.column("good"))) - model.ranges(_matrix(some.column("bad")))
                margin = d @ model.weights
                p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
                n, loss, first = n + len(d), loss + float(np.logaddexp(0, -margin).sum()), first - d.T @ p
                second += d.T @ (d * (p * (1 - p))[:, None])
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "sums": [np.concatenate([[n, loss], first, second.ravel()])]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In the order of tasks, so that a rerun adds the same numbers."""
        found = {t: s for batch in batches for t, s in zip(batch.column("task").to_pylist(), _matrix(batch.column("sums")), strict=True)}
        if found:
            yield pa.RecordBatch.from_pydict({"task": [min(found)], "sums": [np.sum([found[t] for t in sorted(found)], axis=0)]})

    shape = "task long, sums array<double>"
    few = pairs.mapInArrow(derive, shape).repartition(8, "task").mapInArrow(add, shape).toPandas().sort_values("task")  # at most 8 rows
    total = np.sum(np.stack(few["sums"].to_numpy()), axis=0)
    return total[0], total[1], total[2 : 2 + k], total[2 + k :].reshape(k, k)


def _weights(pairs: DataFrame, edges: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """The weights of least mean logistic loss over all pairs, with a penalty on their squares, by Newton's steps; a step that makes it worse is halved."""
    here, best, step = np.zeros(edges.shape[0] * RANGES), np.inf, None
    for _ in range(rounds):
        n, loss, first, second = _sums(pairs, BradleyTerry(edges, here))
        value = loss / n + penalty / 2 * here @ here
        if value > best + 1e-12:
            step = step / 2
            here = here - step
            continue
        best, slope = value, first / n + penalty * here
        step = -np.linalg.solve(second / n + penalty * np.eye(len(here)), slope)
        if -slope @ step < 1e-6:
            break
        here = here + step
    return here


def _threshold(rows: DataFrame, model: BradleyTerry) -> float:
    """Where rows are rejected below with the fewest errors of all labelled rows, in the middle where several places have; up to the width of a bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column("x")))
                each = pd.DataFrame({"bin": _bins(raw), "raw": raw, "good": batch.column("label").to_numpy()})
                found = each.groupby("bin", as_index=False).agg(n=("raw", "size"), good=("good", "sum"), least=("raw", "min"), most=("raw", "max"))
                yield pa.RecordBatch.from_pandas(found.astype({"good": "int64"}), preserve_index=False)

    counted = rows.select("label", "x").mapInArrow(count, "bin long, n long, good long, least double, most double")
    bins = counted.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas().sort_values("bin")
    good, bad = bins["good"].to_numpy(), (bins["n"] - bins["good"]).to_numpy()
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(bad[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    borders = np.concatenate([[bins["least"].iloc[0] - 1], (bins["most"].to_numpy()[:-1] + bins["least"].to_numpy()[1:]) / 2, [bins["most"].iloc[-1] + 1]])
    return float(borders[best[len(best) // 2]])


def fit_quality(docs: DataFrame, labels: DataFrame, at: float = 0.3, column: str = "quality") -> BradleyTerry:
    """A model from all labelled rows that aren't held out: ranges, weights and threshold are fitted where the rows are; only sums come to the driver.

    Rows of labels without doc_id, or with another label than 0 and 1, teach nothing; without rows of both classes every
    score is neutral.
    """
    rows = learned_rows(docs, labels, column)
    counts = {0: 0, 1: 0} | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(counts.values()):
        forget(rows)
        k = len(features(b""))
        return BradleyTerry(np.zeros((k, RANGES + 1)), np.zeros(k * RANGES), at=at)
    edges = _edges(rows)
    pairs = _pairs(rows, counts)
    model = BradleyTerry(edges, _weights(pairs, edges), at=at)
    forget(pairs)
    model.shift = _threshold(rows, model)
    forget(rows)
    return model


def score_quality(docs: DataFrame, model: BradleyTerry, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if the score is at the model's threshold or above), under these names.

    Whole texts are scored, however long, and nothing but the text counts; null is as empty, and an empty text has a score
    too. Equal texts have equal scores; repeated rows are rows of their own. An empty table gives no rows. Columns of docs
    that are named like an output column are replaced.
    """

    def answer(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts.cast(pa.binary()).to_pylist()]).reshape(len(texts), -1)
        return pa.array(model.score(x) if len(x) else np.zeros(0), pa.float64())

    scored = without(docs, score, predicted).withColumn(score, over_texts(lambda: answer, "double")(text_or_empty()))
    return scored.withColumn(predicted, (F.col(score) >= model.at).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), at=0.3)
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
