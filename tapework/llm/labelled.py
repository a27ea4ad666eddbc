"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty


def held_out(doc_id: str = "doc_id", fold: int = 5, remainder: int = 0) -> Column:
    """True for the rows that no model learns from: crc32 of the id as text leaves this remainder. False for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(fold)) == remainder, F.lit(False))


def sample_labels(labels: DataFrame, column: str, per_class: dict[int, int], fold: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id and label of at most so many learnable rows of each class, taken by a hash of doc_id; other labels don't count."""
    parts = []
    for value, most in per_class.items():
        rows = labels.where((F.col(column) == value) & F.col("doc_id").isNotNull() & ~held_out(fold=fold, remainder=remainder))
        parts.append(rows.select("doc_id", F.lit(value).alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """label and text of the sampled documents, written to a table. sample is bounded by its maker, so it goes to every task.

    A doc_id that several documents have gives one text, that of the smallest hash; so the table isn't longer than the sample.
    """
    found = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("text")).join(F.broadcast(sample), F.col("_id") == F.col("doc_id"))
    return cut(found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("label", "text"))
