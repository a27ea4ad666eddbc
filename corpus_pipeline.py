"""The training-corpus pipeline: stages that each read the table that the one before wrote.

Every stage takes (spark, docs, sf_dir). The labels that the first one learns from are in sf_dir. Stages read doc_id, text,
source and n_chars of docs and keep all other columns, whatever they are named. doc_id, source and text may be null (a null text
is an empty one), repeated rows are documents of their own until the near-dedup stage, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework.llm import line_dedup as lines
from tapework.llm import mixing, packing, quality, simhash
from tapework.llm.common import cut

READ = {"doc_id", "text", "source", "n_chars"}
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _any_columns(stage: Stage) -> Stage:
    """The stage over docs whose further columns can't clash with an operator's own: they have other names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_other{k}" for k, c in enumerate(docs.columns) if c not in READ}
        return stage(spark, docs.toDF(*[names.get(c, c) for c in docs.columns]), sf_dir).withColumnsRenamed({v: k for k, v in names.items()})

    return run


@_any_columns
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality threshold go."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), at=0.3)
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


@_any_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more share go; n_chars follows the text."""
    kept = lines.line_dedup(docs, min_docs=10, min_chars=1)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


@_any_columns
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, verified to be shared by 0.8 or more."""
    return simhash.near_dedup(docs, shingle=5, radius=17, least=0.8)


@_any_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it doesn't take go."""
    mixed = mixing.mix(docs).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))).alias("_time")
    return mixed.select(*docs.columns, times).drop("_time")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, as the pieces that they hold."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
