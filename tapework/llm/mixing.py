"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source queues its documents in a shuffled order, up to max_epochs times over. A queued copy's virtual finish
time is the source's words up to and with it, divided by the source's target. All copies in order of finish time, cut
at the total budget, are the mix.

Skew: running sums go over ranges of the shuffle order and over ranges of the finish time, each as many as the
session's partitions ask for, and the ranges' totals are summed up in small tables; so no source and no stretch of
the queue lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, cut, partitions, text_or_empty, unused, without

RANGES_PER_PARTITION = 4


def _ticket() -> Column:
    """A document's place in the shuffled order of its source: null and empty values, and where one ends and the next begins, are told apart."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("-")) for c in (F.col("doc_id").cast("string"), F.col("source").cast("string"), text_or_empty())]
    return F.md5(F.concat(*parts))


def fill_levels(sources: DataFrame, weight: str, budget: Column, max_epochs: int) -> DataFrame:
    """sources with fill: budget dealt out by weight so that no source gets over max_epochs * source_size.

    The source with the smallest cap for its weight is the first to be full; what is left goes to the others by weight.
    In that order, the first source whose cap the level doesn't exceed sets the level of all that follow.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    order = Window.orderBy("_ratio", "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = sources.withColumn("_ratio", cap / F.col(weight))
    at = at.withColumn("_level", (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum(weight).over(after))
    not_full = F.col("_ratio") >= F.col("_level")
    at = at.withColumn("_open", F.max(F.when(not_full, F.col("_level"))).over(everything))
    return at.withColumn("fill", F.when(not_full, F.col("_open") * F.col(weight)).otherwise(cap).cast("double")).drop("_ratio", "_level", "_open")


def mix_plan(docs: DataFrame, weights: Column | None = None, max_epochs: int = 3) -> DataFrame:
    """doc_id, ticket, copies, size, source_size, target and taken for each distinct row of docs (doc_id, source, text).

    size: the words (runs of anything but blanks) of the text; 0 for null. copies: how many rows are equal; they queue
    together, and taken (words, repeats counted) is of each. See mix().
    """
    weights = F.lit(1) + F.pmod(F.col("source_rank") - 1, F.lit(3)) if weights is None else weights
    n_ranges = RANGES_PER_PARTITION * partitions(docs.sparkSession)
    words = F.regexp_count(text_or_empty(), F.lit(f"[^{BLANK_CLASS}]+")).cast("long")
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key.alias("source_key"), words.alias("size"), _ticket().alias("ticket"))
    rows = rows.groupBy("ticket", "source_key", "source", "size", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    share = F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    rows = cut(rows.withColumn("range", F.floor(share * n_ranges)).withColumn("words", F.col("size") * F.col("copies")))

    by_range = cut(rows.groupBy("source_key", "range").agg(F.first("source").alias("source"), F.sum("words").alias("range_words"), F.max("words").alias("largest")))
    sources = by_range.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("range_words").alias("source_size"), F.max("largest").alias("largest"))
    sources = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    everything = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("weight", weights).withColumn("budget", F.sum("source_size").over(everything))
    sources = fill_levels(sources, "weight", F.col("budget"), max_epochs).withColumnRenamed("fill", "target")
    # By this finish time the sources have passed the budget even if each is short of its largest document.
    sources = sources.withColumns({"_reach": F.col("budget") + F.sum("largest").over(everything), "_by": F.greatest(F.col("target"), F.lit(1e-9))})
    sources = fill_levels(sources, "_by", F.col("_reach"), max_epochs)
    sources = sources.withColumn("latest", F.max(F.try_divide(F.col("fill"), F.col("target"))).over(everything))
    sources = cut(sources.select("source_key", "source_size", "target", "budget", "latest"))

    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.withColumn("words_before", F.coalesce(F.sum("range_words").over(earlier), F.lit(0))).join(sources, "source_key")
    offsets = offsets.select("source_key", "range", "words_before", "source_size", "target", "budget", "latest")
    inside = Window.partitionBy("source_key", "range").orderBy("ticket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = rows.withColumn("words_here", F.sum("words").over(inside)).join(offsets, ["source_key", "range"])
    queue = cut(queue.select("doc_id", "ticket", "copies", "size", "words", "source_size", "target", "budget", "latest", (F.col("words_before") + F.col("words_here")).alias("upto")))

    def finish(epoch: Column) -> Column:
        return F.try_divide((epoch * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))

    again = queue.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("finish", finish(F.col("epoch")))
    again = again.where("finish <= latest").withColumn("stretch", F.floor(F.col("finish") / F.col("latest") * n_ranges))
    again = again.select("stretch", "finish", "ticket", "words", "budget")
    stretches = again.groupBy("stretch").agg(F.sum("words").alias("stretch_words"))
    sofar = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("taken_before", F.coalesce(F.sum("stretch_words").over(sofar), F.lit(0)))
    order = Window.partitionBy("stretch").orderBy("finish", "ticket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = again.withColumn("taken_here", F.sum("words").over(order)).join(stretches, "stretch")
    last = line.where(F.col("taken_before") + F.col("taken_here") <= F.col("budget")).agg(F.max(F.struct("finish", "ticket")).alias("last")).first()["last"]
    times = F.lit(0)
    if last is not None:
        place = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["ticket"]).alias("ticket"))
        for epoch in range(max_epochs):
            times += F.when(F.struct(finish(F.lit(epoch)).alias("finish"), F.col("ticket").alias("ticket")) <= place, 1).otherwise(0)
    taken = F.when(F.col("size") > 0, times * F.col("size")).otherwise(0).cast("long")
    return queue.select("doc_id", "ticket", "copies", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: Column | None = None, max_epochs: int = 3) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes of each document, repeats counted.

    weights: an expression over source_rank, the 1-based place of the source by code point with null last; by default
    1, 2, 3, 1, 2, 3 and so on. The targets share all sizes by weight; a target stops at max_epochs times its source's
    size and the excess is shared again. A document of size 0 is never taken. Rows equal in doc_id, source and text
    queue together and are taken alike. Reruns agree, as the shuffle order is an md5 of the row. doc_id, source and text
    may be null. An empty table gives no rows. Columns of docs that are named like an output column are replaced.
    """
    ticket, key = unused(docs, "_ticket"), unused(docs, "_own_ticket")
    # Documents of one ticket are equal in doc_id, source and text, so they have one row in the plan.
    plan = mix_plan(docs, weights, max_epochs).select(F.col("ticket").alias(ticket), "size", "source_size", "target", "taken")
    own = without(docs, "size", "source_size", "target", "taken")
    return own.withColumn(key, _ticket()).join(plan, F.col(key) == F.col(ticket)).drop(key, ticket)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed at weights 1, 2, 3."""
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = plan.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(length(doc_id::VARCHAR) || '=' || doc_id, '-') || coalesce(length(source) || '=' || source, '-') || length(coalesce(text, '')) || '=' || coalesce(text, '')) AS ticket
  FROM documents
), rows AS (
  SELECT doc_id, source, source_key, size, ticket, count(*) AS copies, sum(size) AS words FROM docs GROUP BY doc_id, source, source_key, size, ticket
), ranked AS (
  SELECT source_key, source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight,
         sum(source_size) OVER () AS budget
  FROM (SELECT source_key, any_value(source) AS source, sum(words)::BIGINT AS source_size FROM rows GROUP BY source_key)
), leveled AS (
  SELECT *, 3 * source_size / weight AS ratio,
         (budget - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT source_key, source_size, budget,
         CASE WHEN ratio >= level THEN max(CASE WHEN ratio >= level THEN level END) OVER () * weight ELSE (3 * source_size)::DOUBLE END AS target
  FROM leveled
), queue AS (
  SELECT rows.*, source_size, target, budget,
         sum(words) OVER (PARTITION BY source_key ORDER BY ticket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows JOIN targets USING (source_key)
), again AS (
  SELECT queue.*, (epoch * source_size + upto)::DOUBLE / target AS finish
  FROM queue, (VALUES (0), (1), (2)) AS epochs(epoch) WHERE size > 0
), line AS (
  SELECT ticket, finish, sum(words) OVER (ORDER BY finish, ticket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS reached FROM again
), takes AS (
  SELECT ticket, count(*) AS times FROM line WHERE reached GROUP BY ticket
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (coalesce(times, 0) * size)::BIGINT AS taken
FROM (SELECT queue.*, unnest(range(copies)) FROM queue) AS q LEFT JOIN takes USING (ticket)
"""
