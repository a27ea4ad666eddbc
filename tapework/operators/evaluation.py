"""Quality evaluation: samples, totals, gates, duplicates, fingerprints, usage and decision metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "item_id"
DECISION_COLUMNS = ["corrections", "applied_deletions", "rejected_deletions", "prompt_tokens", "completion_tokens", "total_tokens"]
FEEDBACK_COLUMNS = ["restored_deletions", "user_deletions", "text_edits", "split_edits", "merge_edits", "title_edits", "cover_edits"]
USAGE_COLUMNS = ["asr_audio_seconds", "prompt_tokens", "completion_tokens", "total_tokens", "input_bytes", "output_bytes", "work_bytes"]
MIB = 1024 * 1024


def evaluation_samples(items: DataFrame, decisions: DataFrame, feedback: DataFrame, stages: DataFrame) -> DataFrame:
    """One row for each item with what is known of it and the flags has_ai_decisions, has_user_feedback, has_completed_review, eligible.

    items: item_id, status, source_fingerprint, output_count, source_seconds. decisions, feedback (with review_complete and
    refinement_seconds) and stages (pipeline_seconds) have at most a row for each item. An item is eligible if it is done,
    has a source and an output.
    """
    out = items.join(decisions.withColumn("has_ai_decisions", F.lit(True)), ITEM, "left").join(feedback.withColumn("has_user_feedback", F.lit(True)), ITEM, "left").join(stages, ITEM, "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_ai_decisions", "has_user_feedback")}
    flags["has_completed_review"] = F.coalesce("review_complete", F.lit(False))
    flags["eligible"] = (F.coalesce("status", F.lit("")) == "done") & (F.coalesce("source_fingerprint", F.lit("")) != "") & (F.coalesce("output_count", F.lit(0)) > 0)
    numbers = {c: F.coalesce(c, F.lit(0)).cast("long") for c in DECISION_COLUMNS + FEEDBACK_COLUMNS}
    seconds = {c: F.coalesce(c, F.lit(0.0)) for c in ("source_seconds", "pipeline_seconds", "refinement_seconds")}
    return out.withColumns(flags | numbers | seconds).drop("review_complete")


def evaluation_metrics(samples: DataFrame) -> DataFrame:
    """One row of totals and ratios: automatic ones over eligible items, human ones over those with a completed review too."""
    auto, human = F.col("eligible"), F.col("eligible") & F.col("has_completed_review")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    sums = [total(c, auto).alias(c) for c in DECISION_COLUMNS] + [total(c, human).alias(c) for c in FEEDBACK_COLUMNS]
    sums += [total("applied_deletions", human).alias("reviewed_applied_deletions"), total("source_seconds", auto).alias("source_seconds"), total("pipeline_seconds", auto).alias("pipeline_seconds"), total("refinement_seconds", human).alias("manual_refinement_seconds"), F.count_if(human).alias("_reviews")]
    row = samples.agg(*sums)
    ratio = lambda a, b, places: F.round(F.try_divide(F.col(a).cast("double"), b.cast("double")), places)
    row = row.withColumns(
        {
            "deletion_restore_rate": ratio("restored_deletions", F.col("reviewed_applied_deletions"), 4),
            "segmentation_rework_events": F.col("split_edits") + F.col("merge_edits"),
            "processing_seconds_per_source_minute": ratio("pipeline_seconds", F.col("source_seconds") / 60, 3),
            "average_manual_refinement_seconds": ratio("manual_refinement_seconds", F.col("_reviews"), 3),
        }
    )
    return row.drop("_reviews")


def evaluation_summary(samples: DataFrame, target: int = 20) -> DataFrame:
    """One row of counts, the gates at target, and what is missing to reach them."""
    eligible = F.col("eligible")
    prints = F.count_distinct(F.when(eligible & (F.col("source_fingerprint") != ""), F.col("source_fingerprint")))
    row = samples.agg(
        F.count(F.lit(1)).alias("all_items"), F.count_if(eligible).alias("eligible_items"), prints.alias("unique_eligible_sources"),
        F.count_if(eligible & F.col("has_ai_decisions")).alias("items_with_ai_decisions"), F.count_if(eligible & F.col("has_user_feedback")).alias("items_with_user_feedback"),
        F.count_if(eligible & F.col("has_completed_review")).alias("items_with_completed_review"),
    )
    short = lambda c, what: F.when(F.col(c) < target, F.concat((F.lit(target) - F.col(c)).cast("string"), F.lit(f" more {what}")))
    gaps = F.array_compact(F.array(short("unique_eligible_sources", "sources"), short("items_with_ai_decisions", "decisions"), short("items_with_completed_review", "reviews")))
    ready = (F.col("items_with_ai_decisions") >= target) & (F.col("items_with_completed_review") >= target)
    return row.withColumns({"fixed_set_ready": F.col("unique_eligible_sources") >= target, "quality_evidence_ready": ready, "gaps": F.array_join(gaps, "; ")})


def duplicate_sources(samples: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Samples whose fingerprint an earlier one by key has: key, fingerprint, first_key. The first is a minimum, so no group is gathered."""
    first = samples.where(F.coalesce(fingerprint, F.lit("")) != "").groupBy(fingerprint).agg(F.min(key).alias("first_key"))
    return samples.join(first, fingerprint).where(F.col(key) > F.col("first_key")).select(key, fingerprint, "first_key")


def fingerprint(content: Column) -> Column:
    """sha256 of the size as text, the first MiB, and the last MiB of contents that are larger. content: binary."""
    size = F.octet_length(content)
    head, tail = F.substring(content, 1, MIB), F.when(size > MIB, F.substring(content, -MIB, MIB)).otherwise(F.lit(b""))
    return F.sha2(F.concat(size.cast("string").cast("binary"), head, tail), 256)


def stage_elapsed(events: DataFrame, first: str, last: str) -> DataFrame:
    """item_id and seconds from the first event of stage `first` to the last of stage `last`; 0 if one is missing or they are reversed.

    events: item_id, stage and updated_at, text.
    """
    at = F.unix_micros(F.col("updated_at").try_cast("timestamp"))
    sides = events.groupBy(ITEM).agg(F.min(F.when(F.col("stage") == first, at)).alias("_a"), F.max(F.when(F.col("stage") == last, at)).alias("_b"))
    return sides.select(ITEM, F.greatest(F.lit(0.0), F.coalesce((F.col("_b") - F.col("_a")) / 1_000_000, F.lit(0.0))).alias("seconds"))


def usage_rollup(items: DataFrame, job: str) -> DataFrame:
    """The usage columns summed up for each job."""
    return items.groupBy(job).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE_COLUMNS])


def _sets(df: DataFrame, *parts: Column) -> DataFrame:
    """parts of df by provider and model, by each and overall; * stands for all of them."""
    sets = df.groupingSets([["provider", "model"], ["provider"], ["model"], []], "provider", "model").agg(*parts)
    return sets.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("provider", "model")})


def decision_metrics(traces: DataFrame, exact: bool = False, k: int = 2048) -> DataFrame:
    """Calls, errors, retries, cache hits, tokens and latency by provider, by model, by both and overall (grouping sets).

    traces: provider, model, status, attempts, cache_hit, total_tokens, latency_ms. They are summed up once, by provider and model, and the
    other sets are made from those sums. Latencies are held as quantile sketches of size k, which merge; a percentile from one is a latency
    whose rank is off by a small part of the calls (about .002 of them for k of 2,048). exact gives percentiles between latencies
    instead, and keeps every distinct latency of a set, in one task for the overall one. Without any latency percentiles are null.
    """
    ok = F.col("status") == "ok"
    sums = [
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(~ok, 1.0).otherwise(0.0)).alias("_errors"), F.sum(F.col("attempts") - 1).alias("retries"), F.count_if("cache_hit").alias("cache_hits"),
        F.sum("total_tokens").alias("total_tokens"), F.bool_and(ok).alias("_ok"),
    ]
    if exact:
        sets = _sets(traces, *sums, *[F.percentile("latency_ms", q).alias(f"_p{q * 100:.0f}") for q in (0.5, 0.95)])
    else:
        by_both = traces.groupBy("provider", "model").agg(*sums, F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("_sketch"))
        again = [F.sum(c).alias(c) for c in ("calls", "_errors", "retries", "cache_hits", "total_tokens")]
        sets = _sets(by_both, *again, F.bool_and("_ok").alias("_ok"), F.kll_merge_agg_double("_sketch", k).alias("_sketch"))
        some = F.kll_sketch_get_n_double("_sketch") > 0
        sets = sets.withColumns({f"_p{q * 100:.0f}": F.when(some, F.kll_sketch_get_quantile_double(F.col("_sketch"), F.lit(q))) for q in (0.5, 0.95)})
    return sets.select(
        "provider", "model", "calls", F.round(F.col("_errors") / F.col("calls"), 6).alias("error_rate"), "retries", "cache_hits", "total_tokens",
        F.round("_p50", 6).alias("latency_p50"), F.round("_p95", 6).alias("latency_p95"), F.when(F.col("_ok"), "ai").otherwise("mixed").alias("state"),
    )


def quantile_errors(traces: DataFrame, metrics: DataFrame) -> DataFrame:
    """How far the percentiles of metrics are off, by a second pass over traces: provider, model, calls, error_p50, error_p95.

    An error is the smallest difference between the percentile asked for and the part of the set's latencies below, or not above, the one given.
    """
    asked = metrics.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "latency_p50", "latency_p95")
    either = lambda c: F.explode(F.array_distinct(F.array(F.coalesce(c, F.lit("*")), F.lit("*"))))
    rows = traces.where("latency_ms IS NOT NULL").select(either("provider").alias("provider"), "model", "latency_ms").select("provider", either("model").alias("model"), "latency_ms")
    met = rows.join(asked, (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")))
    value = F.round("latency_ms", 6)
    share = {q: [F.avg(F.when(value < F.col(f"latency_p{q}"), 1.0).otherwise(0.0)), F.avg(F.when(value <= F.col(f"latency_p{q}"), 1.0).otherwise(0.0))] for q in (50, 95)}
    error = lambda q: F.greatest(F.lit(0.0), share[q][0] - q / 100, q / 100 - share[q][1]).alias(f"error_p{q}")
    return met.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("calls"), error(50), error(95))
