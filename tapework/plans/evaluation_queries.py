"""Evaluation and governance over orders, lineitem, documents, labels, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path, stored
from ..operators import evaluation, governance
from .conv import TURNS_SQL, conv_turns, table
from .interval_queries import SENTENCES_SQL, conv_sentences


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items; their lines as decisions, those that came back as feedback."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    done = F.when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    items = orders.select(F.col("o_orderkey").alias("item_id"), done.alias("status"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.md5((F.col("o_orderkey") % 97).cast("string"))).alias("source_fingerprint"), (F.col("o_orderkey") % 4).alias("output_count"), (F.col("o_orderkey") % 50).cast("double").alias("source_seconds"))
    n = lambda c: F.sum(c).cast("long")
    decisions = lines.where("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("item_id")).agg(n("l_linenumber").alias("corrections"), F.count(F.lit(1)).alias("applied_deletions"), n(F.col("l_linenumber") % 2).alias("rejected_deletions"), n(F.col("l_partkey") % 100).alias("prompt_tokens"), n(F.col("l_suppkey") % 10).alias("completion_tokens"), n(F.col("l_partkey") % 100 + F.col("l_suppkey") % 10).alias("total_tokens"))
    back = lines.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("item_id")).agg((F.max("l_linenumber") > 2).alias("review_complete"), F.count(F.lit(1)).alias("restored_deletions"), n(F.col("l_linenumber") % 3).alias("user_deletions"), n(F.col("l_linenumber") % 5).alias("text_edits"), n(F.col("l_partkey") % 2).alias("split_edits"), n(F.col("l_partkey") % 3).alias("merge_edits"), n(F.col("l_suppkey") % 2).alias("title_edits"), n(F.col("l_suppkey") % 3).alias("cover_edits"), n("l_linenumber").cast("double").alias("refinement_seconds"))
    stages = orders.select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 120).cast("double").alias("pipeline_seconds"))
    return evaluation.evaluation_samples(items, decisions, back, stages)


_SAMPLES = """
d AS (SELECT l_orderkey AS item_id, sum(l_linenumber)::BIGINT AS corrections, count(*) AS applied_deletions, sum(l_linenumber % 2)::BIGINT AS rejected_deletions, sum(l_partkey % 100)::BIGINT AS prompt_tokens, sum(l_suppkey % 10)::BIGINT AS completion_tokens, sum(l_partkey % 100 + l_suppkey % 10)::BIGINT AS total_tokens FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY ALL),
f AS (SELECT l_orderkey AS item_id, max(l_linenumber) > 2 AS review_complete, count(*) AS restored_deletions, sum(l_linenumber % 3)::BIGINT AS user_deletions, sum(l_linenumber % 5)::BIGINT AS text_edits, sum(l_partkey % 2)::BIGINT AS split_edits, sum(l_partkey % 3)::BIGINT AS merge_edits, sum(l_suppkey % 2)::BIGINT AS title_edits, sum(l_suppkey % 3)::BIGINT AS cover_edits, sum(l_linenumber)::DOUBLE AS refinement_seconds FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
samples AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE md5((o_orderkey % 97)::VARCHAR) END AS source_fingerprint, o_orderkey % 4 AS output_count,
  (o_orderkey % 50)::DOUBLE AS source_seconds, (o_orderkey % 120)::DOUBLE AS pipeline_seconds, coalesce(refinement_seconds, 0.0) AS refinement_seconds, d.item_id IS NOT NULL AS has_ai_decisions, f.item_id IS NOT NULL AS has_user_feedback, coalesce(review_complete, false) AS has_completed_review,
  o_orderstatus <> 'O' AND o_orderkey % 11 <> 0 AND o_orderkey % 4 > 0 AS eligible, coalesce(corrections, 0) AS corrections, coalesce(applied_deletions, 0) AS applied_deletions, coalesce(rejected_deletions, 0) AS rejected_deletions, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(total_tokens, 0) AS total_tokens,
  coalesce(restored_deletions, 0) AS restored_deletions, coalesce(user_deletions, 0) AS user_deletions, coalesce(text_edits, 0) AS text_edits, coalesce(split_edits, 0) AS split_edits, coalesce(merge_edits, 0) AS merge_edits, coalesce(title_edits, 0) AS title_edits, coalesce(cover_edits, 0) AS cover_edits
  FROM orders LEFT JOIN d ON d.item_id = o_orderkey LEFT JOIN f ON f.item_id = o_orderkey)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluation_metrics(_samples(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluation_summary(_samples(spark, sf_dir))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))
    return evaluation.duplicate_sources(docs, "doc_id", "fingerprint")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return docs.select("doc_id", evaluation.fingerprint(F.col("content")).alias("fingerprint"))


def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("stage"), F.col("ts").cast("string").alias("updated_at"))
    return evaluation.stage_elapsed(events, "view", "purchase")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select("l_orderkey", F.col("l_linenumber").cast("double").alias("asr_audio_seconds"), (F.col("l_partkey") % 1000).alias("prompt_tokens"), (F.col("l_suppkey") % 100).alias("completion_tokens"), (F.col("l_partkey") % 1000 + F.col("l_suppkey") % 100).alias("total_tokens"), (F.col("l_partkey") * 10).alias("input_bytes"), (F.col("l_suppkey") * 10).alias("output_bytes"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey")).alias("work_bytes"))
    return evaluation.usage_rollup(items, "l_orderkey")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), F.when(F.col("event_id") % 9 == 0, "failed").otherwise("ok").alias("status"), (1 + F.col("event_id") % 2).alias("attempts"), (F.col("event_id") % 4 == 0).alias("cache_hit"), (F.col("event_id") % 1000).alias("total_tokens"), (F.col("event_id") * 37 % 5003).cast("double").alias("latency_ms"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.decision_metrics(_traces(spark, sf_dir), exact=True)


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics from merged sketches, and whether their percentiles are within .005 of the calls."""
    rows = _traces(spark, sf_dir)
    metrics = stored(evaluation.decision_metrics(rows))
    errors = evaluation.quantile_errors(rows, metrics).select("provider", "model", (F.col("error_p50") <= 0.005).alias("p50_within"), (F.col("error_p95") <= 0.005).alias("p95_within"))
    return metrics.drop("latency_p50", "latency_p95").join(errors, ["provider", "model"])


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.snapshot(conv_sentences(spark, sf_dir)).select("item_id", "snapshot_sha256")


def _versions(spark: SparkSession, sf_dir: str) -> tuple:
    """Two versions of the conversation sentences: the final one differs in every way, by place."""
    lines = conv_sentences(spark, sf_dir)
    n = F.col("item_id") * 3 + F.col("timeline_order")
    tokens = F.array(F.concat("sentence_id", F.lit("-a")), F.concat("sentence_id", F.lit("-b")))
    base = lines.select("item_id", "sentence_id", "start_us", "end_us", "text", "remove_video", "timeline_order", F.lit("{}").alias("style"), tokens.alias("token_ids")).where(n % 13 != 0)
    changed = {
        "text": F.when(n % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "start_us": F.when(n % 7 == 0, F.col("start_us") + 5).otherwise(F.col("start_us")),
        "remove_video": F.when(n % 8 == 0, ~F.col("remove_video")).otherwise(F.col("remove_video")), "style": F.when(n % 9 == 0, "{b}").otherwise(F.lit("{}")),
        "token_ids": F.when(n % 10 == 0, F.slice(tokens, 1, 1)).otherwise(tokens), "timeline_order": F.when(n % 17 == 0, F.col("timeline_order") + 100).otherwise(F.col("timeline_order")),
    }
    final = lines.where(n % 14 != 0).withColumns(changed).select(*base.columns)
    items = lines.select("item_id").distinct()
    i = F.col("item_id")
    b_titles, a_titles = items.where(i % 4 != 0).select("item_id", F.lit("t001").alias("title_id"), F.lit("x").alias("value")), items.where(i % 5 != 0).select("item_id", F.lit("t001").alias("title_id"), F.when(i % 3 == 0, "y").otherwise("x").alias("value"))
    b_items = items.select("item_id", F.lit("c").alias("cover"), F.lit("white").alias("preset"), F.lit(0).alias("subtitle_offset"))
    a_items = items.select("item_id", F.when(i % 2 == 0, "d").otherwise("c").alias("cover"), F.when(i % 3 == 0, "black").otherwise("white").alias("preset"), (i % 2).cast("int").alias("subtitle_offset"))
    return base, final, b_titles, a_titles, b_items, a_items


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.diff_snapshots(*_versions(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("snapshot_sha256"))
    feedback = labels.join(docs, F.col("doc_id") == F.col("item_id")).select("item_id", F.when(F.col("quality") == 1, "completed").alias("review_status"), F.when(F.col("toxic") == 1, "old").otherwise(F.col("snapshot_sha256")).alias("reviewed_sha256"))
    return governance.review_state(feedback, docs)


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as feedback; an item has consent if its label has quality 1."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("raw_transcript"))
    labels = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("training_consent")).distinct()
    text = F.array_join(F.transform("raw_transcript", lambda t: t["text"]), "\n")
    result = lambda c: F.struct(c.alias("text"), F.lit("/x/y.mp4").alias("video_path"), F.lit("k").alias("api_key"))
    decision = F.struct(F.array(F.lit("c1")).alias("corrections"), F.lit("aggressive").alias("auto_edit_mode"), F.array(F.lit("d")).alias("delete_ranges"))
    return turns.join(labels, "item_id", "left").select(F.lit("job").alias("job_id"), "item_id", F.lit("2024-01-01T00:00:00").alias("updated_at"), "training_consent", "raw_transcript", result(text).alias("initial_result"), result(F.upper(text)).alias("final_result"), F.struct(F.array(F.col("item_id")).alias("added"), F.lit("secret").alias("access_token")).alias("user_changes"), decision.alias("ai_decision"))


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = governance.training_export(_feedback(spark, sf_dir))
    return records.select("id", "schema_version", F.size("prompt.raw_transcript").alias("turns"), F.col("prompt.auto_edit_mode").alias("mode"), F.md5("rejected.text").alias("rejected_md5"), F.to_json("user_changes").alias("user_changes"), F.array_join("ai_decision.corrections", ",").alias("corrections"), F.size("ai_decision.final_sentences").alias("final_sentences"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, a JSON text each, put beside keys that mustn't leave and under them, as text, as VARIANT and in a map; some are broken."""
    put = lambda a, b: F.concat(F.lit(a), F.coalesce("props", F.lit("{}")), F.lit(b))
    nested = put('{"Api_Key":"S3CRET","deep":[{"source_path":"/x","props":', '},{"authorization":{"k":"S3CRET"}}],"access_token":["S3CRET"]}')
    text = F.when(F.col("event_id") % 10 == 0, put('{"api_key":"S3CRET","props":', "")).otherwise(nested)
    extra = F.map_from_arrays(F.array(F.lit("source_path"), F.lit("API_KEY"), F.lit("kind"), F.lit("props")), F.array(F.lit("/x"), F.lit("k"), F.col("event_type"), nested))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("props"), text.alias("note"), F.parse_json(nested).alias("value"), extra.alias("extra"), F.lit("t").alias("access_token"), F.struct(F.col("user_id"), F.lit("v").alias("current_video")).alias("who"))
    clean = governance.redact(rows, json_columns=["props"])
    return clean.select("event_id", "props", "note", F.to_json("value").alias("value"), F.col("extra")["kind"].alias("kind"), F.col("extra")["props"].alias("extra_props"), F.size("extra").alias("extras"), F.to_json("who").alias("who"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback files made of orders and their lines, exported to JSON rows and read again, with how many were exported and skipped.

    One order in three has consent; one in fifty is a broken file.
    """
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("text"), F.lit("/x/y").alias("clip_path"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("raw_transcript"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    secret = F.struct(F.lit("S3CRET").alias("api_key"), F.col("o_orderstatus").alias("state"), F.to_json(F.struct(F.lit("S3CRET").alias("Authorization"), F.col("o_orderkey").alias("n"))).alias("settings"))
    file = F.struct(
        F.concat(F.lit("job-"), "o_custkey").alias("job_id"), F.col("o_orderkey").cast("string").alias("item_id"), F.lit("2024-01-01T00:00:00").alias("updated_at"), F.struct((F.col("o_orderkey") % 3 == 0).alias("training_consent")).alias("data_policy"),
        F.col("raw_transcript"), secret.alias("initial_result"), F.struct(F.array(secret).alias("sentences")).alias("final_result"), F.struct(F.array("o_orderkey").alias("corrections"), F.lit("aggressive").alias("auto_edit_mode"), F.lit("S3CRET").alias("volc_access_token")).alias("ai_decision"),
    )
    value = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("{"), F.to_json(file))).otherwise(F.to_json(file))
    path = shared_path(spark, "export")
    done, skipped = governance.write_training_export(governance.feedback_records(orders.select(value.alias("value"))), path)
    parts = ["id", "prompt", "rejected", "chosen", "ai_decision", "user_changes"]
    rows = spark.read.text(path).select("value", F.json_tuple("value", *parts).alias(*parts))
    return rows.select(
        "id", F.get_json_object("prompt", "$.auto_edit_mode").alias("mode"), F.size(F.from_json(F.get_json_object("prompt", "$.raw_transcript"), "array<struct<n:int>>")).cast("long").alias("lines"), "rejected", F.get_json_object("chosen", "$.sentences[0].state").alias("state"),
        F.get_json_object("ai_decision", "$.corrections").alias("corrections"), F.get_json_object("ai_decision", "$.final_sentences").alias("final_sentences"), "user_changes", (F.col("value").contains("S3CRET") | F.col("value").contains("_path")).alias("leaks"), F.lit(done).alias("exported"), F.lit(skipped).alias("skipped"),
    )


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    return governance.forget(docs, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id")))


def forgotten_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback and baseline of orders as two tables by priority and day of the month, after orders of two customers in a hundred are deleted from both."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey")
    feedback, baseline = shared_path(spark, "feedback"), shared_path(spark, "baseline")
    orders.hint("rebalance", "priority").write.partitionBy("priority").parquet(feedback)
    orders.hint("rebalance", "month").write.partitionBy("month").parquet(baseline)
    gone = orders.where("o_custkey % 50 = 7 OR month = '1995-03'").select("item_id")
    report = governance.forget_in_tables(spark, {feedback: ["priority"], baseline: ["month"]}, gone)
    read = lambda path, name: spark.read.parquet(path).select(F.lit(name).alias("name"), F.lit(path).alias("path"), "item_id")
    left = read(feedback, "feedback").unionByName(read(baseline, "baseline")).join(F.broadcast(report), "path")  # a row for each of two tables
    return left.select("name", "item_id", "partitions", "rewritten", "emptied", "deleted", F.col("left").alias("found"))


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    category = F.element_at(F.array(F.lit("repeat"), F.lit("filler"), F.lit("pause")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = events.select("event_id", (F.col("event_id") % 101 / 100).alias("confidence"), F.when(F.col("user_id") % 2 == 0, "low").otherwise("high").alias("risk"), category.alias("category"), (F.col("event_id") % 7 / 2).alias("seconds"))
    return governance.auto_apply(rows)


QUERIES = {
    "evaluation_samples": _samples, "evaluation_metrics": metrics, "evaluation_summary": summary, "duplicate_sources": duplicates, "fingerprint": prints, "stage_elapsed": elapsed,
    "usage_rollup": usage, "decision_metrics": traces, "decision_quantiles": quantiles, "snapshot": snapshots, "diff_snapshots": differences, "review_state": reviews, "training_export": export, "redact": redacted,
    "forget": forgotten, "forget_in_tables": forgotten_in_tables, "export_feedback": exported, "auto_apply_filter": applied,
}

_AUTO = ", ".join(f"coalesce(sum({c}) FILTER (WHERE eligible), 0)::BIGINT AS {c}" for c in evaluation.DECISION_COLUMNS)
_HUMAN = ", ".join(f"coalesce(sum({c}) FILTER (WHERE eligible AND has_completed_review), 0)::BIGINT AS {c}" for c in evaluation.FEEDBACK_COLUMNS)

ORACLE_SQL = {
    "evaluation_samples": f"WITH {_SAMPLES} SELECT * FROM samples",
    "evaluation_metrics": f"""WITH {_SAMPLES}, t AS (SELECT {_AUTO}, {_HUMAN}, coalesce(sum(applied_deletions) FILTER (WHERE eligible AND has_completed_review), 0)::BIGINT AS reviewed_applied_deletions, coalesce(sum(source_seconds) FILTER (WHERE eligible), 0) AS source_seconds, coalesce(sum(pipeline_seconds) FILTER (WHERE eligible), 0) AS pipeline_seconds, coalesce(sum(refinement_seconds) FILTER (WHERE eligible AND has_completed_review), 0) AS manual_refinement_seconds, count(*) FILTER (WHERE eligible AND has_completed_review) AS reviews FROM samples)
      SELECT * EXCLUDE (reviews), round(restored_deletions / nullif(reviewed_applied_deletions, 0), 4) AS deletion_restore_rate, split_edits + merge_edits AS segmentation_rework_events, round(pipeline_seconds / nullif(source_seconds / 60, 0), 3) AS processing_seconds_per_source_minute, round(manual_refinement_seconds / nullif(reviews, 0), 3) AS average_manual_refinement_seconds FROM t""",
    "evaluation_summary": f"""WITH {_SAMPLES}, t AS (SELECT count(*) AS all_items, count(*) FILTER (WHERE eligible) AS eligible_items, count(DISTINCT source_fingerprint) FILTER (WHERE eligible AND source_fingerprint <> '') AS unique_eligible_sources, count(*) FILTER (WHERE eligible AND has_ai_decisions) AS items_with_ai_decisions, count(*) FILTER (WHERE eligible AND has_user_feedback) AS items_with_user_feedback, count(*) FILTER (WHERE eligible AND has_completed_review) AS items_with_completed_review FROM samples)
      SELECT *, unique_eligible_sources >= 20 AS fixed_set_ready, items_with_ai_decisions >= 20 AND items_with_completed_review >= 20 AS quality_evidence_ready, concat_ws('; ', CASE WHEN unique_eligible_sources < 20 THEN 20 - unique_eligible_sources || ' more sources' END, CASE WHEN items_with_ai_decisions < 20 THEN 20 - items_with_ai_decisions || ' more decisions' END, CASE WHEN items_with_completed_review < 20 THEN 20 - items_with_completed_review || ' more reviews' END) AS gaps FROM t""",
    "duplicate_sources": "WITH p AS (SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint FROM documents) SELECT * FROM (SELECT doc_id, fingerprint, min(doc_id) OVER (PARTITION BY fingerprint) AS first_key FROM p) WHERE doc_id > first_key",
    "fingerprint": "SELECT doc_id, sha256(octet_length(encode(coalesce(text, ''))) || coalesce(text, '')) AS fingerprint FROM documents",
    "stage_elapsed": "SELECT user_id AS item_id, greatest(0.0, coalesce((epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) - epoch_us(min(ts) FILTER (WHERE event_type = 'view'))) / 1000000, 0.0))::DOUBLE AS seconds FROM events GROUP BY user_id",
    "usage_rollup": "SELECT l_orderkey, sum(l_linenumber)::DOUBLE AS asr_audio_seconds, sum(l_partkey % 1000)::BIGINT AS prompt_tokens, sum(l_suppkey % 100)::BIGINT AS completion_tokens, sum(l_partkey % 1000 + l_suppkey % 100)::BIGINT AS total_tokens, sum(l_partkey * 10)::BIGINT AS input_bytes, sum(l_suppkey * 10)::BIGINT AS output_bytes, sum(CASE WHEN l_linenumber > 2 THEN l_partkey ELSE 0 END)::BIGINT AS work_bytes FROM lineitem GROUP BY l_orderkey",
    "decision_metrics": """WITH t AS (SELECT event_type AS provider, 'm' || user_id % 5 AS model, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, 1 + event_id % 2 AS attempts, event_id % 4 = 0 AS cache_hit, event_id % 1000 AS total_tokens, (event_id * 37 % 5003)::DOUBLE AS latency_ms FROM events)
      SELECT coalesce(provider, '*') AS provider, coalesce(model, '*') AS model, count(*) AS calls, round(avg(CASE WHEN status <> 'ok' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate, sum(attempts - 1)::BIGINT AS retries, count(*) FILTER (WHERE cache_hit) AS cache_hits, sum(total_tokens)::BIGINT AS total_tokens, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, CASE WHEN bool_and(status = 'ok') THEN 'ai' ELSE 'mixed' END AS state FROM t GROUP BY GROUPING SETS ((provider, model), (provider), (model), ())""",
    "decision_quantiles": """WITH t AS (SELECT event_type AS provider, 'm' || user_id % 5 AS model, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, 1 + event_id % 2 AS attempts, event_id % 4 = 0 AS cache_hit, event_id % 1000 AS total_tokens, (event_id * 37 % 5003)::DOUBLE AS latency_ms FROM events)
      SELECT coalesce(provider, '*') AS provider, coalesce(model, '*') AS model, count(*) AS calls, round(avg(CASE WHEN status <> 'ok' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate, sum(attempts - 1)::BIGINT AS retries, count(*) FILTER (WHERE cache_hit) AS cache_hits, sum(total_tokens)::BIGINT AS total_tokens, true AS p50_within, true AS p95_within, CASE WHEN bool_and(status = 'ok') THEN 'ai' ELSE 'mixed' END AS state FROM t GROUP BY GROUPING SETS ((provider, model), (provider), (model), ())""",
    "snapshot": f"WITH {TURNS_SQL}, {SENTENCES_SQL} SELECT item_id, sha256(to_json(list({{'timeline_order': timeline_order, 'sentence_id': sentence_id, 'start_us': start_us, 'end_us': end_us, 'text': text, 'enabled': enabled, 'remove_video': remove_video}} ORDER BY timeline_order, sentence_id))) AS snapshot_sha256 FROM conv_sentences GROUP BY item_id",
    "diff_snapshots": f"""WITH {TURNS_SQL}, {SENTENCES_SQL},
      b AS (SELECT item_id, sentence_id, start_us, end_us, text, remove_video, timeline_order, '{{}}' AS style, sentence_id || '-b' AS last_token FROM conv_sentences WHERE (item_id * 3 + timeline_order) % 13 <> 0),
      a AS (SELECT item_id, sentence_id, CASE WHEN n % 7 = 0 THEN start_us + 5 ELSE start_us END AS start_us, end_us, CASE WHEN n % 6 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN n % 8 = 0 THEN NOT remove_video ELSE remove_video END AS remove_video,
        CASE WHEN n % 17 = 0 THEN timeline_order + 100 ELSE timeline_order END AS timeline_order, CASE WHEN n % 9 = 0 THEN '{{b}}' ELSE '{{}}' END AS style, sentence_id || CASE WHEN n % 10 = 0 THEN '-a' ELSE '-b' END AS last_token
        FROM (SELECT *, item_id * 3 + timeline_order AS n FROM conv_sentences) WHERE n % 14 <> 0),
      bb AS (SELECT item_id, last_token FROM (SELECT *, lead(sentence_id) OVER (PARTITION BY item_id ORDER BY timeline_order, sentence_id) AS nx FROM b) WHERE nx IS NOT NULL),
      ab AS (SELECT item_id, last_token FROM (SELECT *, lead(sentence_id) OVER (PARTITION BY item_id ORDER BY timeline_order, sentence_id) AS nx FROM a) WHERE nx IS NOT NULL),
      items AS (SELECT DISTINCT item_id AS i FROM conv_sentences),
      kept AS (SELECT b.item_id, b.sentence_id AS key, b, a FROM b JOIN a ON a.item_id = b.item_id AND a.sentence_id = b.sentence_id)
      SELECT item_id, 'restored' AS change, sentence_id AS key, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM b WHERE remove_video AND NOT EXISTS (SELECT 1 FROM a WHERE a.item_id = b.item_id AND a.sentence_id = b.sentence_id AND a.remove_video)
      UNION ALL SELECT item_id, 'removed', sentence_id, NULL, NULL FROM a WHERE remove_video AND NOT EXISTS (SELECT 1 FROM b WHERE a.item_id = b.item_id AND a.sentence_id = b.sentence_id AND b.remove_video)
      UNION ALL SELECT item_id, 'added', sentence_id, NULL, NULL FROM a ANTI JOIN b USING (item_id, sentence_id)
      UNION ALL SELECT item_id, 'missing', sentence_id, NULL, NULL FROM b ANTI JOIN a USING (item_id, sentence_id)
      UNION ALL SELECT item_id, 'text', key, b.text, a.text FROM kept WHERE b.text <> a.text
      UNION ALL SELECT item_id, 'timing', key, b.start_us || '-' || b.end_us, a.start_us || '-' || a.end_us FROM kept WHERE b.start_us <> a.start_us
      UNION ALL SELECT item_id, 'order', key, b.timeline_order::VARCHAR, a.timeline_order::VARCHAR FROM kept WHERE b.timeline_order <> a.timeline_order
      UNION ALL SELECT item_id, 'style', key, b.style, a.style FROM kept WHERE b.style <> a.style
      UNION ALL (SELECT item_id, 'split', last_token, NULL, NULL FROM (SELECT * FROM ab EXCEPT SELECT * FROM bb))
      UNION ALL (SELECT item_id, 'merged', last_token, NULL, NULL FROM (SELECT * FROM bb EXCEPT SELECT * FROM ab))
      UNION ALL SELECT i, 'title', 't001', CASE WHEN i % 4 <> 0 THEN 'x' END, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 3 = 0 THEN 'y' ELSE 'x' END FROM items WHERE NOT (i % 4 = 0 AND i % 5 = 0) AND (i % 4 = 0 OR i % 5 = 0 OR i % 3 = 0)
      UNION ALL SELECT i, 'cover', NULL, 'c', 'd' FROM items WHERE i % 2 = 0
      UNION ALL SELECT i, 'preset', NULL, 'white', 'black' FROM items WHERE i % 3 = 0
      UNION ALL SELECT i, 'subtitle_offset', NULL, '0', '1' FROM items WHERE i % 2 = 1""",
    "review_state": "SELECT l.doc_id AS item_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'completed' WHEN quality = 1 THEN 'needs_review' ELSE 'pending' END AS state FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
    "training_export": """WITH t AS (SELECT conv_id, count(*)::INTEGER AS turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
      SELECT left(sha256('{"item":' || conv_id || ',"job":"job","updated":"2024-01-01T00:00:00"}'), 24) AS id, 1 AS schema_version, turns, 'aggressive' AS mode, md5(text) AS rejected_md5, '{"added":[' || conv_id || ']}' AS user_changes, 'c1' AS corrections, 0 AS final_sentences FROM t WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "redact": """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN '{"deep":[{"props":' || replace(coalesce(props, '{}'), ' ', '') || '},{}]}' END AS props, CASE WHEN event_id % 10 <> 0 THEN '{"deep":[{"props":' || replace(coalesce(props, '{}'), ' ', '') || '},{}]}' END AS note,
      '{"deep":[{"props":' || replace(coalesce(props, '{}'), ' ', '') || '},{}]}' AS value, event_type AS kind, '{"deep":[{"props":' || replace(coalesce(props, '{}'), ' ', '') || '},{}]}' AS extra_props, 2::INTEGER AS extras, '{"user_id":' || user_id || '}' AS who FROM events""",
    "export_feedback": """WITH o AS (SELECT *, row_number() OVER () AS r FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY ALL)
      SELECT left(sha256('{"item":"' || o_orderkey || '","job":"job-' || o_custkey || '","updated":"2024-01-01T00:00:00"}'), 24) AS id, 'aggressive' AS mode, lines, '{"settings":"{\\"n\\":' || o_orderkey || '}","state":"' || o_orderstatus || '"}' AS rejected, o_orderstatus AS state, '[' || o_orderkey || ']' AS corrections, '[]' AS final_sentences, '{}' AS user_changes, false AS leaks,
      (SELECT count(*) FROM o WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 <> 0) AS exported, (SELECT count(*) FROM o WHERE o_orderkey % 3 <> 0 AND o_orderkey % 50 <> 0) AS skipped FROM o JOIN n ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 <> 0""",
    "forget_in_tables": """WITH o AS (SELECT o_orderkey AS item_id, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, o_custkey % 50 = 7 OR strftime(o_orderdate, '%Y-%m') = '1995-03' AS gone FROM orders),
      t AS (SELECT 'feedback' AS name, item_id, priority AS part, gone FROM o UNION ALL SELECT 'baseline', item_id, month, gone FROM o),
      p AS (SELECT name, part, bool_or(gone) AS touched, bool_and(gone) AS emptied FROM t GROUP BY ALL), c AS (SELECT name, count(*) AS partitions, count(*) FILTER (WHERE touched) AS rewritten, count(*) FILTER (WHERE emptied) AS emptied FROM p GROUP BY ALL), d AS (SELECT name, count(*) FILTER (WHERE gone) AS deleted FROM t GROUP BY ALL)
      SELECT name, item_id, partitions, rewritten, emptied, deleted, 0::BIGINT AS found FROM t JOIN c USING (name) JOIN d USING (name) WHERE NOT gone""",
    "forget": "SELECT doc_id AS item_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "auto_apply_filter": "SELECT * FROM (SELECT event_id, event_id % 101 / 100 AS confidence, CASE WHEN user_id % 2 = 0 THEN 'low' ELSE 'high' END AS risk, ['repeat', 'filler', 'pause'][event_id % 3 + 1] AS category, event_id % 7 / 2 AS seconds FROM events) WHERE confidence >= 0.9 AND risk = 'low' AND category IN ('repeat', 'filler') AND seconds <= 2.0",
}
