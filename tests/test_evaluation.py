"""Evaluation, snapshots, reviews, redaction and export on literal cases."""

import json

from pyspark.sql import functions as F

from tapework.operators import evaluation, governance

# The twenty items with known totals.
N = 20


def samples(spark):
    items = spark.createDataFrame([(f"i{k:02}", "done", f"print-{k}", 1, 60.0) for k in range(N)], "item_id string, status string, source_fingerprint string, output_count int, source_seconds double")
    decided = spark.createDataFrame([(f"i{k:02}", 1, 1, 0, 10, 2, 12) for k in range(N)], "item_id string, corrections int, applied_deletions int, rejected_deletions int, prompt_tokens int, completion_tokens int, total_tokens int")
    feedback = spark.createDataFrame([(f"i{k:02}", int(k == 0), 0, 0, 0, 0, 0, 0, True, 10.0) for k in range(N)], "item_id string, restored_deletions int, user_deletions int, text_edits int, split_edits int, merge_edits int, title_edits int, cover_edits int, review_complete boolean, refinement_seconds double")
    stages = spark.createDataFrame([(f"i{k:02}", 30.0) for k in range(N)], "item_id string, pipeline_seconds double")
    return items, decided, feedback, stages


def test_twenty_items(spark):
    rows = evaluation.evaluation_samples(*samples(spark))
    totals = evaluation.evaluation_metrics(rows).collect()[0]
    assert (totals["applied_deletions"], totals["total_tokens"], totals["deletion_restore_rate"]) == (20, 240, 0.05)
    assert (totals["processing_seconds_per_source_minute"], totals["average_manual_refinement_seconds"]) == (30.0, 10.0)
    summary = evaluation.evaluation_summary(rows).collect()[0]
    assert summary["fixed_set_ready"] and summary["quality_evidence_ready"] and summary["gaps"] == ""
    assert (summary["items_with_completed_review"], summary["unique_eligible_sources"]) == (20, 20)


def test_what_is_missing(spark):
    items, decided, feedback, stages = samples(spark)
    items = items.withColumn("status", F.when(F.col("item_id") < "i05", "running").otherwise(F.col("status"))).withColumn("source_fingerprint", F.when(F.col("item_id") > "i17", "print-1").otherwise(F.col("source_fingerprint")))
    rows = evaluation.evaluation_samples(items, decided.where("item_id <> 'i06'"), feedback.limit(0), stages)
    summary = evaluation.evaluation_summary(rows).collect()[0]
    assert (summary["all_items"], summary["eligible_items"], summary["unique_eligible_sources"], summary["items_with_ai_decisions"]) == (20, 15, 14, 14)
    assert summary["gaps"] == "6 more sources; 6 more decisions; 20 more reviews" and not summary["quality_evidence_ready"]
    totals = evaluation.evaluation_metrics(rows).collect()[0]
    assert totals["applied_deletions"] == 14 and totals["deletion_restore_rate"] is None and totals["average_manual_refinement_seconds"] is None
    assert [r["item_id"] for r in evaluation.duplicate_sources(rows, "item_id", "source_fingerprint").orderBy("item_id").collect()] == ["i18", "i19"]


def test_fourteen_kinds_of_change(spark):
    shape = "item_id int, sentence_id string, start_us long, end_us long, text string, remove_video boolean, timeline_order long, style string, token_ids array<string>"
    base = [("a", 0, 10, "one", False, 1, "s", ["t1", "t2"]), ("b", 10, 20, "two", True, 2, "s", ["t3"]), ("c", 20, 30, "three", False, 3, "s", ["t4"]), ("d", 30, 40, "four", False, 4, "s", ["t5"])]
    final = [("a", 0, 12, "One", False, 2, "t", ["t1"]), ("b", 10, 20, "two", False, 1, "s", ["t2", "t3", "t4"]), ("d", 30, 40, "four", True, 4, "s", ["t5"]), ("e", 50, 60, "new", False, 5, "s", ["t9"])]
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], shape)
    titles = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "item_id int, title_id string, value string")
    setting = lambda *r: spark.createDataFrame([(1, *r)], "item_id int, cover string, preset string, subtitle_offset long")
    got = governance.diff_snapshots(frame(base), frame(final), titles([("t1", "x"), ("t2", "y")]), titles([("t1", "z"), ("t2", "y")]), setting("c", "p", 0), setting("C", "q", 5)).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r["change"], []).append(r["key"])
    assert set(kinds) == {"restored", "removed", "added", "missing", "text", "timing", "order", "style", "split", "merged", "title", "cover", "preset", "subtitle_offset"}
    assert (kinds["restored"], kinds["removed"], kinds["added"], kinds["missing"], kinds["text"], kinds["title"]) == (["b"], ["d"], ["e"], ["c"], ["a"], ["t1"])
    assert sorted(kinds["order"]) == ["a", "b"] and kinds["timing"] == ["a"] and kinds["style"] == ["a"]
    # In order b, a, d, e the inner boundaries are t4, t1 and t5; before they were t2, t3 and t4.
    assert sorted(kinds["split"]) == ["t1", "t5"] and sorted(kinds["merged"]) == ["t2", "t3"]


def test_an_edit_after_the_review(spark):
    shape = "item_id int, sentence_id string, start_us long, end_us long, text string, enabled boolean, remove_video boolean, timeline_order long, synthetic_gap boolean"
    rows = [(1, "a", 0, 1, "x", True, False, 1, False), (1, "g", 1, 2, "", True, False, 2, True), (2, "a", 0, 1, "y", True, False, 1, False)]
    taken = governance.snapshot(spark.createDataFrame(rows, shape))
    assert all("\"g\"" not in r["snapshot"] for r in taken.collect())
    edited = governance.snapshot(spark.createDataFrame([rows[0], rows[1], (2, "a", 0, 1, "Y", True, False, 1, False)], shape))
    feedback = taken.select("item_id", F.lit("completed").alias("review_status"), F.col("snapshot_sha256").alias("reviewed_sha256")).unionByName(spark.createDataFrame([(3, None, None)], "item_id int, review_status string, reviewed_sha256 string"))
    assert {r["item_id"]: r["state"] for r in governance.review_state(feedback, edited).collect()} == {1: "completed", 2: "needs_review", 3: "pending"}


def test_export_of_consented_feedback(spark):
    row = "named_struct('text', 'hello', 'api_key', 'SECRET', 'work_path', '/tmp/x', 'deep', array(named_struct('Authorization', 'SECRET', 'ok', 1)))"
    feedback = spark.sql(f"SELECT 'job-secret' AS job_id, '001' AS item_id, '2026' AS updated_at, k = 1 AS training_consent, 'raw' AS raw_transcript, {row} AS initial_result, {row} AS final_result, map('current_video', 'SECRET', 'note', 'fine') AS user_changes, named_struct('corrections', array('c'), 'access_token', 'SECRET') AS ai_decision FROM (VALUES (1), (2)) AS t(k)")
    got = governance.training_export(feedback)
    records = [json.loads(x) for x in got.toJSON().collect()]
    assert len(records) == 1 and len(records[0]["id"]) == 24
    text = json.dumps(records)
    assert "SECRET" not in text and "/tmp" not in text and "job-secret" not in text
    assert records[0]["chosen"]["deep"] == [{"ok": 1}] and records[0]["user_changes"] == {"note": "fine"} and records[0]["ai_decision"]["corrections"] == ["c"]
    assert governance.training_export(feedback.withColumn("training_consent", F.lit(None).cast("boolean"))).count() == 0
    assert governance.forget(feedback, feedback.select("item_id").limit(1)).count() == 0


def test_what_may_be_applied_unasked(spark):
    rows = [(0.95, "low", "repeat", 1.0), (0.89, "low", "repeat", 1.0), (0.95, "high", "repeat", 1.0), (0.95, "low", "other", 1.0), (0.95, "low", "filler", 2.0), (0.95, "low", "filler", 2.1)]
    got = governance.auto_apply(spark.createDataFrame(rows, "confidence double, risk string, category string, seconds double"))
    assert sorted(r["seconds"] for r in got.collect()) == [1.0, 2.0]
