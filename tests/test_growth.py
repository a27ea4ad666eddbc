"""Cases of larger tables: what must not be sent to every task, and numbers that need more than 32 bits."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapework.functions.shared import slices
from tapework.operators import sanitize, segmentation
from tapework.plans import decision_queries, evaluation_queries, segmentation_queries, text_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [segmentation_queries.reflowed, decision_queries.evidence])
def test_tokens_are_not_broadcast(spark, data, query):
    assert "BroadcastHashJoin" not in plan_of(query(spark, data))


def test_pages_of_many_words(spark, tmp_path):
    n = 22_000
    spark.createDataFrame([(5, "<p>" + "a " * n + "</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    tokens = text_queries.tokens_from_words(text_queries.page_utterances(spark, str(tmp_path)))
    got = {r["item_id"]: r for r in tokens.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_us").alias("end_us"), F.max_by("token_id", "pos").alias("last")).collect()}
    assert got[5]["n"] == n and got[5]["last"] == f"u0001-w{n}" and got[5]["end_us"] == n * 300_000  # the first word, of no length, ends with its utterance
    assert got[-6]["n"] == 2 * n - 1 and got[-6]["end_us"] == n * 300_000


def test_a_text_cut_at_a_line_feed_is_its_own_original(spark):
    text = "a" * 999 + "\nb"
    names = "start_us long, end_us long, clip_start_us long, clip_end_us long, text string, original_text string, enabled boolean, remove_video boolean, gap boolean, synthetic_gap boolean, edited boolean, timing_pending boolean, timeline_order double, layout_source string, layout_reason string"
    none = [None] * 9
    new = spark.createDataFrame([(1, 1, "s1", 0, 5, 0, 5, text, None, *none)], "item_id long, idx long, sentence_id string, " + names)
    old = spark.createDataFrame([], "item_id long, sentence_id string, " + names)
    got = sanitize.sanitize_sentences(new, old, spark.createDataFrame([(1, 10)], "item_id long, duration_us long")).first()
    assert got["text"] == got["original_text"] == text[:1000] and not got["edited"]


def test_options_are_rows_made_without_a_second_shuffle(spark, data):
    options, costs = segmentation_queries.options(spark, data), segmentation_queries.costs(spark, data)
    assert options.columns == ["item_id", "start_pos", "end_pos", "width", "natural", "fill", "option_id"]
    for df in (options, costs):
        plan = plan_of(df).split("Initial Plan")[-1]
        assert "Join" not in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    assert options.count() == costs.agg(F.sum("n")).first()[0]


def test_titles_are_wrapped_where_they_are(spark):
    df = spark.createDataFrame([(k, "one two three\n\nfour five") for k in range(50)], "k long, title string")
    never = spark.createDataFrame([("7:3", 1, "required"), ("8:2", 0, "required"), ("9:99", 0, "required"), ("10:1", 99, "required")], "item_id string, pos long, kind string")
    wrapped = segmentation.wrap_title_text(df, "k", "title", segmentation.Layout(1000.0, 10.0), never)
    plan = plan_of(wrapped)
    assert "Generate" not in plan and plan.split("Initial Plan")[-1].count("SortMergeJoin") <= 1
    got = {r["k"]: r["lines"] for r in wrapped.collect()}
    assert got.pop(7) == "one two three\nfour\nfive" and set(got.values()) == {"one two three\nfour five"}


def test_redacted_columns_go_to_python_together(spark, data):
    """A task has one Python worker for all columns, not one for each, and gets slices of a batch."""
    assert plan_of(evaluation_queries.redacted(spark, data)).split("Initial Plan")[-1].count("ArrowEvalPython") == 1
    texts = pa.array(["a" * 1000, None, "", "b"] * 3000)
    parts = list(slices(texts))
    assert len(parts) > 2 and pa.concat_arrays(parts).equals(texts) and len(list(slices(texts[:0]))) == 1


def test_names_are_numbered_however_many_there_are(spark):
    rows = spark.createDataFrame([(1, k, "s1") for k in range(1, 121)], "item_id long, idx long, sentence_id string")
    got = {r["idx"]: r["sentence_id"] for r in sanitize.clean_ids(rows, "sentence_id", "s").collect()}
    assert got == {1: "s1"} | {k: f"s1-{k}" for k in range(2, 121)}
