"""What reflow keeps on disk: tokens are dealt by item once, and only whole lines after that."""

from tapework.operators import segmentation
from tapework.plans import segmentation_queries


def test_tokens_of_runs_are_dealt_once(spark, data):
    plan = segmentation_queries.reflowed(spark, data)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    below = plan[plan.index("MapInArrow") :]
    assert "table-" not in plan  # nothing is stored on the way
    assert "Join" not in below and below.count("Union") >= 1 and "Exchange" not in below[: below.index("Union")].replace("Exchange", "", 1)


def test_a_token_of_two_runs_is_in_lines_of_both(spark):
    """Ranges that overlap keep all their tokens, places without a token are left out, and lines keep to their run."""
    tokens = spark.createDataFrame([(1, k, f"u{k}", w, k * 10, k * 10 + 10) for k, w in enumerate("abcdef")], "item_id long, pos long, token_id string, text string, start_us long, end_us long")
    shape = "item_id long, sentence_id string, timeline_order long, first_pos long, last_pos long, edited boolean, pending boolean, remove_video boolean, gap boolean, clip_start_us long, clip_end_us long"
    no = (False, False, False)
    sentences = spark.createDataFrame([(1, "s0", 0, 0, 3, False, *no, 1, 42), (1, "s1", 1, 4, 4, True, *no, 40, 50), (1, "s2", 2, 3, 9, False, *no, 31, 65)], shape)
    breaks = spark.createDataFrame([(1, 1, "required"), (1, 99, "required")], "item_id long, pos long, kind string")
    got = segmentation.reflow(sentences, tokens, breaks, segmentation.Layout(1000.0, 10.0)).orderBy("timeline_order").collect()
    assert [(r["first_pos"], r["last_pos"], r["text"], r["clip_start_us"], r["clip_end_us"]) for r in got] == [(0, 1, "ab", 1, 20), (2, 3, "cd", 20, 42), (4, 4, None, 40, 50), (3, 5, "def", 31, 65)]
    assert got[2]["sentence_id"] == "s1" and len({r["sentence_id"] for r in got}) == 4
