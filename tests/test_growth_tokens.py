"""Tokens are many times as many as texts: what is sorted and shuffled of them."""

import pytest

from tapework.operators import tokens
from tapework.plans import interval_queries, live_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_tokens_are_dealt_out_without_sorting_them(spark):
    """Texts over several blocks of pieces; windows run over blocks, so what is sorted is few rows."""
    rows = [(1, 0, "ab, 中文 " * 300, 0, 900_000), (1, 1, "", 900_000, 900_000), (1, 2, "x", 1_000_000, 1_000_100), (2, 0, None, 0, 5)]
    df = spark.createDataFrame(rows, "item_id long, utt long, text string, start_us long, end_us long")
    dealt = tokens.tokens_estimated(df)
    plan = plan_of(dealt)
    assert plan.index("Generate") < plan.index("Window")  # the plan's last step is on top
    units = [{"ab": 2, "中": 2, "文": 2}.get(p, 1) for p in ["ab", ",", " ", "中", "文", " "] * 300]
    upto = [sum(units[:k]) for k in range(len(units) + 1)]
    wanted = [(1, 0, k, f"u0000-w{k + 1:04d}", 900_000 * upto[k] // upto[-1], 900_000 * upto[k + 1] // upto[-1]) for k in range(len(units))]
    wanted.append((1, 2, len(units), "u0002-w0001", 1_000_000, 1_001_000))
    got = sorted(tuple(r) for r in dealt.select("item_id", "utt", "pos", "token_id", "start_us", "end_us").collect())
    assert got[:-1] == wanted[:-1] and got[-1][:5] == wanted[-1][:5]


@pytest.mark.parametrize("query", [interval_queries.tokens_mapped, live_queries.traces])
def test_tokens_meet_intervals_without_a_join(spark, data, query):
    """Neither by time buckets nor by positions: both sides are one sorted union."""
    assert not [line for line in plan_of(query(spark, data)).splitlines() if "Join" in line and ("pos" in line or "_bucket" in line)]


def test_a_cut_is_planned_once_and_summed_without_a_join(spark, data):
    """What is removed is stored before gaps, counts and sums are made of it, so the plans of it don't stand in one stage five times over."""
    plan = plan_of(interval_queries.cut_summary(spark, data))
    assert "Join" not in plan and "Generate" not in plan and plan.count("Window") == 2
    assert "Join" not in plan_of(interval_queries.build_cut_plan(spark, data))
