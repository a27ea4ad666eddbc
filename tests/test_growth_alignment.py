"""Long items and many stretches of an alignment: what is read for each row, and what goes to Python together."""

import random

from tapework.operators import alignment
from tapework.plans import live_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].lower()


def test_pairs_are_held_against_all_others_in_linear_time(spark):
    """A frame to the end of an item is summed anew for each of its rows, so there is none."""
    rng = random.Random(5)
    pairs = {(k % 2, k // 3 + rng.randrange(3), k // 3 + rng.randrange(3)) for k in range(150)}
    calm = alignment._calm(spark.createDataFrame(sorted(pairs), "item_id long, a long, b long"))
    assert "unboundedfollowing" not in plan_of(calm)
    meets = lambda p, q: p != q and p[0] == q[0] and (p[1] - q[1]) * (p[2] - q[2]) <= 0
    wanted = {p for p in pairs if not any(meets(p, q) for q in pairs)}
    assert wanted and {tuple(r) for r in calm.collect()} == wanted


def test_stretches_go_to_python_together(spark):
    """Open units are dealt by item once, in rows of a stretch each, and one call pairs many of them."""
    rows = lambda texts: [(item, k, f) for item in (1, 2) for k, f in enumerate(texts)]
    a = spark.createDataFrame(rows(["x", "m", "p", "q", "r", "m2", "z"]), "item_id long, at long, f string")
    b = spark.createDataFrame(rows(["m", "q", "s", "p", "r", "m2"]), "item_id long, at long, f string")
    opened = alignment._open(a, b, spark.createDataFrame([(1, 1, 0), (1, 5, 5)], "item_id long, a long, b long"))
    paired = opened.select("item_id", "stretch", alignment._paired(opened._a.f, opened._b.f).alias("p"))
    plan = plan_of(paired)
    assert plan.count("arrowevalpython") == 1 and "cogroup" not in plan and "join" not in plan and plan.count("exchange") == 1
    got = {(r["item_id"], r["stretch"]): ([x["f"] for x in r["_a"]], [x["f"] for x in r["_b"]]) for r in opened.collect()}
    assert got == {(1, 0): (["x"], []), (1, 1): (["p", "q", "r"], ["q", "s", "p", "r"]), (1, 2): (["z"], []), (2, 0): (["x", "m", "p", "q", "r", "m2", "z"], ["m", "q", "s", "p", "r", "m2"])}
    lengths = {(r["item_id"], r["stretch"]): len(r["p"]) for r in paired.collect()}
    assert lengths == {(1, 0): 0, (1, 1): 2, (1, 2): 0, (2, 0): 4}


def test_a_report_reads_what_lies_open_from_a_table(spark, data):
    """Corrections and spans share it, so it isn't found anew, with its windows over all tokens, for each of them."""
    assert "window" not in plan_of(live_queries.report(spark, data))
