"""Larger tables again: few keys mustn't mean few tasks, and what costs most is done once for a row."""

import json
import os
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import functions as F

from tapework.functions import redaction
from tapework.operators import decisions, governance
from tapework.plans import decision_queries, evaluation_queries, live_queries
from tapework.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@contextmanager
def settings(spark, **values):
    for name, value in values.items():
        spark.conf.set("spark.sql." + name.replace("__", "."), value)
    yield
    for name in values:
        spark.conf.unset("spark.sql." + name.replace("__", "."))


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.range(0, 60_000, 1, 8).select(F.col("id").alias("item_id"), F.lit("x").alias("day")).write.partitionBy("day").parquet(place)
    with settings(spark, adaptive__advisoryPartitionSizeInBytes="20k", adaptive__coalescePartitions__enabled="false"):
        report = governance.forget_in_tables(spark, {place: ["day"]}, spark.range(0, 60_000, 50).withColumnRenamed("id", "item_id")).first()
    assert (report["rewritten"], report["deleted"], report["left"]) == (1, 1200, 0) and spark.read.parquet(place).count() == 58_800
    assert len([f for f in os.listdir(f"{place}/day=x") if f.endswith(".parquet")]) > 1


def test_tables_are_not_sorted_by_their_report(spark, data):
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        assert "SortMergeJoin" not in plan_of(evaluation_queries.forgotten_in_tables(spark, data))


def test_tolerant_json_is_read_once_for_a_row(spark, data):
    plan = live_queries.tolerant(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("jsontostructs(") <= 3  # as it is, and doubled where that fails or can't but fail


def test_tolerant_json_of_odd_texts(spark):
    texts = {
        r'''{"a":"it\'s"}''': "it's", r'''{'a':'it\'s'} \d}''': "it's", r'{"a":"\d"}': r"\d", r'{"a":"\\\d\\"}': "\\\\d\\", r'{"a":"\u00e9"}': "é", r'{"a":"\ud"}': None, r'''x {"a":"\d it\'s"} y''': r"\d it\'s",
        r'{"a":"x"} \d }': "x", '﻿{"a":"b"}': "b", "{}": None, "": None, "no": None, "{": None, '{"a":"x\\': None, '{"a":1': None, 'so {"a":"b\n"} x': None, None: None, '{"a":"C:\\dir\\new"}': "C:\\dir\new",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r["a"] for r in df.select("k", files.parse_tolerant_json(F.col("t"), "a string")["a"].alias("a")).collect()}
    assert got == dict(enumerate(texts.values()))


def test_feedback_files_are_parsed_once(spark, data, monkeypatch):
    """A file's text is made by a join here; a condition on its parsed form would move down there and parse it again."""
    plans, export = [], governance.training_export
    monkeypatch.setattr(governance, "training_export", lambda feedback: plans.append(feedback._jdf.queryExecution().optimizedPlan().toString()) or export(feedback))
    rows = evaluation_queries.exported(spark, data)
    assert plans[0].count("parseJson(") == 1 and rows.count() > 0
    odd = ["{broken", "[]", "1", '"{}"', "null", None, "", " \n\t{}", '{"job_id":"j"}', '[{"job_id":"j"}]', "\v{}"]
    got = governance.feedback_records(spark.createDataFrame([(t,) for t in odd], "value string"))
    assert sorted(str(r["job_id"]) for r in got.select("job_id").collect()) == ["None", "j"]


def test_json_inside_json_is_read_once_at_each_depth(monkeypatch):
    text, read = '{"api_key":"S3CRET","n":1}', []
    for _ in range(6):
        text = json.dumps({"s": text, "plain": "a"})
    looked = redaction.clean_text
    monkeypatch.setattr(redaction, "clean_text", lambda t: read.append(t) or looked(t))
    assert redaction.clean_text(text).count("n") > 0 and "S3CRET" not in redaction.clean_text(text) and len(read) == 14


def test_proposals_are_settled_without_a_call_for_each_item(spark, data):
    """Nor is every token joined with those that are protected by their own text."""
    plan = plan_of(decision_queries._accepted("aggressive")(spark, data))
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 5  # the policy twice, tokens that are read, their proposals, totals


def test_an_item_is_settled_over_several_batches():
    rows = [(item, 10, None, None, first, first + 1, 2) for item in (1, 2, None) for first in (0, 1, 4, 6, 8)]
    names = ["item_id", "_total", "_early", "_late", "first_pos", "last_pos", "n_tokens"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.string() if n in ("_early", "_late") else pa.int64()) for n in names]))
    told = [None, "overlapping_delete", None, "deletion_budget_exceeded", "deletion_budget_exceeded"] * 3
    for size in (1, 3, 15):
        assert [r for b in decisions._settle(whole.slice(k, size) for k in range(0, 15, size)) for r in b["skip_reason"].to_pylist()] == told
