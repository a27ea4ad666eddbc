"""Files read once or by their ends, writes that let only whole items through, responses by themselves, merged quantiles."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapework.operators import decisions, evaluation, sanitize
from tapework.sources import files, fingerprints

MIB = 1 << 20


# -- files

def test_fingerprints_of_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    contents = {"empty": b"", "small": b"abc", "one": rng.bytes(MIB), "over": rng.bytes(MIB + 5), "more": rng.bytes(3 * MIB)}
    (tmp_path / "sub").mkdir()
    for name, data in contents.items():
        (tmp_path / "sub" / f"{name}.mp4").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"x")
    with (tmp_path / "huge.mp4").open("wb") as f:  # a sparse file over what a cell can hold
        f.write(b"start")
        f.seek(5 * (1 << 30))
        f.write(b"end")
    got = {r["file"].rsplit("/", 1)[-1].removesuffix(".mp4"): (r["size"], r["fingerprint"]) for r in fingerprints.read_fingerprints(spark, str(tmp_path)).collect()}
    assert set(got) == {*contents, "huge"}
    for name, data in contents.items():
        assert got[name] == (len(data), hashlib.sha256(str(len(data)).encode() + data[:MIB] + (data[-MIB:] if len(data) > MIB else b"")).hexdigest()), name
    size = 5 * (1 << 30) + 3
    assert got["huge"] == (size, hashlib.sha256(str(size).encode() + b"start".ljust(MIB, b"\0") + b"end".rjust(MIB, b"\0")).hexdigest())
    # What is in a table's cell has the same fingerprint as the file; Spark's reader of whole files leaves out empty ones.
    cells = spark.read.format("binaryFile").load(str(tmp_path / "sub")).select("path", evaluation.fingerprint(F.col("content")).alias("f")).collect()
    assert {r["path"].rsplit("/", 1)[-1].removesuffix(".mp4"): r["f"] for r in cells} == {n: got[n][1] for n in contents if n != "empty"}
    many = fingerprints._Reader(f"file://{tmp_path}", 2)
    assert [len(p.paths) for p in many.partitions()] == [2, 2, 2]
    assert fingerprints._digest(many._system()[0], str(tmp_path / "gone")) == (None, "")
    with pytest.raises(FileNotFoundError):
        fingerprints._Reader(f"file://{tmp_path}/none", 2).partitions()


def test_job_tree_in_one_scan(spark, tmp_path):
    for k in range(3):
        work = tmp_path / f"job{k}" / "work" / "001"
        (work / "checkpoints").mkdir(parents=True)
        (tmp_path / f"job{k}" / "job.json").write_text("[broken" if k == 2 else json.dumps({"status": "done", "params": {"title": "t", "items": [{"id": "001", "status": "done", "outputs": {"a": "b"}}, {"status": "queued"}]}}))
        (work / "ai_decisions.json").write_text("{" if k == 1 else '{"n": 1}')
        (work / "checkpoints" / "media.json").write_text('{"original_duration": 2}')
        (work / "notes.json").write_text("{}")
    tree = files.read_job_tree(spark, str(tmp_path))
    assert sorted((r["job_id"], r["status"]) for r in tree["jobs"].collect()) == [("job0", "done"), ("job1", "done"), ("job2", None)]
    assert sorted((r["job_id"], r["item_id"], r["output_count"]) for r in tree["items"].collect()) == [("job0", "001", 0), ("job0", "001", 1), ("job1", "001", 0), ("job1", "001", 1)]
    assert sorted((r["job_id"], r["value"]) for r in tree["ai_decisions"].collect()) == [("job0", '{"n": 1}'), ("job1", "{}"), ("job2", '{"n": 1}')]
    assert tree["media"].count() == 3 and tree["training_feedback"].count() == 0
    assert sorted((r["job_id"], r["kind"], r["value"]) for r in tree["corrupt"].collect()) == [("job1", "ai_decisions", "{"), ("job2", "job", "[broken")]
    # A table reads its own kind's files of the written table only.
    assert "PartitionFilters: [isnotnull(kind" in tree["ai_decisions"]._jdf.queryExecution().executedPlan().toString()


# -- the gate

def test_write_conserved(spark, tmp_path):
    shape = "item_id long, pos long, token_id string"
    source = spark.createDataFrame([(i, k, f"t{k}") for i in range(6) for k in range(4)], shape)
    rows = [(0, k, f"t{k}") for k in range(4)] + [(1, 0, "t0"), (1, 2, "t2"), (1, 3, "t3")] + [(2, k, f"t{k}") for k in (0, 1, 1, 2, 3)] + [(3, 0, "t0"), (3, 1, "t2"), (3, 2, "t1"), (3, 3, "t3")] + [(4, k, f"t{k}") for k in (0, 2, 3)]
    mapped, removed = spark.createDataFrame(rows, shape), spark.createDataFrame([(4, "t1")], "item_id long, token_id string")
    path = str(tmp_path / "out")
    decisions.write_conserved(source, mapped, removed, path)
    got = spark.read.parquet(path)
    assert {r["item_id"] for r in got.where("gate = 'clean'").collect()} == {0, 4}
    assert {(r["item_id"], r["error"]) for r in got.where("gate = 'quarantine'").collect()} == {(1, "missing=1"), (2, "duplicates=1"), (3, "order_changed=true"), (5, "missing=4")}
    assert got.where("pos IS NOT NULL").count() == len(rows)
    with pytest.raises(Exception, match="token integrity check failed for item"):
        decisions.write_conserved(source, mapped, removed, str(tmp_path / "fails"), fail=True)
    assert not (tmp_path / "fails" / "_SUCCESS").exists() and not list((tmp_path / "fails").glob("gate=*"))
    decisions.write_conserved(source.where("item_id = 0"), mapped.where("item_id = 0"), removed, str(tmp_path / "good"), fail=True)
    assert spark.read.parquet(str(tmp_path / "good")).where("gate = 'clean'").count() == 4


# -- responses

def test_responses_of_an_item_are_judged_alone(spark):
    good = json.dumps({"delete_ranges": [{"token_ids": ["a"], "type": "filler", "confidence": 0.5}, {"token_ids": ["b"], "confidence": 1}]})
    bad = json.dumps({"delete_ranges": [{"token_ids": ["c"], "confidence": "sure"}]})
    raw = spark.createDataFrame([(1, "r1", good), (1, "r2", bad), (1, "r3", good), (2, "r1", "no json")], "item_id long, response string, value string")
    got = sanitize.sanitize_annotations(raw, response="response").collect()
    assert got[0].asDict().keys() >= {"item_id", "response", "kind", "seq"}
    assert sorted((r["item_id"], r["response"], r["kind"], r["seq"]) for r in got) == [
        (1, "r1", "delete_ranges", 1), (1, "r1", "delete_ranges", 2), (1, "r2", "quarantined", 0), (1, "r3", "delete_ranges", 1), (1, "r3", "delete_ranges", 2), (2, "r1", "quarantined", 0),
    ]
    # Without the column all of an item's rows are one response.
    assert {r["kind"] for r in sanitize.sanitize_annotations(raw.where("item_id = 1")).collect()} == {"quarantined"}


# -- quantiles

def test_merged_quantiles(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("provider"), (F.col("id") % 7).cast("string").alias("model"), F.when(F.col("id") % 5 == 0, "failed").otherwise("ok").alias("status"), F.lit(2).alias("attempts"), F.lit(True).alias("cache_hit"), F.lit(1).alias("total_tokens"), F.when(F.col("id") % 3 < 2, (F.col("id") * 7919) % 100_003).alias("latency_ms"))
    metrics = evaluation.decision_metrics(rows)
    exact = {(r["provider"], r["model"]): r for r in evaluation.decision_metrics(rows, exact=True).collect()}
    got = {(r["provider"], r["model"]): r for r in metrics.collect()}
    assert got.keys() == exact.keys() and len(got) == 3 * 7 + 3 + 7 + 1
    for key, r in got.items():
        assert [r[c] for c in ("calls", "error_rate", "retries", "cache_hits", "total_tokens", "state")] == [exact[key][c] for c in ("calls", "error_rate", "retries", "cache_hits", "total_tokens", "state")]
    assert got["2", "*"]["latency_p50"] is None and got["2", "3"]["latency_p95"] is None
    errors = evaluation.quantile_errors(rows, metrics).collect()
    assert len(errors) == 2 * 7 + 2 + 7 + 1 and max(max(r["error_p50"], r["error_p95"]) for r in errors) < 0.005
    small = evaluation.decision_metrics(rows, k=16)
    assert max(r["error_p50"] for r in evaluation.quantile_errors(rows, small).collect()) > 0.005
