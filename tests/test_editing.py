"""Clean-up, alignment, files and streams on literal cases."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapework.operators import alignment, sanitize
from tapework.sources import files
from tapework.streaming import live
from tapework.streaming.run import rocksdb_state

US = 1_000_000

# -- clean-up of what models and editors hand in


def test_annotations(spark):
    good = {
        "delete_ranges": [{"token_ids": ["a", "", 3], "type": "odd", "confidence": 7, "reason": "r" * 400}, {"token_ids": []}, {"token_ids": "a"}, 5, {"token_ids": ["b"], "type": "filler", "confidence": "0.5"}],
        "protected_spans": [{"token_ids": ["a"], "text": "x", "confidence": "not read"}, {"token_ids": ["a", "b"], "text": "xy", "confidence": -1}],
        "forbidden_breaks": [{"token_ids": ["a", "b"], "text": "ab"}, {"after_token_id": "q"}, {"token_ids": ["a"]}],
        "break_hints": [{"after_token_id": ""}, {"after_token_id": "k", "confidence": 0.25}],
        "corrections": [{"token_ids": [], "replacement": "R" * 500}, {"token_ids": ["a"]}],
        "final_sentences": [{"token_ids": ["a"], "text": "t" * 2000, "confidence": "odd"}],
        "allowed_breaks": "none",
    }
    bad = [{"corrections": [{"token_ids": ["a"], "confidence": "high"}]}, {"break_hints": [{"after_token_id": "k", "confidence": None}]}, {"forbidden_breaks": [{"confidence": "x"}]}]
    rows = [(1, "Sure: " + json.dumps(good) + " done"), (2, "no json"), (3, None)] + [(10 + k, json.dumps(b)) for k, b in enumerate(bad)] + [(20, "{}")]
    got = sanitize.sanitize_annotations(spark.createDataFrame(rows, "item_id long, value string")).collect()
    assert {r["item_id"] for r in got if r["kind"] == "quarantined"} == {2, 3, 10, 11, 12}
    one = sorted((r["kind"], r["seq"], r["token_ids"], r["after_token_id"], r["type"], r["confidence"]) for r in got if r["item_id"] == 1)
    assert [x[:2] for x in one] == [("break_hints", 2), ("corrections", 1), ("delete_ranges", 1), ("delete_ranges", 5), ("final_sentences", 1), ("forbidden_breaks", 1), ("forbidden_breaks", 2), ("protected_spans", 2)]
    by = {x[:2]: x[2:] for x in one}
    assert by["delete_ranges", 1] == (["a", "3"], None, "redundant", 1.0) and by["delete_ranges", 5] == (["b"], None, "filler", 0.5)
    assert by["forbidden_breaks", 2] == ([], "q", None, 0.0) and by["protected_spans", 2][3] == 0.0 and by["final_sentences", 1][3] is None
    size = {(r["kind"], r["seq"]): (len(r["text"] or ""), len(r["replacement"] or ""), len(r["reason"] or "")) for r in got if r["item_id"] == 1}
    assert size["final_sentences", 1][0] == 1000 and size["corrections", 1][1] == 300 and size["delete_ranges", 1][2] == 300
    assert not [r for r in got if r["item_id"] == 20]


def names_by_hand(values, prefix):
    import re

    used, out = set(), []
    for k, value in enumerate(values, 1):
        plain = re.sub("[^A-Za-z0-9_-]+", "-", value or "").strip("-") or f"{prefix}{k:03d}"
        base = (plain if plain.startswith(prefix) else f"{prefix}-{plain}")[:40]
        name, n = base, 2
        while name in used:
            name, n = f"{base}-{n}", n + 1
        used.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("values", [["s1", "s1", "s1-2", "s1"], ["s1-2", "s1", "s1"], [None, "", "!!", "x y", "x-y"], ["s" * 60, "s" * 60], ["a", "b"]])
def test_clean_ids(spark, values):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values, 1)], "item_id long, idx long, name string")
    assert [r["name"] for r in sanitize.clean_ids(rows, "name", "s").orderBy("idx").collect()] == names_by_hand(values, "s")


SENTENCE = "sentence_id string, start_us long, end_us long, clip_start_us long, clip_end_us long, text string, original_text string, enabled boolean, remove_video boolean, gap boolean, synthetic_gap boolean, edited boolean, timing_pending boolean, timeline_order double, layout_source string, layout_reason string"


def test_synthetic_gaps_may_be_longer_than_the_item(spark):
    new = spark.createDataFrame([(1, 1, "s001", 0, 2_500_000, 0, 2_500_000, "", "", True, False, True, True, None, None, None, None, None), (1, 2, "s002", 0, 2_500_000, 0, 2_500_000, " b ", "a", None, None, None, None, None, None, None, None, None)], f"item_id long, idx long, {SENTENCE}")
    old = spark.createDataFrame([], f"item_id long, {SENTENCE}")
    media = spark.createDataFrame([(1, 1_000_000)], "item_id long, duration_us long")
    got = {r["sentence_id"]: r for r in sanitize.sanitize_sentences(new, old, media).collect()}
    assert got["s001"]["clip_end_us"] == 2_500_000 and got["s001"]["synthetic_gap"]
    assert got["s002"]["clip_end_us"] == 1_000_000 and got["s002"]["edited"] and got["s002"]["text"] == "b" and got["s002"]["enabled"]


def test_tokens_that_do_not_spell_their_sentence(spark):
    sentences = spark.createDataFrame([(1, "s1", "ab c", 0, 1_000_000), (1, "s2", "ab", 0, 1_000_000), (1, "s3", "", 0, 5)], "item_id long, sentence_id string, text string, start_us long, end_us long")
    shape = "item_id long, sentence_id string, idx long, token_id string, text string, original_text string, start_us long, end_us long, timing_source string, edited boolean"
    tokens = spark.createDataFrame([(1, "s1", 1, None, "ab", None, -5, 2_000_000, None, None), (1, "s1", 2, "x" * 99, "c", "k", None, None, "asr", True), (1, "s2", 1, None, "b", None, 0, 1, None, None)], shape)
    got = {(r["sentence_id"], r["idx"]): r for r in sanitize.sanitize_tokens(tokens, sentences).collect()}
    assert set(got) == {("s1", 1), ("s1", 2), ("s2", 1)}
    assert (got["s1", 1]["token_id"], got["s1", 1]["start_us"], got["s1", 1]["end_us"]) == ("s1-w0001", 0, 1_000_000)
    assert len(got["s1", 2]["token_id"]) == 80 and got["s1", 2]["original_text"] == "k" and got["s1", 2]["edited"]
    assert (got["s2", 1]["text"], got["s2", 1]["timing_source"], got["s2", 1]["end_us"]) == ("ab", "estimated", 1_000_000)


# -- alignment


def aligned(spark, text, script):
    tokens = spark.createDataFrame([(1, k, f"t{k}", c) for k, c in enumerate(text)], "item_id long, pos long, token_id string, text string")
    got = alignment.align_script(tokens, spark.createDataFrame([(1, script)], "item_id long, script string"))
    return got["report"].collect()[0]["status"], [r["text"] for r in got["tokens"].orderBy("pos").collect()], {r["kind"]: (r["asr_text"], r["script_text"]) for r in got["spans"].collect()}


def test_alignment_keeps_what_only_one_side_has(spark):
    status, text, spans = aligned(spark, "我们真的在广西做AI获客系统", "我们在广西做AI获客系统")
    assert status == "aligned" and "真的" in "".join(text) and spans["asr_only"] == ("真的", "")
    status, text, spans = aligned(spark, "我们开始", "我们现在开始")
    assert status == "aligned" and "".join(text) == "我们开始" and spans["script_only"] == ("", "现在")
    assert aligned(spark, "我们在广西做", "这是一份完全不对应当前视频的逐字稿")[:2] == ("rejected", list("我们在广西做"))


def test_alignment_of_what_occurs_often(spark):
    """No unit occurs once, and all of them are matched."""
    tokens = ["ha"] * 6
    status, text, spans = aligned(spark, tokens, "HA ha ha ha ha ha")
    assert status == "aligned" and text == ["HA", *["ha"] * 5] and not spans


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
def test_common_subsequence(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (x == y))
    got = alignment.common_subsequence(np.array(a, int), np.array(b, int))
    assert len(got) == best[-1, -1] and all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_common_subsequence_in_halves(monkeypatch):
    """Where rows aren't held, halves are paired, as long as before; repeats, and units that only one side has, in long texts."""
    rng = np.random.default_rng(5)
    cases = [(rng.integers(0, k, n), rng.integers(0, k, m)) for k, n, m in ((1, 40, 70), (3, 200, 150), (50, 300, 400), (900, 500, 333))]
    whole = [alignment.common_subsequence(a, b) for a, b in cases]
    monkeypatch.setattr(alignment, "HELD", 8)
    for (a, b), known in zip(cases, whole, strict=True):
        got = alignment.common_subsequence(a, b)
        assert len(got) == len(known) and all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:], strict=False))


# -- files


def test_script_files(spark, tmp_path):
    cases = {"plain": "一二".encode(), "marked": b"\xef\xbb\xbf" + "三".encode(), "chinese": "中文逐字稿".encode("gb18030"), "broken": "ab".encode() + b"\xff\xff" + "c".encode()}
    for name, data in cases.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r["file"].rsplit("/", 1)[1][:-4]: r["text"] for r in files.read_scripts(spark, str(tmp_path)).collect()}
    assert got == {"plain": "一二", "marked": "三", "chinese": "中文逐字稿", "broken": "abc"}


def test_job_tree(spark, tmp_path):
    """Twenty items, one of whose files can't be read and one of whose are missing."""
    for k in range(20):
        work = tmp_path / f"job{k:02}" / "work" / "001"
        work.mkdir(parents=True)
        job = {"status": "done", "created_at": "a", "params": {"title": f"T{k}", "items": [{"id": "001", "status": "done", "outputs": {"video": "v.mp4"}}]}}
        (tmp_path / f"job{k:02}" / "job.json").write_text(json.dumps(job) if k != 3 else "{broken")
        if k != 5:
            (work / "ai_decisions.json").write_text(json.dumps({"deleted": k}) if k != 4 else "nothing")
    tree = files.read_job_tree(spark, str(tmp_path))
    jobs = {r["job_id"]: r for r in tree["jobs"].collect()}
    assert len(jobs) == 20 and jobs["job03"]["status"] is None and jobs["job07"]["title"] == "T7"
    items = tree["items"].collect()
    assert len(items) == 19 and all(r["item_id"] == "001" and r["output_count"] == 1 for r in items)
    decisions = {r["job_id"]: json.loads(r["value"]) for r in tree["ai_decisions"].collect()}
    assert len(decisions) == 19 and decisions["job04"] == {} and decisions["job07"] == {"deleted": 7} and "job05" not in decisions
    assert {r["item_id"] for r in tree["ai_decisions"].collect()} == {"001"} and tree["training_feedback"].count() == 0


# -- streams of several files, with rows that come too late


HOUR = 3600
#: What the times count from, a full hour. A row is late if it is behind the watermark that the batch before was done with.
BASE = 472_222 * HOUR


class Feed:
    """A folder that gets one file after the other, each of which is a micro-batch."""

    def __init__(self, spark, tmp_path, columns):
        self.spark, self.tmp, self.n = spark, tmp_path, 0
        self.columns = columns
        (tmp_path / "in").mkdir()

    def add(self, *rows):
        self.n += 1
        frame = self.spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in self.columns.items()))
        frame.toPandas().to_parquet(self.tmp / f"{self.n:03}.parquet", coerce_timestamps="us")
        (self.tmp / f"{self.n:03}.parquet").rename(self.tmp / "in" / f"{self.n:03}.parquet")

    def stream(self):
        shape = ", ".join(f"{c} {t}" for c, t in self.columns.items())
        raw = self.spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(self.tmp / "in"))
        return raw.withColumn("ts", F.timestamp_seconds(F.col("at") + BASE)).drop("at")

    def run(self, stream, mode):
        """All that the stream emits for the files that are there; its checkpoint goes on where the last run stopped."""
        seen = []
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, _: seen.extend(r.asDict() for r in rows.collect())).option("checkpointLocation", str(self.tmp / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        return seen


def test_late_rows_of_metrics(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"at": "long", "ok": "boolean", "tokens": "long"})
    feed.add((10, True, 1), (20, False, 2))
    feed.add((3 * HOUR, True, 5))
    feed.add((3 * HOUR + 1, True, 7))
    feed.add((30, True, 100))  # comes three hours late
    feed.add((9 * HOUR, True, 1))
    got = {int(r["window_start"].timestamp()) - BASE: (r["calls"], r["failures"], r["tokens"]) for r in feed.run(live.ops_metrics(feed.stream()), "append")}
    assert got == {0: (2, 1, 3), 3 * HOUR: (2, 0, 12)}


def test_usage_counts_once_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"at": "long", "event_id": "long"})
    feed.add((0, 1), (5, 2))
    feed.add((60, 1), (70, 3))
    first = feed.run(live.usage_dedup(feed.stream()), "append")
    feed.add((80, 2), (90, 4))  # after a restart a retried event still counts no more
    second = feed.run(live.usage_dedup(feed.stream()), "append")
    assert sorted(r["event_id"] for r in first) == [1, 2, 3] and [r["event_id"] for r in second] == [4]
    feed.add((50 * HOUR, 9))
    feed.add((1, 2), (50 * HOUR + 1, 10))  # far too late: dropped, though its id is forgotten by now
    assert sorted(r["event_id"] for r in feed.run(live.usage_dedup(feed.stream()), "append")) == [9, 10]


def test_latency_forgets_old_starts(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"at": "long", "item_id": "long", "stage": "string", "event_id": "long"})
    feed.add((0, 1, "a", 1), (10, 2, "a", 2))
    feed.add((600, 1, "b", 3), (2 * HOUR, 2, "b", 4))  # item 2 took longer than an hour
    feed.add((8 * HOUR, 3, "a", 5), (8 * HOUR + 60, 3, "b", 6))
    feed.add((8 * HOUR + 70, 4, "a", 8), (8 * HOUR + 70, 5, "b", 9))
    feed.add((30, 2, "b", 7))  # would be in time, but comes too late
    rows = feed.stream()
    got = feed.run(live.stage_latency(rows.where("stage = 'a'"), rows.where("stage = 'b'"), "1 HOUR"), "append")
    assert sorted((r["item_id"], r["seconds"]) for r in got) == [(1, 600.0), (3, 60.0)]


def test_late_rows_of_sessions_and_silence(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"at": "long", "item_id": "long", "value": "double"})
    feed.add((0, 1, 1.0), (60, 1, 2.0))
    feed.add((20 * 60, 1, 3.0), (5 * HOUR, 2, 1.0))
    feed.add((5 * HOUR + 30, 2, 1.0))
    feed.add((70, 1, 1.0))  # comes five hours late
    feed.add((20 * HOUR, 3, 99.0))
    got = feed.run(live.edit_sessions(feed.stream()), "append")
    assert sorted((r["item_id"], r["seconds"], r["edits"]) for r in got) == [(1, 1200.0, 3), (2, 30.0, 2)]
    (tmp_path / "checkpoint").rename(tmp_path / "done")
    quiet = feed.run(live.silence(feed.stream(), 50.0, "30 minutes", 60.0), "append")
    # The loud row moves the watermark of the silence no further than the quiet ones do.
    assert sorted((r["item_id"], r["samples"]) for r in quiet) == [(1, 3)]


def test_progress_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"at": "long", "item_id": "long", "stage": "string", "event_id": "long"})
    feed.add((0, 1, "asr", 1), (5, 2, "asr", 2))
    feed.add((9, 1, "cut", 3))
    feed.add((1, 1, "old", 4))  # an older event changes nothing
    last = {r["item_id"]: r["stage"] for r in feed.run(live.stage_progress(feed.stream()), "update")}
    assert last == {1: "cut", 2: "asr"}


def test_stalled_items_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"at": "long", "item_id": "long", "state": "string", "event_id": "long"})
    stalled = lambda: live.stalled_items_stream(feed.stream(), HOUR, lambda item: item % 2 == 0, forget_s=24 * HOUR)
    held = lambda name: {r["key"]["item_id"] for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "checkpoint")).select("key").collect()}
    feed.add((0, 1, "running", 1), (0, 2, "queued", 2), (0, 3, "cancelling", 3), (0, 4, "done", 4))
    feed.add((HOUR, 2, "running", 5))
    feed.add((2 * HOUR, 9, "running", 6))
    with rocksdb_state(spark):
        first = feed.run(stalled(), "update")
        assert {(r["item_id"], r["new_state"]) for r in first if r["stalled"]} == {(1, "paused"), (3, "cancelled"), (4, "done")}
        assert held("last") == {1, 2, 3, 4, 9} and held("stalled") == {1, 3, 4}
        # The stream starts again from its checkpoint, in the middle of what it holds.
        feed.add((2 * HOUR + 60, 1, "running", 7))  # item 1 goes on
        feed.add((5, 3, "running", 8))  # comes too late
        feed.add((9 * HOUR, 9, "pausing", 9))
        second = feed.run(stalled(), "update")
        last = {r["item_id"]: (r["new_state"], r["stalled"]) for r in second}
        assert [r["stalled"] for r in second if r["item_id"] == 1] == [False, True]
        assert last[1] == ("paused", True) and last[2] == ("queued", True) and 3 not in last and 9 not in last
        # A day after they stalled items leave nothing, and what comes then is a new item's.
        feed.add((40 * HOUR, 9, "done", 10))
        feed.run(stalled(), "update")
        assert all(held(name) == {9} for name in ("last", "due")) and held("stalled") == set()
        feed.add((40 * HOUR + 5, 1, "running", 11))
        assert [r for r in feed.run(stalled(), "update") if r["item_id"] == 1] == [] and held("last") == {1, 9}
