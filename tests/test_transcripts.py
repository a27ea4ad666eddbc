"""Literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from tapework.operators import alignment, decisions, intervals, scripts, segmentation, timeline
from tapework.plans import text_queries
from tapework.sources import files
from tapework.streaming import live

US = 1_000_000
LAYOUT = segmentation.Layout(available=1000.0, half_width=16.0)


def tokens_of(spark, text, step=100_000, item=1):
    rows = [(item, k, f"t{k}", c, c, k * step, (k + 1) * step, False) for k, c in enumerate(text)]
    return spark.createDataFrame(rows, "item_id long, pos long, token_id string, text string, original_text string, start_us long, end_us long, edited boolean")


def spans(df):
    return sorted((r["start_us"], r["end_us"]) for r in df.collect())


def media(spark, seconds=10):
    return spark.createDataFrame([(1, seconds * US)], "item_id long, duration_us long")


def frame(spark, rows):
    return spark.createDataFrame([(1, int(a * US), int(b * US)) for a, b in rows], "item_id long, start_us long, end_us long")


def test_merge_and_complement(spark):
    merged = intervals.merge_intervals(frame(spark, [(1, 2), (2.03, 3), (5, 5.01), (4, 3)]), media(spark))
    assert spans(merged) == [(1 * US, 3 * US)]
    assert spans(intervals.complement_intervals(merged, media(spark))) == [(0, 1 * US), (3 * US, 10 * US)]
    assert spans(intervals.complement_intervals(frame(spark, [(0, 10)]), media(spark))) == [(0, 10 * US)]
    slivers = frame(spark, [(0, 2), (2.04, 10)])
    assert spans(intervals.complement_intervals(slivers, media(spark))) == [(0, 10 * US)]


def test_speech_is_protected(spark):
    """A silence inside the third token is cut down to what no speech covers."""
    speech = frame(spark, [(7.16, 7.4), (7.4, 7.6), (7.6, 8.36)])
    assert spans(intervals.subtract_intervals(frame(spark, [(7.49, 7.91)]), speech)) == []
    assert spans(intervals.subtract_intervals(frame(spark, [(1, 3)]), frame(spark, [(1.5, 2), (2.98, 4)]))) == [(1 * US, 1_500_000), (2 * US, 2_980_000)]


def test_partial_overlap_keeps_tokens(spark):
    times = [(7_100_000, 7_360_000), (7_360_000, 7_440_000), (7_440_000, 7_860_000), (7_880_000, 8_080_000), (8_080_000, 8_280_000)]
    rows = [(1, k, *t) for k, t in enumerate(times)]
    tokens = spark.createDataFrame(rows, "item_id long, pos long, start_us long, end_us long")
    mapped = intervals.map_tokens(tokens, frame(spark, [(0, 7.491), (7.906, 9)])).orderBy("start_us").collect()
    assert [r["pos"] for r in mapped] == [0, 1, 2, 3, 4] and all(r["end_us"] > r["start_us"] for r in mapped)


def deletes(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "item_id long, seq long, type string, confidence double, positions array<bigint>")


@pytest.mark.parametrize(
    ("text", "row", "mode", "why"),
    [
        ("我我们开始", ("stutter", 0.98, [0]), "standard", None),
        ("我们在广我们在广西做获客系统", ("false_start", 0.97, [0, 1, 2, 3]), "standard", None),
        ("我我们开始", ("stutter", 0.98, [0, 2]), "standard", "non_contiguous_tokens"),
        ("我我们开始", ("stutter", 0.98, [4]), "standard", "missing_adjacent_evidence"),
        ("24小时24小时在线", ("exact_repeat", 0.98, [0]), "standard", "protected_content"),
        ("我们我们开始", ("semantic_repeat", 0.95, [0, 1]), "conservative", "policy_or_confidence"),
        ("我们我们开", ("exact_repeat", 0.95, [0, 1, 2]), "standard", "exact_repeat_not_found"),
        ("啊啊啊", ("exact_repeat", 0.95, [0, 1]), "standard", "exact_repeat_not_found"),
        ("嗯好", ("filler", 0.95, [0]), "standard", None),
    ],
)
def test_deletes(spark, text, row, mode, why):
    got = decisions.accept_deletes(deletes(spark, row), tokens_of(spark, text), mode).collect()[0]
    assert got["skip_reason"] == why and got["applied"] == (why is None)


def test_delete_budget_and_overlap(spark):
    rows = [("filler", 0.95, [0]), ("filler", 0.95, [0]), ("filler", 0.95, [2]), ("filler", 0.95, [4])]
    got = decisions.accept_deletes(deletes(spark, *rows), tokens_of(spark, "嗯好嗯好嗯"), "standard").orderBy("seq").collect()
    assert [r["skip_reason"] for r in got] == [None, "overlapping_delete", None, "deletion_budget_exceeded"]
    assert (got[0]["start_us"], got[0]["end_us"]) == (0, 125_000)


def test_correction(spark):
    ann = spark.createDataFrame([(1, 0, [3], "类", 0.96, "x")], "item_id long, seq long, positions array<bigint>, replacement string, confidence double, reason string")
    got = decisions.apply_corrections(tokens_of(spark, "分为三内"), ann).orderBy("pos").collect()
    assert "".join(r["text"] for r in got) == "分为三类" and got[3]["edited"]


def test_conservation(spark):
    source = spark.createDataFrame([(1, k, f"t{k}") for k in range(3)], "item_id long, pos long, token_id string")
    none = source.where(F.lit(False))
    assert decisions.token_conservation(source, source, none).count() == 0
    assert decisions.token_conservation(source, source.where("pos < 2"), none).collect()[0]["missing"] == 1
    assert decisions.token_conservation(source, source.where("pos < 2"), source.where("pos = 2")).count() == 0


def test_alignment_outcomes(spark):
    text = ["我", "们", "在", "广", "西", "做", "ai", "货", "客", "系", "统"]
    tokens = spark.createDataFrame([(i, k, f"t{k}", c) for i in (1, 2, 3) for k, c in enumerate(text)], "item_id long, pos long, token_id string, text string")
    written = spark.createDataFrame([(1, "我们在广西做AI获客系统。"), (2, "我们在广西做|AI获客系统。"), (3, "今天天气很好，去公园走走吧")], "item_id long, script string")
    got = alignment.align_script(tokens, written)
    status = {r["item_id"]: r["status"] for r in got["report"].collect()}
    assert status == {1: "aligned", 2: "aligned", 3: "rejected"}
    rows = {(r["item_id"], r["pos"]): r for r in got["tokens"].collect()}
    assert rows[1, 7]["text"] == "获" and rows[1, 10]["script_sentence_break_after"] and rows[3, 7]["text"] == "货"
    assert rows[2, 5]["manual_break_after"] and not rows[1, 5]["manual_break_after"]


def test_clips(spark):
    schema = "item_id long, clip_idx long, from_us long, to_us long, gap boolean"
    clips = spark.createDataFrame([(1, 1, 0, 1 * US, False), (1, 2, 1 * US, 2 * US, False), (1, 3, 3 * US, 4 * US, False)], schema)
    assert sorted((r["from_us"], r["to_us"]) for r in timeline.coalesce_clips(clips).collect()) == [(0, 2 * US), (3 * US, 4 * US)]


def test_phrases_and_sections(spark):
    df = spark.createDataFrame([(1, "今天我们来讲一讲如何用AI工具提高工作效率并且节省时间。好")], "doc_id long, text string")
    got = [r["phrase"] for r in scripts.split_phrases(df).orderBy("phrase_idx").collect()]
    assert "".join(got) == "今天我们来讲一讲如何用AI工具提高工作效率并且节省时间。好" and max(map(len, got)) <= 18
    doc = "# 01. 标题\n## 内容标题\n[待确认]\n## 逐字稿\n\n正文一\n\n\n正文二\n## 备注\nx\n"
    row = scripts.sectionize(spark.createDataFrame([(1, doc, "2024-01-02_x")], "doc_id long, text string, stem string"), "md").collect()[0]
    assert (row["content_title"], row["transcript"], row["transcript_source"], row["error"]) == ("标题", "正文一\n\n正文二", "逐字稿", None)
    twice = scripts.sectionize(spark.createDataFrame([(1, "## 逐字稿\na\n## 逐字稿\nb", "x")], "doc_id long, text string, stem string"), "md").collect()[0]
    assert twice["error"] == "section repeated: 逐字稿"


def test_sections_of_whole_texts(spark, tmp_path):
    names = ["内容标题", "逐字稿", "备注", "最终文案", "封面标题"]
    texts = ["a\nb\nc", "\n".join(f"line {k}" for k in range(12)), "a\nb\nc\nd\ne\n\ng", "one", "x" * 5_000 + "\ny\nz\nu\nv\ntodo\nw", None, "\n\na\n\n\n\n\nb"]
    docs = [(k, t) for k, t in enumerate(texts * 5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["transcript"], r["transcript_source"], r["error"]) for r in text_queries.sections(spark, str(tmp_path)).collect()}
    want = {}
    for k, text in docs:
        bodies = {}
        for i, line in enumerate((text or "").split("\n")):
            if line not in ("", "todo"):
                bodies.setdefault(names[(k + i) % 5], []).append(line)
        source = next((n for n in ("逐字稿", "最终文案") if n in bodies), None)
        twice = sorted(n for n, b in bodies.items() if len(b) > 1 and n != "备注")
        want[k] = (max(bodies[source]) if source else None, source, f"section repeated: {twice[0]}" if twice else None if source else "no transcript")
    assert got == want and sum("repeated" in (e or "") for _, _, e in want.values()) > 5


def test_damage(spark):
    df = spark.createDataFrame([(1, "fine\nwhat???\nbad �\n鏄x")], "doc_id long, text string")
    assert sorted((r["label"], r["line_no"]) for r in scripts.scan_text_damage(df, "doc_id").collect()) == [("common mojibake", 4), ("repeated question marks", 2), ("replacement character", 3)]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"start_time":0,"end_time":1000,"text":"繁體Claude","words":[{"start_time":0,"end_time":400,"text":"繁體"},{"start_time":400,"end_time":1000,"text":"Claude"}]},{"start_time":1200,"end_time":2000,"text":"没有逐字信息"}]')
    _, tokens = files.read_asr(spark, str(tmp_path / "a.json"))
    got = tokens.orderBy("pos").collect()
    assert got[0]["timing_source"] == "interpolated-within-word" and got[2]["text"] == "Claude" and got[3]["timing_source"] == "estimated"
    cue = spark.createDataFrame([(1, 1, 500_000, 2_000_000, "**a** b")], "item_id long, idx long, start_us long, end_us long, text string")
    files.write_srt(cue, str(tmp_path / "srt"))
    back = files.read_srt(spark, str(tmp_path / "srt" / "item_id=1")).collect()
    assert [(r["start_us"], r["end_us"], r["text"]) for r in back] == [(500_000, 2_000_000, "a b")]
    (tmp_path / "job1").mkdir()
    (tmp_path / "job1" / "job.json").write_text("not json")
    assert files.read_job_tree(spark, str(tmp_path / "job1"))["jobs"].collect()[0]["status"] is None


def test_enrich(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "chunk_id long, payload string").withColumn("content_key", live.content_key("1", "k", "m", F.col("payload")))
    cache = chunks.where("payload = 'b'").select("content_key", F.lit("ok").alias("status"), F.lit("old").alias("result"))
    results, fresh = live.enrich_incremental(chunks, cache, lambda b: b.assign(status="ok", result="new", tokens=5)[["content_key", "status", "result", "tokens"]])
    assert sorted((r["chunk_id"], r["result"], r["tokens"]) for r in results.collect()) == [(1, "new", 5), (2, "old", 0), (3, "new", 5)]
    assert fresh.count() == 1
