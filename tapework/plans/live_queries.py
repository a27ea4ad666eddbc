"""Alignment, sources and live operators over conversations, documents, benchmark and events."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path, stored
from ..operators import alignment, segmentation
from ..sources import files, stages
from ..streaming import live
from ..streaming.run import event_stream, rocksdb_state, run_append, run_update
from .conv import TURNS_SQL, conv_tokens, conv_turns, table
from .segmentation_queries import ORACLE_SQL as SEGMENTATION_SQL


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("script"))
    return alignment.script_units(docs)


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as speech, and a script of each: of every fourth turn it lacks the first word, every ninth item has other vowels, others have changed words and breaks."""
    spoken = stored(conv_turns(spark, sf_dir))
    tokens = conv_tokens(spark, sf_dir, spoken).where("trim(text) <> ''").select("item_id", F.col("pos"), "token_id", "text")
    order = F.row_number().over(segmentation.Window.partitionBy("item_id").orderBy("pos")).cast("long") - 1
    tokens = tokens.withColumn("pos", order)
    turns = spoken.select("item_id", "utt", F.replace(F.replace("text", F.lit(" the "), F.lit(" THE | ")), F.lit(" and "), F.lit(" ")).alias("t"))
    turns = turns.withColumn("t", F.when(F.col("utt") % 4 == 3, F.regexp_replace("t", r"^[^ \n]+[ \n]*", "")).otherwise(F.col("t")))
    scripts = turns.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt", "t"))), lambda x: x["t"]), " ").alias("script"))
    return tokens, scripts.withColumn("script", F.when(F.col("item_id") % 9 == 0, F.translate("script", "aeiou", "qqqqq")).otherwise(F.col("script")))


def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, scripts = _spoken(spark, sf_dir)
    return alignment.alignment_prefilter(tokens, alignment.script_units(scripts))


def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_script(*_spoken(spark, sf_dir))["tokens"]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(alignment.align_script(*_spoken(spark, sf_dir)))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as speech recognition responses, made and read."""
    turns = conv_turns(spark, sf_dir)
    one = F.struct("utt", F.struct((F.col("start_us") / 1000).cast("long").alias("start_time"), (F.col("end_us") / 1000).cast("long").alias("end_time"), "text").alias("u"))
    listed = turns.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["u"]).alias("utterances"))
    text = F.when(F.col("item_id") % 2 == 0, F.to_json("utterances")).otherwise(F.to_json(F.struct("utterances")))
    return files.parse_asr(listed.select("item_id", text.alias("value")), "item_id", "value").select("item_id", "utt", "text", "start_us", "end_us")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_turns(spark, sf_dir).where("trim(text) <> ''").select("item_id", (F.col("utt") + 1).alias("idx"), "start_us", "end_us", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.srt_texts(_cues(spark, sf_dir))


def srt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_srt(files.srt_texts(_cues(spark, sf_dir)), "item_id", "value")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conv_turns(spark, sf_dir).select("item_id", "start_us", F.when(F.col("utt") % 5 == 4, F.col("start_us")).otherwise(F.col("end_us")).alias("end_us"), "text", F.array(F.format_string("u%04d", "utt")).alias("token_ids"))
    return files.parse_segments(files.segments_json(turns)).withColumn("token_ids", F.array_join("token_ids", ","))


def tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties with chatter around them and a path with single backslashes in them."""
    made = F.concat(F.lit('Answer: {"path":"C:\\dir\\q", "kind":"'), F.col("event_type"), F.lit('"} done'))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("no json")).otherwise(made).alias("t"))
    got = rows.withColumn("j", files.parse_tolerant_json(F.col("t"), "path string, kind string"))
    return got.select("event_id", F.col("j.path").alias("path"), F.col("j.kind").alias("kind"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; those of even id that are no copies of odd ones are cached."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("payload"))
    chunks = docs.withColumn("content_key", live.content_key("1", "analysis", "m", F.col("payload")))
    cache = chunks.where("chunk_id % 2 = 0").select("content_key", F.when(F.col("chunk_id") % 3 == 0, "failed").otherwise("ok").alias("status"))
    return live.pending_chunks(chunks, cache).select("chunk_id", "content_key")


def _annotate(rows: pd.DataFrame) -> pd.DataFrame:
    """Stands for a model: a chunk's hash and number of words; chunks of a length divisible by 7 fail."""
    result = [hashlib.md5(p.encode()).hexdigest() for p in rows["payload"]]
    status = ["failed" if len(p) % 7 == 0 else "ok" for p in rows["payload"]]
    return pd.DataFrame({"content_key": rows["content_key"], "status": status, "result": result, "tokens": [len(p.encode().split()) for p in rows["payload"]]})


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, some of which are cached, and what all of them come to."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("payload"))
    chunks = docs.withColumn("content_key", live.content_key("1", "analysis", "m", F.col("payload")))
    cache = chunks.where("chunk_id % 2 = 0").select("content_key", F.when(F.col("chunk_id") % 3 == 0, "failed").otherwise("ok").alias("status"), F.lit("from the cache").alias("result"))
    return live.enrich_incremental(chunks, cache, _annotate)[0]


def scripts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: as they are, with a byte order mark, with bytes that no text has, and their source with Chinese of another encoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    source = F.coalesce("source", F.lit("")).cast("binary")
    made = (
        F.when(F.col("doc_id") % 4 == 0, F.col("b")).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.col("b")))
        .when(F.col("doc_id") % 4 == 2, F.concat(source, F.unhex(F.lit("20D6D0CEC4")))).otherwise(F.concat(F.col("b"), F.unhex(F.lit("FFFF"))))
    )
    return docs.select("doc_id", F.md5(files.script_text(made)).alias("text_md5"))


def job_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs and their orders as items, as the files of a job tree: what each item has, and what was unreadable.

    Every other order has decisions, one in ten of broken JSON, every third a length, and one job file in seven is broken too.
    """
    orders = table(spark, sf_dir, "orders")
    outputs = F.when(F.col("o_orderkey") % 4 == 0, F.create_map(F.lit("video"), F.lit("v.mp4")))
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), outputs.alias("outputs"))
    jobs = orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.lit("done").alias("status"), F.struct(F.collect_list(item).alias("items")).alias("params"))).alias("value"))
    path = lambda rest: F.concat(F.lit("file:/jobs/c"), F.col("o_custkey").cast("string"), rest)
    broken = lambda c, when: F.when(when, F.concat(F.lit("{"), c)).otherwise(c)
    in_item = lambda name: F.concat(F.lit("/work/"), F.col("o_orderkey").cast("string"), F.lit(name))
    parts = [
        jobs.select(path(F.lit("/job.json")).alias("path"), broken(F.col("value"), F.col("o_custkey") % 7 == 0).alias("value")),
        orders.where("o_orderkey % 2 = 0").select(path(in_item("/ai_decisions.json")).alias("path"), broken(F.concat(F.lit('{"deleted":'), F.col("o_orderkey"), F.lit("}")), F.col("o_orderkey") % 10 == 0).alias("value")),
        orders.where("o_orderkey % 3 = 0").select(path(in_item("/checkpoints/media.json")).alias("path"), F.lit('{"original_duration":2.5}').alias("value")),
        orders.select(path(in_item("/other.json")).alias("path"), F.lit("{}").alias("value")),
    ]
    tree = files.job_tables(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    named = lambda kind, c: tree[kind].select("job_id", "item_id", F.col("value").alias(c))
    corrupt = tree["corrupt"].where("item_id IS NOT NULL").select("job_id", "item_id", F.col("kind").alias("corrupt"))
    key = ["job_id", "item_id"]
    return tree["items"].select(*key, "status", "output_count").join(named("ai_decisions", "decisions"), key, "full").join(named("media", "media"), key, "full").join(corrupt, key, "left")


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stage's results: those of even items, then all of them twice over, and another version of some."""
    turns = conv_turns(spark, sf_dir).select("item_id", "utt", "start_us")
    place, key = shared_path(spark, "stages"), ["item_id", "utt"]
    for rows, version in ((turns.where("item_id % 2 = 0"), "1"), (turns.where("utt < 2"), "2"), (turns.union(turns), "1"), (turns, "1")):
        stages.publish_stage(rows, place, "turns", version, key)
    both = [stages.read_stage(spark, place, "turns", v).withColumn("version", F.lit(v)) for v in ("1", "2")]
    return both[0].unionByName(both[1])


def published_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of orders' lines as a stage whose input changes for some orders, published by two runs at once, and then without some orders.

    What has the same input isn't stored again, although the second result would be another.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("line")).agg(F.sum("l_quantity").cast("long").alias("length"))
    place, key = shared_path(spark, "stages"), ["item_id", "line"]
    stages.publish_stage(lines, place, "lengths", "1", key, F.md5(F.col("length").cast("string")))
    changed = F.col("item_id") % 5 == 0
    again = lines.withColumn("length", F.col("length") + F.when(changed, 1000).otherwise(7))
    read = F.md5((F.col("length") - F.when(changed, 0).otherwise(7)).cast("string"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: stages.publish_stage(rows, place, "lengths", "1", key, read), [again.where("line < 4"), again.where("line > 2")]))
    stages.forget_published(spark, place, lines.where("item_id % 7 = 0").select("item_id"))
    return stages.read_stage(spark, place, "lengths", "1")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of a script that has other words for every third token."""
    tokens = conv_tokens(spark, sf_dir).select("item_id", "pos", "text")
    signs = F.array(F.lit("。"), F.lit(","), F.lit(None).cast("string"), F.lit("；"))
    pairs = tokens.where("pos % 5 <> 4").select("item_id", F.col("pos").alias("a"), F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")).alias("replacement"), (F.col("pos") % 7 == 0).alias("manual_break"), F.get(signs, (F.col("pos") % 4).cast("int")).alias("punctuation"))
    return alignment.carry_breaks(tokens, pairs)


def stalled_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that are stalled when the stream of events ends; even ones can be resumed."""
    states = F.element_at(F.array(*[F.lit(s) for s in ("running", "queued", "cancelling", "pausing", "done")]), (F.col("event_id") % 5 + 1).cast("int"))
    events = event_stream(spark, sf_dir).select(F.col("user_id").alias("item_id"), states.alias("state"), "ts", "event_id")
    with rocksdb_state(spark):
        found = run_update(live.stalled_items_stream(events, 43_200, lambda item: item % 2 == 0, forget_s=366 * 86_400), "stalled", ["item_id"])
    return found.where("stalled").select("item_id", "state", "new_state")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = conv_tokens(spark, sf_dir)
    return live.trace_rows(tokens, segmentation.chunk_by_pause(tokens, 100))


def _stages(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("stage"), "ts", "event_id")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_update(live.stage_progress(_stages(event_stream(spark, sf_dir))), "progress", ["item_id"])
    return found.select("item_id", "stage", F.unix_micros("updated_at").alias("updated_us"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice."""
    events = event_stream(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    once = run_append(live.usage_dedup(events.union(events), "60 days"), "usage")
    return once.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("used"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stages(event_stream(spark, sf_dir))
    return run_append(live.stage_latency(events.where("stage = 'view'"), events.where("stage = 'purchase'"), "1 HOUR"), "latency")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).select("ts", (F.col("event_id") % 9 != 0).alias("ok"), (F.col("event_id") % 1000).alias("tokens"))
    found = run_append(live.ops_metrics(events, "1 hour"), "metrics")
    return found.withColumn("window_start", F.unix_micros("window_start"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).select(F.col("user_id").alias("item_id"), "ts")
    return run_append(live.edit_sessions(events, "30 minutes"), "sessions").withColumn("session_start", F.unix_micros("session_start"))


def stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of events as states; now is February 2024, items with even ids can be resumed."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    states = F.element_at(F.array(*[F.lit(s) for s in ("running", "queued", "cancelling", "pausing", "done")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = events.select(F.col("user_id").alias("item_id"), states.alias("state"), "ts", "event_id")
    return live.stalled_items(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), 43_200, F.col("item_id") % 2 == 0)


def quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).select(F.col("user_id").alias("item_id"), "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    found = run_append(live.silence(events, 40.0, "6 hours", 3600.0), "silence")
    return found.select("item_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "samples")


QUERIES = {
    "script_units": units, "alignment_prefilter": prefilter, "align_script": aligned_tokens, "alignment_report": report, "read_asr": responses, "write_srt": srt, "read_srt": srt_read,
    "write_segments": segments, "parse_tolerant_json": tolerant, "enrich_incremental": enriched, "pending_chunks": pending, "read_scripts": scripts_read, "read_job_tree": job_tree, "publish_stage": published, "publish_changed": published_again, "carry_breaks": broken, "stalled_items_stream": stalled_live, "trace_rows": traces, "stage_progress_stream": progress, "usage_dedup_stream": dedup,
    "stage_latency_stream": latency, "ops_metrics_stream": metrics, "edit_sessions_stream": sessions, "stalled_items": stalled, "silence_stream": quiet,
}

_UNITS = r"""cut AS (SELECT item_id, unnest(p) AS text, unnest(range(len(p))) AS k FROM (SELECT item_id, regexp_extract_all(coalesce(script, ''), '(?s)[A-Za-z0-9_+\-./#]+|\||[。！？!?；;]|[，,、：:]|\s+|.') AS p FROM scripts)),
  kinds AS (SELECT *, CASE WHEN text = '|' THEN 'break' WHEN regexp_matches(text, '^[。！？!?；;，,、：:]$') THEN 'sign' WHEN regexp_matches(text, '^[^A-Za-z0-9㐀-鿿]+$') THEN 'none' ELSE 'unit' END AS kind FROM cut),
  numbered AS (SELECT *, count(*) FILTER (WHERE kind = 'unit') OVER (PARTITION BY item_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS unit FROM kinds WHERE kind <> 'none'),
  units AS (SELECT item_id, unit, arg_max(text, k) FILTER (WHERE kind = 'unit') AS text, bool_or(kind = 'break') AS manual_break, arg_max(text, k) FILTER (WHERE kind = 'sign') AS punctuation FROM numbered WHERE unit >= 0 GROUP BY item_id, unit)"""
_SPOKEN = f"""{TURNS_SQL}, scripts AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN translate(script, 'aeiou', 'qqqqq') ELSE script END AS script FROM (
    SELECT conv_id AS item_id, string_agg(CASE WHEN turn % 4 = 3 THEN regexp_replace(t, '^[^ \\n]+[ \\n]*', '') ELSE t END, ' ' ORDER BY turn) AS script FROM (SELECT conv_id, turn, replace(replace(coalesce(text, ''), ' the ', ' THE | '), ' and ', ' ') AS t FROM conversations) GROUP BY conv_id)), {_UNITS}"""
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"

ORACLE_SQL = {
    "script_units": f"WITH scripts AS (SELECT doc_id AS item_id, text AS script FROM documents), {_UNITS} SELECT * FROM units",
    "alignment_prefilter": f"""WITH {_SPOKEN}, a AS (SELECT item_id, lower(replace(text, 'ß', 'ss')) AS f, count(*) AS n FROM conv_tokens WHERE trim(text) <> '' GROUP BY ALL), b AS (SELECT item_id, lower(replace(text, 'ß', 'ss')) AS f, count(*) AS m FROM units GROUP BY ALL),
      s AS (SELECT item_id, sum(least(coalesce(n, 0), coalesce(m, 0))) AS common, sum(coalesce(n, 0))::BIGINT AS token_count, sum(coalesce(m, 0))::BIGINT AS unit_count FROM a FULL JOIN b USING (item_id, f) GROUP BY item_id)
      SELECT item_id, token_count, unit_count, round(2 * common / (token_count + unit_count), 6)::DOUBLE AS upper_ratio, 2 * common / (token_count + unit_count) >= 0.55 AS passes FROM s WHERE token_count > 0 AND unit_count > 0""",
    "read_asr": f"WITH {TURNS_SQL} SELECT item_id, utt + 1 AS utt, trim(c.text) AS text, CASE WHEN start_us // 1000 > 100 THEN start_us ELSE start_us // 1000 * 1000000 END AS start_us, CASE WHEN end_us // 1000 > 100 THEN end_us ELSE end_us // 1000 * 1000000 END AS end_us FROM conv_turns JOIN conversations c ON c.conv_id = item_id AND c.turn = utt WHERE trim(coalesce(c.text, '')) <> ''",
    "write_srt": f"""WITH {TURNS_SQL}, b AS (SELECT item_id, utt, (utt + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', start_us // 3600000000, start_us // 60000000 % 60, start_us // 1000000 % 60, start_us // 1000 % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_us // 3600000000, end_us // 60000000 % 60, end_us // 1000000 % 60, end_us // 1000 % 1000) || chr(10) || regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\*\\*(.+?)\\*\\*', '\\1', 'g') || chr(10) AS block FROM conv_turns JOIN conversations ON conv_id = item_id AND turn = utt WHERE trim(coalesce(text, '')) <> '')
      SELECT item_id, string_agg(block, chr(10) ORDER BY utt) AS value FROM b GROUP BY item_id""",
    "read_srt": f"WITH {TURNS_SQL} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY utt) AS idx, start_us // 1000 * 1000 AS start_us, end_us // 1000 * 1000 AS end_us, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\*\\*(.+?)\\*\\*', '\\1', 'g') AS text FROM conv_turns JOIN conversations ON conv_id = item_id AND turn = utt WHERE trim(coalesce(text, '')) <> ''",
    "write_segments": f"WITH {TURNS_SQL} SELECT item_id, start_us, end_us, coalesce(text, '') AS text, printf('u%04d', utt) AS token_ids FROM conv_turns JOIN conversations ON conv_id = item_id AND turn = utt WHERE utt % 5 <> 4 AND end_us > start_us",
    "parse_tolerant_json": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'C:\\dir\\q' END AS path, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind FROM events",
    "enrich_incremental": """WITH c AS (SELECT doc_id, coalesce(text, '') AS p, sha256('1' || chr(1) || 'analysis' || chr(1) || 'm' || chr(1) || coalesce(text, '')) AS content_key FROM documents), k AS (SELECT *, bool_or(doc_id % 2 = 0 AND doc_id % 3 <> 0) OVER (PARTITION BY content_key) AS cached FROM c)
      SELECT doc_id AS chunk_id, content_key, CASE WHEN NOT cached AND length(p) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN cached THEN 'from the cache' ELSE md5(p) END AS result, CASE WHEN cached THEN 0 ELSE len(regexp_extract_all(p, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS tokens, cached FROM k""",
    "read_scripts": "SELECT doc_id, md5(CASE WHEN doc_id % 4 = 2 THEN coalesce(source, '') || ' 中文' ELSE coalesce(text, '') END) AS text_md5 FROM documents",
    "read_job_tree": """SELECT 'c' || o_custkey AS job_id, o_orderkey::VARCHAR AS item_id, CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_custkey % 7 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END END AS output_count,
      CASE WHEN o_orderkey % 10 = 0 THEN '{}' WHEN o_orderkey % 2 = 0 THEN '{"deleted":' || o_orderkey || '}' END AS decisions, CASE WHEN o_orderkey % 3 = 0 THEN '{"original_duration":2.5}' END AS media, CASE WHEN o_orderkey % 10 = 0 THEN 'ai_decisions' END AS corrupt
      FROM orders WHERE o_custkey % 7 <> 0 OR o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
    "publish_changed": "SELECT l_orderkey AS item_id, l_linenumber AS line, sum(l_quantity)::BIGINT + CASE WHEN l_orderkey % 5 = 0 THEN 1000 ELSE 0 END AS length FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey, l_linenumber",
    "publish_stage": f"WITH {TURNS_SQL} SELECT item_id, utt, start_us, '1' AS version FROM conv_turns UNION ALL SELECT item_id, utt, start_us, '2' FROM conv_turns WHERE utt < 2",
    "carry_breaks": f"WITH {TURNS_SQL}, p AS (SELECT item_id, pos, text, pos % 5 <> 4 AS paired, ['。', ',', NULL, '；'][pos % 4 + 1] AS sign FROM conv_tokens) SELECT item_id, pos, CASE WHEN paired AND pos % 3 = 0 THEN text || '+' ELSE text END AS text, text AS original_text, paired AND pos % 7 = 0 AS manual_break_after, CASE WHEN paired THEN sign END AS script_punctuation_after, paired AND coalesce(sign IN ('。', '；'), false) AS script_sentence_break_after, paired AND coalesce(sign = ',', false) AS script_phrase_break_after FROM p",
    "stalled_items_stream": "WITH l AS (SELECT user_id AS item_id, arg_max(['running', 'queued', 'cancelling', 'pausing', 'done'][event_id % 5 + 1], (ts, event_id)) AS state, max(ts) AS t FROM events GROUP BY user_id) SELECT item_id, state, CASE WHEN state = 'cancelling' THEN 'cancelled' WHEN state = 'pausing' THEN 'paused' WHEN state IN ('running', 'queued') THEN CASE WHEN item_id % 2 = 0 THEN 'queued' ELSE 'paused' END ELSE state END AS new_state FROM l WHERE epoch_ms(t) + 43200000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events)",
    "pending_chunks": "WITH c AS (SELECT doc_id, sha256('1' || chr(1) || 'analysis' || chr(1) || 'm' || chr(1) || coalesce(text, '')) AS content_key FROM documents) SELECT min(doc_id) AS chunk_id, content_key FROM c GROUP BY content_key HAVING NOT bool_or(doc_id % 2 = 0 AND doc_id % 3 <> 0)",
    "trace_rows": f"WITH chunks AS ({SEGMENTATION_SQL['chunk_by_pause']}), {TURNS_SQL} SELECT t.item_id, chunk, arg_min(token_id, pos) AS first_token, arg_max(token_id, pos) AS last_token, count(*) AS tokens, sha256(string_agg(text, '' ORDER BY pos)) AS text_sha256 FROM chunks c JOIN conv_tokens t ON t.item_id = c.item_id AND t.pos BETWEEN first_pos AND last_pos GROUP BY t.item_id, chunk",
    "stage_progress_stream": "SELECT user_id AS item_id, arg_max(event_type, (ts, event_id)) AS stage, epoch_us(max(ts)) AS updated_us FROM events GROUP BY user_id",
    "usage_dedup_stream": "SELECT user_id, count(*) AS events, round(sum(value), 6) AS used FROM events GROUP BY user_id",
    "stage_latency_stream": "SELECT a.user_id AS item_id, a.event_id AS first_id, b.event_id AS last_id, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000 AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR",
    "ops_metrics_stream": f"WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS calls, count(*) FILTER (WHERE event_id % 9 = 0) AS failures, sum(event_id % 1000)::BIGINT AS tokens FROM events GROUP BY 1) SELECT epoch_us(s) AS window_start, calls, failures, round(1 - failures / calls, 6) AS success_rate, tokens FROM w WHERE s + INTERVAL 1 HOUR <= {_CLOSED}",
    "edit_sessions_stream": f"WITH g AS (SELECT user_id AS item_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY ts) AS s FROM g), t AS (SELECT item_id, min(ts) AS a, max(ts) AS b, count(*) AS edits FROM n GROUP BY item_id, s) SELECT item_id, epoch_us(a) AS session_start, (epoch_us(b) - epoch_us(a)) / 1000000 AS seconds, edits FROM t WHERE b + INTERVAL 30 MINUTE <= {_CLOSED}",
    "stalled_items": "WITH l AS (SELECT user_id AS item_id, arg_max(['running', 'queued', 'cancelling', 'pausing', 'done'][event_id % 5 + 1], (ts, event_id)) AS state, max(ts) AS t FROM events GROUP BY user_id) SELECT item_id, state, CASE WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(t) <= 43200000000 THEN state WHEN state = 'cancelling' THEN 'cancelled' WHEN state = 'pausing' THEN 'paused' WHEN state IN ('running', 'queued') THEN CASE WHEN item_id % 2 = 0 THEN 'queued' ELSE 'paused' END ELSE state END AS new_state FROM l",
    "silence_stream": f"WITH q AS (SELECT user_id AS item_id, ts FROM events WHERE coalesce(value, 0) < 40), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY item_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM q), n AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY ts) AS s FROM g), t AS (SELECT item_id, min(ts) AS a, max(ts) AS b, count(*) AS samples FROM n GROUP BY item_id, s) SELECT item_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, samples FROM t WHERE b + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE coalesce(value, 0) < 40) AND epoch_us(b) - epoch_us(a) >= 3600000000",
}
