"""Clean-up of annotations over events, and of sentences, tokens and title clips over the conversation timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sanitize
from .conv import TURNS_SQL, conv_media, conv_tokens, conv_turns, table

#: What a model might answer for an event, as SQL text of both engines: entries that stay, that don't, and confidences of all kinds.
_CONFIDENCE = """CASE WHEN event_id % 97 = 5 THEN '"sure"' WHEN event_id % 97 = 6 THEN 'null' WHEN event_id % 5 = 0 THEN '0.5' WHEN event_id % 5 = 1 THEN '"0.75"' WHEN event_id % 5 = 2 THEN '1.5' WHEN event_id % 5 = 3 THEN '-2' ELSE '0.25' END"""
_RESPONSE = f"""CASE WHEN event_id % 89 = 7 THEN '{{"delete_ranges": [' ELSE concat(
  'Answer: {{"delete_ranges":[{{"token_ids":["t', event_id, '","",7],"type":"', event_type, '","confidence":', {_CONFIDENCE}, ',"reason":"', repeat('r', CAST(event_id % 400 AS INT)), '"}},{{"token_ids":"t1","confidence":1}},5,{{"token_ids":["a"],"type":"filler"}}],',
  '"protected_spans":[{{"token_ids":["a"],"text":"z","confidence":1}},{{"token_ids":["a","b"],"text":"', repeat('x', CAST(event_id % 350 AS INT)), '","confidence":', {_CONFIDENCE}, '}}],',
  '"corrections":[{{"token_ids":[],"replacement":"', event_type, '","confidence":2}},{{"token_ids":["c"],"replacement":"","confidence":0.1}}],',
  '"break_hints":[{{"after_token_id":"k', event_id % 10, '","confidence":-1}},{{"confidence":"no"}}],"allowed_breaks":{{"after_token_id":"x"}},',
  '"forbidden_breaks":[{{"token_ids":["a","b"],"text":"ab","confidence":0.7}},{{"token_ids":["a"],"after_token_id":"q","confidence":0.8}},{{"confidence":0.9}}],',
  '"repeat_candidates":[{{"token_ids":["r1","r2"],"confidence":0.6,"reason":"again"}}],"final_sentences":[{{"token_ids":["a"],"text":"', repeat('s', CAST(event_id % 1100 AS INT)), '"}}]}} bye') END"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.expr(_RESPONSE).alias("value"))
    cleaned = sanitize.sanitize_annotations(raw)
    return cleaned.withColumns({"token_ids": F.array_join("token_ids", ","), "text": F.md5("text"), "reason": F.md5("reason")})


_ID = "CASE WHEN utt % 4 < 2 THEN 's001' WHEN utt % 4 = 2 THEN 's001-2' WHEN utt = 7 THEN '!' ELSE concat('x ', utt, '!') END"
_NEW = {
    "start_us": "CASE WHEN (item_id + utt) % 5 <> 0 THEN start_us - 500000 + utt * 1000 END", "end_us": "CASE WHEN (item_id + utt) % 7 = 1 THEN start_us - 600000 WHEN (item_id + utt) % 7 <> 0 THEN end_us + 3000000 END",
    "clip_start_us": "CASE WHEN item_id % 3 <> 0 OR utt <> 1 THEN start_us END", "clip_end_us": "CASE WHEN utt % 6 = 5 THEN start_us - 1 ELSE end_us END", "text": "CASE WHEN utt % 5 <> 4 THEN concat('  ', text, ' ') END", "original_text": "CASE WHEN utt % 2 = 1 THEN text END",
    "enabled": "CASE WHEN utt % 3 <> 0 THEN utt % 3 = 1 END", "remove_video": "CAST(NULL AS BOOLEAN)", "gap": "CASE WHEN utt <> 1 THEN utt = 2 END", "synthetic_gap": "utt = 2 OR utt = 3", "edited": "CASE WHEN utt % 2 = 0 THEN utt % 4 = 2 END", "timing_pending": "CAST(NULL AS BOOLEAN)",
    "timeline_order": "CASE WHEN utt % 3 <> 0 THEN CAST(8 - utt AS DOUBLE) END", "layout_source": "CASE WHEN utt % 2 = 0 THEN '' ELSE repeat('abc', 20) END", "layout_reason": "CAST(NULL AS STRING)",
}
_OLD = {
    "start_us": "k * 1500000", "end_us": "CASE WHEN k <> 2 THEN k * 1500000 + 900000 END", "clip_start_us": "CASE WHEN k <> 1 THEN k * 1400000 END", "clip_end_us": "k * 1400000 + 1000000", "text": "concat('old ', k)", "original_text": "concat('older ', k)",
    "enabled": "k % 2 = 0", "remove_video": "k = 1", "gap": "k = 1", "synthetic_gap": "k = 2", "edited": "k = 0", "timing_pending": "k = 3", "timeline_order": "CAST(k * 2 AS DOUBLE)", "layout_source": "concat('from ', k)", "layout_reason": "concat('why ', k)",
}
_OLD_IDS = ["s001", "s001-2", "s-x-3", "s001-3"]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences with odd ids and times and with gaps in their fields, over four old sentences of each item."""
    turns = conv_turns(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("item_id").orderBy("utt")).cast("long"))
    new = turns.select("item_id", "idx", F.expr(_ID).alias("sentence_id"), *[F.expr(v).alias(c) for c, v in _NEW.items()])
    ids = turns.select("item_id").distinct().select("item_id", F.posexplode(F.array(*map(F.lit, _OLD_IDS))).alias("k", "sentence_id"))
    old = ids.select("item_id", "sentence_id", *[F.expr(v).alias(c) for c, v in _OLD.items()])
    return sanitize.sanitize_sentences(new, old, conv_media(spark, sf_dir))


_FIRST, _LAST = "CASE WHEN pos % 3 <> 0 THEN start_us - pos % 7 * 200000 END", "CASE WHEN pos % 4 <> 0 THEN end_us + pos % 5 * 300000 END"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of turns without blanks; a turn with a place of 149 mod 150 has lost that token, and so doesn't spell its text."""
    turns = conv_turns(spark, sf_dir).select("item_id", F.concat(F.lit("s"), F.col("utt").cast("string")).alias("sentence_id"), "text", "start_us", "end_us")
    some = conv_tokens(spark, sf_dir).where("trim(text) <> '' AND pos % 150 <> 149")
    some = some.select("item_id", F.concat(F.lit("s"), F.col("utt").cast("string")).alias("sentence_id"), F.col("pos").alias("idx"), F.expr("CASE WHEN pos % 11 <> 0 THEN token_id END").alias("token_id"), "text", F.lit(None).cast("string").alias("original_text"), F.expr(_FIRST).alias("start_us"), F.expr(_LAST).alias("end_us"), F.lit("").alias("timing_source"), F.expr("pos % 2 = 0").alias("edited"))
    return sanitize.sanitize_tokens(some, turns)


_CLIP = {
    "clip_id": "CASE WHEN utt % 3 = 0 THEN 't1' WHEN utt % 3 = 1 THEN concat('--', utt) ELSE '' END", "start_us": "CASE WHEN utt % 2 = 0 THEN start_us END", "end_us": "CASE WHEN utt % 4 = 1 THEN 0 WHEN utt % 4 <> 2 THEN end_us + 9000000 END",
    "text": "CASE WHEN utt % 5 = 0 THEN text END", "enabled": "CASE WHEN utt % 2 = 1 THEN true END", "use_for_cover": "CASE WHEN utt <> 3 THEN (item_id + utt) % 6 = 5 END",
}
_OLD_CLIP = {"clip_id": "t1", "start_us": "item_id * 1000", "end_us": "item_id * 1000 + 700000", "text": "'old'", "enabled": "item_id % 2 = 0", "use_for_cover": "item_id % 5 = 0"}


def title_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as title clips; every fourth item has none."""
    turns = conv_turns(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("item_id").orderBy("utt")).cast("long"))
    new = turns.where("item_id % 4 <> 0").select("item_id", "idx", *[F.expr(v).alias(c) for c, v in _CLIP.items()])
    titles = conv_media(spark, sf_dir).select("item_id", "duration_us", F.expr("concat('Title ', item_id)").alias("title_text"), F.expr("item_id % 8 = 0").alias("show_title"))
    old = titles.select("item_id", F.lit("t1").alias("clip_id"), *[F.expr(v).alias(c) for c, v in _OLD_CLIP.items() if c != "clip_id"])
    return sanitize.sanitize_title_clips(new, old, titles)


QUERIES = {"sanitize_annotations": annotations, "sanitize_sentences": sentences, "sanitize_tokens": tokens, "sanitize_title_clips": title_clips}


def _ids_sql(prefix: str) -> str:
    """CTE ids: item_id, idx and the clean id, name by name with the list of those that are used."""
    return f"""bases AS (SELECT item_id, idx, left(CASE WHEN starts_with(p, '{prefix}') THEN p ELSE '{prefix}-' || p END, 40) AS base FROM (SELECT item_id, idx, coalesce(nullif(regexp_replace(regexp_replace(id, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), printf('{prefix}%03d', idx)) AS p FROM handed)),
      ids AS (SELECT item_id, 0::BIGINT AS idx, ''::VARCHAR AS id, []::VARCHAR[] AS used FROM (SELECT DISTINCT item_id FROM bases)
        UNION ALL SELECT item_id, idx, id, list_append(used, id) FROM (SELECT b.item_id, b.idx, i.used, CASE WHEN NOT list_contains(i.used, base) THEN base ELSE list_filter(list_transform(range(2, 40), lambda n: base || '-' || n), lambda c: NOT list_contains(i.used, c))[1] END AS id FROM ids i JOIN bases b ON b.item_id = i.item_id AND b.idx = i.idx + 1))"""


def _pick(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {c}" for c, v in columns.items()).replace("AS STRING", "AS VARCHAR")


_ENTRIES = """read AS (SELECT event_id AS item_id, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM (SELECT event_id, regexp_extract(value, '(?s)\\{.*\\}') AS b FROM raw)),
  kinds AS (SELECT unnest(['corrections', 'break_hints', 'allowed_breaks', 'forbidden_breaks', 'protected_spans', 'repeat_candidates', 'delete_ranges', 'final_sentences']) AS kind),
  listed AS (SELECT item_id, kind, CASE WHEN json_type(j, '$.' || kind) = 'ARRAY' THEN (j -> ('$.' || kind))::JSON[] ELSE [] END AS l FROM read, kinds WHERE j IS NOT NULL),
  entries AS (SELECT item_id, kind, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS seq FROM listed),
  fields AS (SELECT item_id, kind, seq, coalesce(json_type(v, '$.token_ids') = 'ARRAY', false) AS is_list, CASE WHEN json_type(v, '$.token_ids') = 'ARRAY' THEN list_filter(list_transform((v -> '$.token_ids')::JSON[], lambda x: x ->> '$'), lambda x: x <> '') ELSE [] END AS ids,
    v ->> '$.after_token_id' AS a, v ->> '$.type' AS t, left(coalesce(v ->> '$.text', ''), CASE WHEN kind = 'final_sentences' THEN 1000 ELSE 300 END) AS x, left(coalesce(v ->> '$.replacement', ''), 300) AS r, left(coalesce(v ->> '$.reason', ''), 300) AS why,
    json_exists(v, '$.confidence') AS given, TRY_CAST(v ->> '$.confidence' AS DOUBLE) AS c FROM entries),
  judged AS (SELECT *, len(ids) >= 2 AND x <> '' AS span, coalesce(a, '') <> '' AS has_after FROM fields),
  ruled AS (SELECT *, CASE kind WHEN 'forbidden_breaks' THEN span OR has_after WHEN 'break_hints' THEN has_after WHEN 'allowed_breaks' THEN has_after WHEN 'protected_spans' THEN is_list AND span WHEN 'delete_ranges' THEN is_list AND len(ids) > 0 WHEN 'final_sentences' THEN is_list AND len(ids) > 0 AND x <> '' WHEN 'corrections' THEN is_list AND r <> '' ELSE is_list END AS stays FROM judged),
  failed AS (SELECT item_id FROM read WHERE j IS NULL UNION SELECT item_id FROM ruled WHERE given AND c IS NULL AND CASE kind WHEN 'forbidden_breaks' THEN true WHEN 'corrections' THEN is_list WHEN 'final_sentences' THEN false ELSE stays END),
  good AS (SELECT *, kind IN ('break_hints', 'allowed_breaks') OR (kind = 'forbidden_breaks' AND NOT span) AS boundary FROM ruled WHERE stays AND item_id NOT IN (SELECT item_id FROM failed))"""

ORACLE_SQL = {
    "sanitize_annotations": f"""WITH raw AS (SELECT event_id, {_RESPONSE} AS value FROM events), {_ENTRIES}
      SELECT * REPLACE (md5(reason) AS reason) FROM (SELECT item_id, kind, seq, CASE WHEN boundary THEN '' ELSE array_to_string(ids, ',') END AS token_ids, CASE WHEN boundary THEN a END AS after_token_id, CASE WHEN kind = 'delete_ranges' THEN CASE WHEN t IN ('stutter', 'false_start', 'exact_repeat', 'semantic_repeat', 'filler', 'redundant') THEN t ELSE 'redundant' END END AS type,
        CASE WHEN kind IN ('protected_spans', 'final_sentences') OR (kind = 'forbidden_breaks' AND span) THEN md5(x) END AS text, CASE WHEN kind = 'corrections' THEN r END AS replacement, CASE WHEN kind <> 'final_sentences' THEN CASE WHEN given THEN greatest(0.0, least(1.0, c)) ELSE 0.0 END END::DOUBLE AS confidence, CASE WHEN kind <> 'final_sentences' THEN why END AS reason FROM good
      UNION ALL SELECT item_id, 'quarantined', 0, '', NULL, NULL, NULL, NULL, NULL, NULL FROM failed)""",
    "sanitize_sentences": f"""WITH RECURSIVE {TURNS_SQL}, turns AS (SELECT c.*, coalesce(s.text, '') AS text, row_number() OVER (PARTITION BY item_id ORDER BY utt) AS idx FROM conv_turns c JOIN conversations s ON s.conv_id = c.item_id AND s.turn = c.utt),
      handed AS (SELECT item_id, idx, {_ID} AS id, {_pick(_NEW)} FROM turns), {_ids_sql("s")},
      old AS (SELECT item_id, id, {_pick(_OLD)} FROM (SELECT DISTINCT item_id FROM turns), (SELECT unnest({_OLD_IDS}) AS id, unnest(range(4)) AS k)),
      had AS (SELECT n.item_id, n.idx, i.id AS sentence_id, m.duration_us AS d, {", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in _NEW if not c.startswith("layout"))}, left(coalesce(nullif(n.layout_source, ''), o.layout_source, ''), 40) AS layout_source, left(coalesce(n.layout_reason, o.layout_reason, ''), 300) AS layout_reason
        FROM handed n JOIN ids i USING (item_id, idx) JOIN conv_media m USING (item_id) LEFT JOIN old o ON o.item_id = n.item_id AND o.id = i.id),
      tops AS (SELECT *, CASE WHEN coalesce(synthetic_gap, false) AND coalesce(gap, false) THEN 3600000000 ELSE d END AS top FROM had),
      a AS (SELECT * REPLACE (greatest(0, least(top, coalesce(start_us, 0))) AS start_us) FROM tops),
      b AS (SELECT * REPLACE (CASE WHEN e <= start_us THEN least(top, start_us + 200000) ELSE e END AS end_us) FROM (SELECT *, greatest(0, least(top, coalesce(end_us, least(top, start_us + 200000)))) AS e FROM a)),
      c AS (SELECT *, bool_or(clip_start_us IS NULL OR clip_end_us IS NULL) OVER (PARTITION BY item_id) AS stretch, greatest(0, least(top, coalesce(clip_start_us, start_us))) AS cs, greatest(0, least(top, coalesce(clip_end_us, end_us))) AS ce, left(trim(coalesce(text, '')), 1000) AS x FROM b),
      f AS (SELECT *, CASE WHEN ce <= cs THEN least(top, cs + 50000) ELSE ce END AS ce2, left(trim(coalesce(original_text, x)), 1000) AS o, greatest(0.0, least(100000.0, coalesce(timeline_order, idx)))::DOUBLE AS ord FROM c)
      SELECT item_id, sentence_id, row_number() OVER (PARTITION BY item_id ORDER BY ord, start_us, end_us, sentence_id) AS timeline_order, start_us::BIGINT AS start_us, end_us::BIGINT AS end_us, (CASE WHEN stretch AND row_number() OVER w = 1 THEN 0 ELSE cs END)::BIGINT AS clip_start_us, (CASE WHEN stretch THEN greatest(ce2, coalesce(lead(start_us) OVER w, d)) ELSE ce2 END)::BIGINT AS clip_end_us,
        x AS text, o AS original_text, coalesce(enabled, true) AS enabled, coalesce(remove_video, false) AS remove_video, coalesce(gap, false) AS gap, coalesce(synthetic_gap, false) AND coalesce(gap, false) AS synthetic_gap, coalesce(edited, false) OR x <> o AS edited, coalesce(timing_pending, false) AS timing_pending, layout_source, layout_reason
      FROM f WINDOW w AS (PARTITION BY item_id ORDER BY start_us, end_us, sentence_id)""",
    "sanitize_tokens": f"""WITH {TURNS_SQL}, turns AS (SELECT c.item_id, 's' || c.utt AS sentence_id, c.utt, coalesce(s.text, '') AS text, start_us AS f, end_us AS t FROM conv_turns c JOIN conversations s ON s.conv_id = c.item_id AND s.turn = c.utt),
      held AS (SELECT k.item_id, u.sentence_id, pos AS idx, CASE WHEN pos % 11 <> 0 THEN token_id ELSE printf('%s-w%04d', u.sentence_id, pos) END AS token_id, k.text, greatest(f, least(t, coalesce({_FIRST}, f))) AS s, greatest(greatest(f, least(t, coalesce({_FIRST}, f))), least(t, coalesce({_LAST}, greatest(f, least(t, coalesce({_FIRST}, f)))))) AS e, pos % 2 = 0 AS edited FROM conv_tokens k JOIN turns u ON u.item_id = k.item_id AND u.utt = k.utt WHERE trim(k.text) <> '' AND pos % 150 <> 149),
      spelled AS (SELECT item_id, sentence_id, string_agg(text, '' ORDER BY idx) AS x FROM held GROUP BY item_id, sentence_id),
      judged AS (SELECT turns.*, coalesce(regexp_replace(x, '^\\s+|\\s+$', '', 'g') = regexp_replace(replace(text, ' ', ''), '^\\s+|\\s+$', '', 'g'), false) AS ok FROM turns LEFT JOIN spelled USING (item_id, sentence_id)),
      made AS (SELECT j.item_id, j.sentence_id, k + 1 AS idx, printf('%s-w%04d', j.sentence_id, k + 1) AS token_id, piece, f, t, units, k, sum(units) OVER (PARTITION BY j.item_id, j.sentence_id ORDER BY k) AS c, sum(units) OVER (PARTITION BY j.item_id, j.sentence_id) AS total, count(*) OVER (PARTITION BY j.item_id, j.sentence_id) AS n FROM conv_cut x JOIN judged j ON j.item_id = x.item_id AND j.utt = x.utt WHERE NOT ok)
      SELECT s.item_id, s.sentence_id, idx, left(token_id, 80) AS token_id, left(s.text, 200) AS text, left(s.text, 200) AS original_text, s::BIGINT AS start_us, e::BIGINT AS end_us, 'estimated' AS timing_source, edited FROM held s JOIN judged j ON j.item_id = s.item_id AND j.sentence_id = s.sentence_id WHERE ok
      UNION ALL SELECT item_id, sentence_id, idx, token_id, piece, piece, (f + floor(greatest(1000, t - f) * (c - units) / total))::BIGINT, greatest(f + floor(greatest(1000, t - f) * (c - units) / total), CASE WHEN k = n - 1 THEN t ELSE f + floor(greatest(1000, t - f) * c / total) END)::BIGINT, 'estimated', false FROM made""",
    "sanitize_title_clips": f"""WITH RECURSIVE {TURNS_SQL}, turns AS (SELECT c.*, coalesce(s.text, '') AS text, row_number() OVER (PARTITION BY item_id ORDER BY utt) AS idx FROM conv_turns c JOIN conversations s ON s.conv_id = c.item_id AND s.turn = c.utt),
      handed AS (SELECT item_id, idx, {_pick(_CLIP)}, clip_id AS id FROM turns WHERE item_id % 4 <> 0 UNION ALL SELECT item_id, 1, 't001', 0, least(greatest(duration_us, 200000), 3000000), 'Title ' || item_id, item_id % 8 = 0, false, 't001' FROM conv_media WHERE item_id % 4 = 0), {_ids_sql("t")},
      had AS (SELECT n.item_id, n.idx, i.id AS clip_id, duration_us AS d, 'Title ' || n.item_id AS title, coalesce(n.start_us, o.start_us, 0) AS s, coalesce(n.end_us, o.end_us) AS e, coalesce(n.text, o.text) AS text, coalesce(n.enabled, o.enabled, false) AS enabled, coalesce(n.use_for_cover, o.use_for_cover, false) AS cover
        FROM handed n JOIN ids i USING (item_id, idx) JOIN conv_media USING (item_id) LEFT JOIN (SELECT item_id, 't1' AS id, {_pick({c: v for c, v in _OLD_CLIP.items() if c != "clip_id"})} FROM conv_media) o ON o.item_id = n.item_id AND o.id = i.id),
      a AS (SELECT * REPLACE (greatest(0, least(d, s)) AS s), coalesce(bool_or(cover) OVER (PARTITION BY item_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cleared, bool_or(cover) OVER (PARTITION BY item_id) AS any_cover FROM had),
      b AS (SELECT * REPLACE (greatest(0, least(d, coalesce(e, least(d, s + 3000000)))) AS e) FROM a), c AS (SELECT * REPLACE (CASE WHEN e <= s THEN least(d, s + 200000) ELSE e END AS e) FROM b)
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY s, e, clip_id) AS clip_no, clip_id, s::BIGINT AS start_us, e::BIGINT AS end_us, CASE WHEN cover THEN '' ELSE left(coalesce(text, CASE WHEN cleared THEN '' ELSE title END), 800) END AS text, enabled AND NOT cover AS enabled, CASE WHEN any_cover THEN '' ELSE title END AS title_text FROM c""",
}
