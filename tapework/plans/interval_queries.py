"""Interval algebra and edited timelines over the conversation timeline and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import decisions, intervals, timeline
from ..operators.tokens import pause_after
from .conv import DELETES_SQL, TURNS_SQL, conv_deletes, conv_media, conv_silences, conv_tokens, conv_turns, silences_sql, table

#: The standard preset: pauses from 500 ms, 120 ms of padding.
MIN_SILENCE_US = 500_000
PADDING_US = 120_000


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pad_intervals(conv_silences(spark, sf_dir, MIN_SILENCE_US), conv_media(spark, sf_dir), PADDING_US)


def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir)


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an interval of its user that lasts value seconds, in microseconds since 2024."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), start.alias("start_us"), (start + F.round(F.coalesce("value", F.lit(0.0)) * 60_000_000).cast("long")).alias("end_us"))


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_event_spans(spark, sf_dir), None, 40_000, 40_000)


def merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(conv_silences(spark, sf_dir, 100_000), conv_media(spark, sf_dir), 0, 0)


def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = conv_media(spark, sf_dir)
    return intervals.complement_intervals(intervals.merge_intervals(_padded(spark, sf_dir), media), media)


def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.subtract_intervals(_padded(spark, sf_dir), _speech(conv_tokens(spark, sf_dir)))


def _speech(tokens: DataFrame) -> DataFrame:
    """Tokens widened by 15 ms on both sides: what silences mustn't cut."""
    return tokens.where("end_us > start_us").select("item_id", F.greatest(F.lit(0), F.col("start_us") - 15_000).cast("long").alias("start_us"), (F.col("end_us") + 15_000).alias("end_us"))


def cut_plan(tokens: DataFrame, silences: DataFrame, decided: DataFrame, media: DataFrame, padding_us: int = PADDING_US) -> tuple[DataFrame, DataFrame]:
    """What is removed and what is kept of each item: padded silences without speech, and applied deletions, merged."""
    gone = decisions.removed_tokens(decided)
    speech = _speech(tokens.join(gone, ["item_id", "pos"], "left_anti"))
    quiet = intervals.subtract_intervals(intervals.pad_intervals(silences, media, padding_us), speech)
    cuts = quiet.unionByName(decided.where("applied").select("item_id", "start_us", "end_us"))
    # What is kept comes from what is removed, and most readers want both.
    removed = stored(intervals.merge_intervals(cuts, media))
    return removed, intervals.complement_intervals(removed, media)


def _conv_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # Turns, tokens and decisions are read in many places of the plan, so each is made once.
    turns = stored(conv_turns(spark, sf_dir))
    tokens, media = stored(conv_tokens(spark, sf_dir, turns)), conv_media(spark, sf_dir, turns)
    decided = stored(decisions.accept_deletes(conv_deletes(tokens), tokens, "aggressive", protect_latin=False))
    removed, keeps = cut_plan(tokens, conv_silences(spark, sf_dir, MIN_SILENCE_US, turns), decided, media)
    return media, removed, keeps


def build_cut_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, removed, keeps = _conv_plan(spark, sf_dir)
    return removed.withColumn("kind", F.lit("removed")).unionByName(keeps.withColumn("kind", F.lit("kept")))


def _silence_keeps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    media = conv_media(spark, sf_dir)
    removed = intervals.merge_intervals(_padded(spark, sf_dir), media)
    return removed, intervals.complement_intervals(removed, media)


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = conv_tokens(spark, sf_dir).select("item_id", "pos", F.col("start_us").alias("at_us"))
    return intervals.map_points(points, _silence_keeps(spark, sf_dir)[1], "snap")


def drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = conv_tokens(spark, sf_dir).select("item_id", "pos", F.col("start_us").alias("at_us"))
    return intervals.map_points(points, _silence_keeps(spark, sf_dir)[0], "drop")


def tokens_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = conv_tokens(spark, sf_dir).select("item_id", "pos", "start_us", "end_us")
    return intervals.map_tokens(tokens, _silence_keeps(spark, sf_dir)[1])


def segments_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conv_turns(spark, sf_dir).select("item_id", "utt", "start_us", "end_us")
    return intervals.map_segments(turns, _silence_keeps(spark, sf_dir)[1])


def conv_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences of an edit: every 5th removed, every 4th a gap, pairs swapped in order, every 7th switched off."""
    turns = conv_turns(spark, sf_dir)
    n = F.col("item_id") * 3 + F.col("utt")
    swapped = F.when(F.col("utt") % 2 == 0, F.col("utt") + 1).otherwise(F.col("utt") - 1)
    return turns.select(
        "item_id", F.format_string("s%03d", "utt").alias("sentence_id"), "start_us", "end_us", F.col("start_us").alias("clip_start_us"), (F.col("end_us") + F.col("pause_us")).alias("clip_end_us"),
        F.when(F.col("item_id") % 2 == 0, swapped).otherwise(F.col("utt")).cast("long").alias("timeline_order"), "text", (n % 7 != 0).alias("enabled"), (n % 5 == 0).alias("remove_video"), (n % 4 == 0).alias("gap"), F.lit(False).alias("synthetic_gap"),
    )


SENTENCES_SQL = r"""
conv_sentences AS (
  SELECT t.item_id, printf('s%03d', t.utt) AS sentence_id, t.start_us, t.end_us, t.start_us AS clip_start_us, t.end_us + t.pause_us AS clip_end_us,
         (CASE WHEN t.item_id % 2 = 0 THEN CASE WHEN t.utt % 2 = 0 THEN t.utt + 1 ELSE t.utt - 1 END ELSE t.utt END)::BIGINT AS timeline_order,
         coalesce(c.text, '') AS text, (t.item_id * 3 + t.utt) % 7 <> 0 AS enabled, (t.item_id * 3 + t.utt) % 5 = 0 AS remove_video, (t.item_id * 3 + t.utt) % 4 = 0 AS gap
  FROM conv_turns t JOIN conversations c ON c.conv_id = t.item_id AND c.turn = t.utt
), shown AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timeline_order, start_us, sentence_id) AS clip_idx
  FROM (SELECT s.*, greatest(0, least(duration_us, clip_start_us)) AS from_us, greatest(0, least(duration_us, clip_end_us)) AS to_us, duration_us
        FROM conv_sentences s JOIN conv_media USING (item_id) WHERE NOT remove_video)
  WHERE to_us - from_us > 50000
), clips AS (
  SELECT item_id, clip_idx, sentence_id, start_us, end_us, from_us, to_us, text, enabled, gap FROM shown
  UNION ALL
  SELECT item_id, 1, NULL, NULL, NULL, 0, duration_us, NULL, true, false FROM conv_media WHERE item_id NOT IN (SELECT item_id FROM shown)
), plan AS (
  SELECT *, (sum(to_us - from_us) OVER w)::BIGINT AS timeline_end_us, (sum(to_us - from_us) OVER w - (to_us - from_us))::BIGINT AS timeline_start_us,
         (sum(to_us - from_us) OVER (PARTITION BY item_id))::BIGINT AS edited_us
  FROM clips WINDOW w AS (PARTITION BY item_id ORDER BY clip_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def _conv_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.plan_clips(conv_sentences(spark, sf_dir), conv_media(spark, sf_dir))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv_clips(spark, sf_dir).select("item_id", "clip_idx", "sentence_id", "from_us", "to_us", "gap")


def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.coalesce_clips(_conv_clips(spark, sf_dir))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.edit_plan(_conv_clips(spark, sf_dir))


def to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = conv_tokens(spark, sf_dir).select("item_id", "pos", F.col("end_us").alias("at_us"))
    return timeline.timeline_to_source(points, _conv_clips(spark, sf_dir))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sentence_cues(_conv_clips(spark, sf_dir), offset_us=30_000)


def cues_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.removal_cues(conv_sentences(spark, sf_dir), _silence_keeps(spark, sf_dir)[0], conv_media(spark, sf_dir))


def conv_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's first three seconds as a title clip; every third is off."""
    turns = conv_turns(spark, sf_dir)
    return turns.select("item_id", F.format_string("t%03d", "utt").alias("title_id"), "start_us", (F.col("start_us") + 3_000_000).alias("end_us"), "text", ((F.col("item_id") + F.col("utt")) % 3 != 0).alias("enabled"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.title_cues(conv_titles(spark, sf_dir), conv_media(spark, sf_dir))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fill_clip_gaps(conv_sentences(spark, sf_dir), conv_media(spark, sf_dir)).select("item_id", "sentence_id", "clip_start_us", "clip_end_us")


def _event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user in order of time as samples, 10 ms apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = F.row_number().over(order).cast("long") - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), idx.alias("sample_idx"), F.coalesce("value", F.lit(0.0)).alias("value")).withColumn("at_us", F.col("sample_idx") * 10_000)


def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.detect_silence(_event_levels(spark, sf_dir), F.lit(40.0), 20_000)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.downsample_levels(_event_levels(spark, sf_dir), bars=20)


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pause_after(conv_tokens(spark, sf_dir)).select("item_id", "pos", "pause_us")


def cut_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the original and the cut of each item, and how many ranges are kept and removed."""
    media, removed, keeps = _conv_plan(spark, sf_dir)
    # All three are counted as rows of one union, so that no side of a join is sent or sorted while the others are still made.
    length = F.col("end_us") - F.col("start_us")
    rows = keeps.select("item_id", F.lit("kept").alias("kind"), length.alias("us")).unionByName(removed.select("item_id", F.lit("removed").alias("kind"), length.alias("us"))).unionByName(media.select("item_id", F.lit("whole").alias("kind"), F.col("duration_us").alias("us")))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("us"))
    sums = rows.groupBy("item_id").agg(F.max(of("whole")).alias("duration_us"), F.sum(of("kept")).alias("cut_us"), F.count_if(F.col("kind") == "kept").alias("kept"), F.count_if(F.col("kind") == "removed").alias("removed")).where("kept > 0 AND duration_us IS NOT NULL")
    seconds = lambda us: F.round(us / 1_000_000, 3)
    return sums.select("item_id", seconds(F.col("duration_us")).alias("original_s"), seconds(F.col("cut_us")).alias("cut_s"), seconds(F.col("duration_us") - F.col("cut_us")).alias("removed_s"), "kept", "removed")


QUERIES = {
    "pad_intervals": pad, "merge_intervals": merge, "merge_touching": merge_touching, "complement_intervals": complement, "subtract_intervals": subtract,
    "map_points_snap": snap, "map_points_drop": drop, "map_tokens": tokens_mapped, "map_segments": segments_mapped, "timeline_to_source": to_source,
    "plan_clips": clips, "coalesce_clips": coalesced, "edit_plan": plan, "sentence_cues": cues, "removal_cues": cues_after_removal, "title_cues": titles,
    "fill_clip_gaps": filled, "detect_silence": silence, "downsample_levels": bars, "build_cut_plan": build_cut_plan, "pause_after": pauses, "cut_summary": cut_summary,
}

_PADDED = f"""
padded AS (
  SELECT item_id, greatest(0, s.start_us + {PADDING_US})::BIGINT AS start_us, least(duration_us, s.end_us - {PADDING_US})::BIGINT AS end_us
  FROM conv_silences s JOIN conv_media USING (item_id)
  WHERE least(duration_us, s.end_us - {PADDING_US}) - greatest(0, s.start_us + {PADDING_US}) > 50000
)"""


def merged_sql(name: str, source: str, tol: int, least: int) -> str:
    """CTE name: intervals of source, merged."""
    return f"""
{name}_marked AS (
  SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY item_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {tol} THEN 0 ELSE 1 END AS fresh
        FROM {source} WHERE end_us > start_us)
), {name} AS (
  SELECT item_id, start_us, end_us FROM (SELECT item_id, island, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_marked GROUP BY item_id, island)
  WHERE end_us - start_us >= {least}
)"""


def complement_sql(name: str, removed: str, gap: int = 40_000) -> str:
    """CTE name: the gaps of removed."""
    return f"""
{name}_gaps AS (
  SELECT item_id, greatest(0, coalesce(max(end_us) OVER (PARTITION BY item_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start_us, start_us AS end_us FROM {removed}
  UNION ALL
  SELECT item_id, coalesce((SELECT max(end_us) FROM {removed} r WHERE r.item_id = m.item_id), 0), duration_us FROM conv_media m
), {name}_some AS (SELECT * FROM {name}_gaps WHERE end_us - start_us > {gap}
), {name} AS (
  SELECT item_id, start_us::BIGINT AS start_us, end_us::BIGINT AS end_us FROM {name}_some
  UNION ALL
  SELECT item_id, 0, duration_us FROM conv_media WHERE item_id NOT IN (SELECT item_id FROM {name}_some)
)"""


#: Pieces of a between speech, found from the other side: by the borders of both, each stretch tested against the intervals.
def subtract_sql(name: str, a: str, b: str, least: int = 40_000) -> str:
    return f"""
{name}_cuts AS (
  SELECT a.item_id, a.start_us AS a_start, a.end_us AS a_end, greatest(b.start_us, a.start_us) AS s, least(b.end_us, a.end_us) AS e
  FROM {a} a JOIN {b} b ON a.item_id = b.item_id AND b.start_us < a.end_us AND b.end_us > a.start_us
), {name}_edges AS (
  SELECT item_id, start_us AS a_start, end_us AS a_end, start_us AS s, start_us AS e FROM {a}
  UNION ALL SELECT * FROM {name}_cuts
  UNION ALL SELECT item_id, start_us, end_us, end_us, end_us FROM {a}
), {name} AS (
  SELECT item_id, reach AS start_us, s AS end_us
  FROM (SELECT *, max(e) OVER (PARTITION BY item_id, a_start, a_end ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_edges)
  WHERE reach IS NOT NULL AND s - reach >= {least}
)"""


_SPEECH = """
speech AS (SELECT item_id, greatest(0, start_us - 15000) AS start_us, end_us + 15000 AS end_us FROM conv_tokens WHERE end_us > start_us)"""
_EVENT_SPANS = """
spans AS (
  SELECT user_id AS item_id, epoch_us(ts) - 1704067200000000 AS start_us, epoch_us(ts) - 1704067200000000 + round(coalesce(value, 0) * 60000000)::BIGINT AS end_us FROM events
)"""
_BASE = f"WITH {TURNS_SQL}, {silences_sql(MIN_SILENCE_US)}, {_PADDED}"
_KEEPS = f"{_BASE}, {merged_sql('removed', 'padded', 40_000, 40_000)}, {complement_sql('keeps', 'removed')}, keep_steps AS (SELECT *, (coalesce(sum(end_us - start_us) OVER (PARTITION BY item_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM keeps)"
_LEVELS = "levels AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, coalesce(value, 0) AS value FROM events)"


def _snap_sql(point: str) -> str:
    """The place of a point of p on the cut timeline."""
    return f"(SELECT coalesce(max(CASE WHEN k.start_us <= p.{point} THEN k.before + least(p.{point}, k.end_us) - k.start_us END), 0) FROM keep_steps k WHERE k.item_id = p.item_id)"


#: Accepted deletions in the aggressive mode without the Latin rule, by recursion over an item's proposals.
EVIDENCE_SQL = f"""
{DELETES_SQL}, policies AS (
  SELECT * FROM (VALUES ('conservative', 'stutter', 0.9), ('conservative', 'false_start', 0.9), ('conservative', 'exact_repeat', 0.9),
    ('standard', 'stutter', 0.82), ('standard', 'false_start', 0.86), ('standard', 'exact_repeat', 0.88), ('standard', 'semantic_repeat', 0.94), ('standard', 'filler', 0.9),
    ('aggressive', 'stutter', 0.72), ('aggressive', 'false_start', 0.86), ('aggressive', 'exact_repeat', 0.88), ('aggressive', 'semantic_repeat', 0.72), ('aggressive', 'filler', 0.9), ('aggressive', 'redundant', 0.9)) AS t(mode, type, threshold)
), known AS (
  SELECT d.*, len(list_distinct(positions))::BIGINT AS n_tokens, list_min(positions) AS first_pos, list_max(positions) AS last_pos,
         coalesce(list_max(positions) - list_min(positions) + 1 = len(list_distinct(positions)), false) AS contiguous
  FROM conv_deletes d
), texts AS (
  SELECT k.item_id, k.seq, coalesce(trim(string_agg(t.text, '' ORDER BY t.pos) FILTER (WHERE t.pos <= k.last_pos), ' '), '') AS deleted,
         coalesce(trim(string_agg(t.text, '' ORDER BY t.pos) FILTER (WHERE t.pos > k.last_pos), ' '), '') AS right_text
  FROM known k JOIN conv_tokens t ON t.item_id = k.item_id AND t.pos BETWEEN k.first_pos AND k.last_pos + greatest(6, k.n_tokens + 2)
  WHERE k.contiguous AND k.n_tokens > 0 GROUP BY k.item_id, k.seq
), read AS (
  SELECT k.*, coalesce(x.deleted, '') AS deleted, coalesce(x.right_text, '') AS right_text,
         coalesce(len(list_filter(range(1, least(length(x.deleted), length(x.right_text)) + 1), lambda n: left(x.deleted, n) = left(x.right_text, n))), 0) AS shared
  FROM known k LEFT JOIN texts x ON k.item_id = x.item_id AND k.seq = x.seq
)"""


def told_sql(mode: str) -> str:
    """CTE told: read with evidence_reason and evidence."""
    redundant = "aggressive_redundancy" if mode == "aggressive" else "redundancy_requires_aggressive"
    semantic = ", 'high_confidence_semantic_repeat'" if mode != "conservative" else ""
    return f"""
told AS (
  SELECT *, evidence_reason IN ('adjacent_stutter_match', 'adjacent_exact_repeat', 'adjacent_restart_match', 'known_filler', 'aggressive_redundancy'{semantic}) AS evidence
  FROM (SELECT *, CASE WHEN deleted = '' OR (right_text = '' AND type NOT IN ('filler', 'redundant')) THEN 'missing_adjacent_evidence'
      WHEN type = 'stutter' THEN CASE WHEN starts_with(right_text, deleted) OR starts_with(right_text, right(deleted, 1)) THEN 'adjacent_stutter_match' ELSE 'stutter_not_repeated' END
      WHEN type = 'exact_repeat' THEN CASE WHEN starts_with(right_text, deleted) THEN 'adjacent_exact_repeat' ELSE 'exact_repeat_not_found' END
      WHEN type = 'false_start' THEN CASE WHEN shared >= least(2, length(deleted)) THEN 'adjacent_restart_match' ELSE 'restart_prefix_not_found' END
      WHEN type = 'filler' THEN CASE WHEN deleted IN ('嗯', '啊', '呃', '额', '那个', '这个', '就是') THEN 'known_filler' ELSE 'unknown_filler' END
      WHEN type = 'semantic_repeat' THEN 'high_confidence_semantic_repeat' ELSE '{redundant}' END AS evidence_reason FROM read)
)"""


def accepted_sql(mode: str) -> str:
    """CTE decided: item_id, seq, applied, skip_reason, validation, start_us, end_us."""
    return f"""
{EVIDENCE_SQL}, {told_sql(mode)}, ops AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.item_id ORDER BY seq) AS k,
         CASE WHEN p.threshold IS NULL OR confidence < p.threshold OR len(positions) = 0 THEN 'policy_or_confidence' WHEN NOT contiguous THEN 'non_contiguous_tokens'
              WHEN EXISTS (SELECT 1 FROM conv_tokens c WHERE c.item_id = t.item_id AND c.pos BETWEEN first_pos AND last_pos AND regexp_matches(c.text, '[0-9]')) THEN 'protected_content' END AS early,
         greatest(1, (SELECT count(*) FROM conv_tokens c WHERE c.item_id = t.item_id) * 2 // 5) AS budget
  FROM told t LEFT JOIN policies p ON p.mode = '{mode}' AND p.type = t.type
), folded AS (
  SELECT item_id, 0::BIGINT AS k, 0::BIGINT AS used, []::STRUCT(a BIGINT, b BIGINT)[] AS taken, NULL::VARCHAR AS why FROM (SELECT DISTINCT item_id FROM ops)
  UNION ALL
  SELECT item_id, k, CASE WHEN why IS NULL THEN used + n_tokens ELSE used END, CASE WHEN why IS NULL THEN list_append(taken, {{'a': first_pos, 'b': last_pos}}) ELSE taken END, why
  FROM (SELECT f.item_id, o.k, f.used, f.taken, o.n_tokens, o.first_pos, o.last_pos,
               CASE WHEN o.early IS NOT NULL THEN o.early WHEN len(list_filter(f.taken, lambda x: x.a <= o.last_pos AND o.first_pos <= x.b)) > 0 THEN 'overlapping_delete'
                    WHEN NOT o.evidence THEN o.evidence_reason WHEN f.used + o.n_tokens > o.budget THEN 'deletion_budget_exceeded' END AS why
        FROM folded f JOIN ops o ON o.item_id = f.item_id AND o.k = f.k + 1)
), decided AS (
  SELECT o.item_id, o.seq, o.type, o.confidence, o.positions, o.n_tokens, o.first_pos, o.last_pos, f.why IS NULL AS applied, f.why AS skip_reason,
         CASE WHEN f.why IS NULL THEN o.evidence_reason END AS validation,
         (CASE WHEN f.why IS NULL THEN greatest(0, a.start_us - 25000) END)::BIGINT AS start_us,
         (CASE WHEN f.why IS NULL THEN greatest(greatest(0, a.start_us - 25000) + 40000, b.end_us + 25000) END)::BIGINT AS end_us
  FROM ops o JOIN folded f ON f.item_id = o.item_id AND f.k = o.k
  LEFT JOIN conv_tokens a ON a.item_id = o.item_id AND a.pos = o.first_pos LEFT JOIN conv_tokens b ON b.item_id = o.item_id AND b.pos = o.last_pos
)"""


_PLAN = f"""WITH RECURSIVE {TURNS_SQL}, {silences_sql(MIN_SILENCE_US)}, {_PADDED}, {accepted_sql('aggressive')}, gone AS (
  SELECT item_id, unnest(positions) AS pos FROM decided WHERE applied
), speech AS (
  SELECT item_id, greatest(0, start_us - 15000) AS start_us, end_us + 15000 AS end_us FROM conv_tokens t
  WHERE end_us > start_us AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.item_id = t.item_id AND g.pos = t.pos)
), {subtract_sql('quiet', 'padded', 'speech')}, cuts AS (
  SELECT item_id, greatest(0, start_us) AS start_us, least(duration_us, end_us) AS end_us
  FROM (SELECT * FROM quiet UNION ALL SELECT item_id, start_us, end_us FROM decided WHERE applied) JOIN conv_media USING (item_id)
), {merged_sql('removed', 'cuts', 40_000, 40_000)}, {complement_sql('keeps', 'removed')}"""

ORACLE_SQL = {
    "pad_intervals": f"{_BASE} SELECT * FROM padded",
    "merge_intervals": f"WITH {_EVENT_SPANS}, {merged_sql('merged', 'spans', 40_000, 40_000)} SELECT * FROM merged",
    "merge_touching": f"WITH {TURNS_SQL}, {silences_sql(100_000)}, clipped AS (SELECT item_id, greatest(0, start_us) AS start_us, least(duration_us, end_us) AS end_us FROM conv_silences JOIN conv_media USING (item_id)), {merged_sql('merged', 'clipped', 0, 0)} SELECT * FROM merged",
    "complement_intervals": f"{_KEEPS} SELECT * FROM keeps",
    "subtract_intervals": f"{_BASE}, {_SPEECH}, {subtract_sql('quiet', 'padded', 'speech')} SELECT item_id, start_us::BIGINT AS start_us, end_us::BIGINT AS end_us FROM quiet",
    "map_points_snap": f"{_KEEPS} SELECT item_id, pos, at_us, {_snap_sql('at_us')} AS mapped_us FROM (SELECT item_id, pos, start_us AS at_us FROM conv_tokens) p",
    "map_points_drop": f"{_KEEPS} SELECT item_id, pos, at_us, CASE WHEN NOT EXISTS (SELECT 1 FROM removed r WHERE r.item_id = p.item_id AND r.start_us <= p.at_us AND p.at_us < r.end_us) THEN (at_us - coalesce((SELECT sum(r.end_us - r.start_us) FROM removed r WHERE r.item_id = p.item_id AND r.end_us <= p.at_us), 0))::BIGINT END AS mapped_us FROM (SELECT item_id, pos, start_us AS at_us FROM conv_tokens) p",
    "map_tokens": f"{_KEEPS}, met AS (SELECT t.item_id, t.pos, t.start_us AS source_start_us, t.end_us AS source_end_us, min(k.before + greatest(t.start_us, k.start_us) - k.start_us) AS f, max(k.before + least(t.end_us, k.end_us) - k.start_us) AS e FROM conv_tokens t JOIN keep_steps k ON t.item_id = k.item_id AND least(t.end_us, k.end_us) > greatest(t.start_us, k.start_us) GROUP BY ALL) SELECT item_id, pos, f AS start_us, CASE WHEN e <= f THEN f + greatest(40000, least(300000, source_end_us - source_start_us)) ELSE e END AS end_us, source_start_us, source_end_us FROM met",
    "map_segments": f"{_KEEPS}, p AS (SELECT item_id, utt, start_us, end_us FROM conv_turns), q AS (SELECT *, {_snap_sql('start_us')} AS f, {_snap_sql('end_us')} AS e FROM p) SELECT item_id, utt, f AS start_us, CASE WHEN e <= f THEN f + least(600000, greatest(200000, end_us - start_us)) ELSE e END AS end_us FROM q",
    "timeline_to_source": f"WITH {TURNS_SQL}, {SENTENCES_SQL}, ranked AS (SELECT p.item_id, p.pos, p.end_us AS at_us, k.*, row_number() OVER (PARTITION BY p.item_id, p.pos ORDER BY k.clip_idx) AS n FROM conv_tokens p JOIN plan k ON k.item_id = p.item_id AND p.end_us BETWEEN k.timeline_start_us AND k.timeline_end_us), lasts AS (SELECT item_id, max_by(to_us, clip_idx) AS last_us FROM plan GROUP BY item_id) SELECT p.item_id, p.pos, p.end_us AS at_us, (coalesce(CASE WHEN r.gap THEN r.from_us ELSE greatest(r.from_us, least(r.to_us, r.from_us + p.end_us - r.timeline_start_us)) END, l.last_us))::BIGINT AS source_us FROM conv_tokens p JOIN lasts l USING (item_id) LEFT JOIN ranked r ON r.item_id = p.item_id AND r.pos = p.pos AND r.n = 1",
    "plan_clips": f"WITH {TURNS_SQL}, {SENTENCES_SQL} SELECT item_id, clip_idx, sentence_id, from_us, to_us, gap FROM clips",
    "coalesce_clips": f"WITH RECURSIVE {TURNS_SQL}, {SENTENCES_SQL}, folded AS (SELECT item_id, clip_idx, 1::BIGINT AS run_idx, from_us, to_us, gap, to_us AS reach FROM clips WHERE clip_idx = 1 UNION ALL SELECT c.item_id, c.clip_idx, CASE WHEN joins THEN run_idx ELSE run_idx + 1 END, c.from_us, c.to_us, c.gap, CASE WHEN joins THEN greatest(c.to_us, reach) ELSE c.to_us END FROM (SELECT f.run_idx, f.reach, c.*, NOT c.gap AND NOT f.gap AND abs(f.reach - c.from_us) <= 40000 AS joins FROM folded f JOIN clips c ON c.item_id = f.item_id AND c.clip_idx = f.clip_idx + 1) c) SELECT item_id, run_idx, arg_min(from_us, clip_idx) AS from_us, max(to_us) AS to_us, bool_or(gap) AS gap, count(*) AS n_clips FROM folded GROUP BY item_id, run_idx",
    "edit_plan": f"WITH {TURNS_SQL}, {SENTENCES_SQL} SELECT item_id, clip_idx, sentence_id, CASE WHEN gap THEN 'gap' ELSE 'source' END AS type, from_us AS source_start_us, to_us AS source_end_us, timeline_start_us, timeline_end_us, enabled, edited_us FROM plan",
    "sentence_cues": f"WITH {TURNS_SQL}, {SENTENCES_SQL}, placed AS (SELECT *, greatest(0, timeline_start_us + greatest(from_us, least(to_us, start_us)) - from_us + 30000) AS f, least(edited_us, timeline_start_us + least(to_us - from_us, greatest(from_us, least(to_us, end_us)) - from_us) + 30000) AS e FROM plan WHERE enabled AND trim(coalesce(text, '')) <> '') SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY clip_idx) AS idx, f::BIGINT AS start_us, e::BIGINT AS end_us, text FROM placed WHERE e > f",
    "removal_cues": f"{_KEEPS}, {SENTENCES_SQL}, mapped AS (SELECT s.*, s.start_us - coalesce((SELECT sum(r.end_us - r.start_us) FROM removed r WHERE r.item_id = s.item_id AND r.end_us <= s.start_us), 0) AS f, s.end_us - coalesce((SELECT sum(r.end_us - r.start_us) FROM removed r WHERE r.item_id = s.item_id AND r.end_us <= s.end_us), 0) AS e, (SELECT duration_us FROM conv_media m WHERE m.item_id = s.item_id) - coalesce((SELECT sum(r.end_us - r.start_us) FROM removed r WHERE r.item_id = s.item_id), 0) AS room FROM conv_sentences s WHERE enabled AND NOT remove_video AND end_us > start_us AND NOT EXISTS (SELECT 1 FROM removed r WHERE r.item_id = s.item_id AND ((r.start_us <= s.start_us AND s.start_us < r.end_us) OR (r.start_us <= s.end_us AND s.end_us < r.end_us)))) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY timeline_order, start_us, sentence_id) AS idx, greatest(0, f)::BIGINT AS start_us, least(room, e)::BIGINT AS end_us, text FROM mapped WHERE least(room, e) > greatest(0, f)",
    "title_cues": f"WITH {TURNS_SQL}, placed AS (SELECT t.item_id, t.utt, greatest(0, least(duration_us, start_us)) AS f, greatest(0, least(duration_us, start_us + 3000000)) AS e, start_us, coalesce(c.text, '') AS text FROM conv_turns t JOIN conv_media USING (item_id) JOIN conversations c ON c.conv_id = t.item_id AND c.turn = t.utt WHERE (t.item_id + t.utt) % 3 <> 0) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY start_us, utt) AS idx, f AS start_us, e AS end_us, text FROM placed WHERE e > f",
    "fill_clip_gaps": f"WITH {TURNS_SQL}, {SENTENCES_SQL} SELECT item_id, sentence_id, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE clip_start_us END AS clip_start_us, greatest(clip_end_us, coalesce(lead(start_us) OVER w, duration_us)) AS clip_end_us FROM conv_sentences JOIN conv_media USING (item_id) WINDOW w AS (PARTITION BY item_id ORDER BY start_us, end_us, sentence_id)",
    "detect_silence": f"WITH {_LEVELS}, marked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sample_idx) - row_number() OVER (PARTITION BY item_id, value < 40 ORDER BY sample_idx) AS run, max(sample_idx) OVER (PARTITION BY item_id) AS last FROM levels), runs AS (SELECT item_id, min(sample_idx) * 10000 AS start_us, least(max(sample_idx) + 1, max(last)) * 10000 AS end_us FROM marked WHERE value < 40 GROUP BY item_id, run) SELECT * FROM runs WHERE end_us - start_us >= 20000",
    "downsample_levels": f"WITH {_LEVELS}, chunked AS (SELECT item_id, value, sample_idx // greatest(1, ceil(count(*) OVER (PARTITION BY item_id) / 20))::BIGINT AS bar FROM levels) SELECT item_id, bar, round(least(1.0, sqrt(avg(value * value)) / 32768 * 4), 4) AS level FROM chunked GROUP BY item_id, bar",
    "build_cut_plan": f"{_PLAN} SELECT item_id, start_us::BIGINT AS start_us, end_us::BIGINT AS end_us, 'removed' AS kind FROM removed UNION ALL SELECT item_id, start_us, end_us, 'kept' FROM keeps",
    "pause_after": f"WITH {TURNS_SQL} SELECT item_id, pos, greatest(0, coalesce(lead(start_us) OVER (PARTITION BY item_id ORDER BY pos) - end_us, 0))::BIGINT AS pause_us FROM conv_tokens",
    "cut_summary": f"{_PLAN}, k AS (SELECT item_id, sum(end_us - start_us) AS cut_us, count(*) AS kept FROM keeps GROUP BY item_id), r AS (SELECT item_id, count(*) AS removed FROM removed GROUP BY item_id) SELECT item_id, round(duration_us / 1000000, 3) AS original_s, round((cut_us / 1000000)::DOUBLE, 3) AS cut_s, round(((duration_us - cut_us) / 1000000)::DOUBLE, 3) AS removed_s, kept, coalesce(removed, 0) AS removed FROM conv_media JOIN k USING (item_id) LEFT JOIN r USING (item_id)",
}
