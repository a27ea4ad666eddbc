"""Chunks, lines and cues over the conversation timeline, documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scripts, segmentation
from .conv import TURNS_SQL, conv_media, conv_tokens, conv_turns, table

#: 1,000 pixels at 16 pixels for each half unit.
LAYOUT = segmentation.Layout(available=1000.0, half_width=16.0)


def _breaks(tokens: DataFrame) -> DataFrame:
    """Breaks by place: required after every 97th token, preferred after every 11th, forbidden after every 5th."""
    kind = F.array_compact(F.array(F.when(F.col("pos") % 97 == 96, F.lit("required")), F.when(F.col("pos") % 11 == 3, F.lit("preferred")), F.when((F.col("pos") % 5 == 2) & (F.col("pos") % 97 != 96), F.lit("forbidden"))))
    return tokens.select("item_id", "pos", F.explode(kind).alias("kind"))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = conv_tokens(spark, sf_dir)
    return tokens, _breaks(tokens)


def by_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.chunk_by_pause(conv_tokens(spark, sf_dir), 100)


def by_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.chunk_by_breaks(*_both(spark, sf_dir), 45)


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.overlapping_chunks(conv_tokens(spark, sf_dir)).select("item_id", "pos", "chunk")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.line_options(*_both(spark, sf_dir), LAYOUT)


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each start how many ends it has, and a hash of their costs."""
    found = segmentation.line_ends(*_both(spark, sf_dir), LAYOUT)
    said = F.transform("ends", lambda x: F.concat_ws(",", x["end_pos"], F.round(F.round(x["cost"], 6) * 1_000_000).cast("long")))
    return found.select("item_id", "start_pos", F.size("ends").cast("long").alias("n"), F.md5(F.array_join(said, ";")).alias("ends_md5"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segment_lines(*_both(spark, sf_dir), LAYOUT)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as styles."""
    styles = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 150).cast("double").alias("scale"), (20 + F.col("p_partkey") % 90).cast("double").alias("font_size"), (F.col("p_partkey") % 300).cast("double").alias("margin_x"), (F.col("p_partkey") % 200 - 100).cast("double").alias("position_x"), (F.col("p_partkey") % 5).cast("double").alias("letter_spacing"))
    return segmentation.layout_context(styles, 720, 1280).select("p_partkey", "font_px", F.round("available", 6).alias("available"), F.round("comfort", 6).alias("comfort"), F.round("hard", 6).alias("hard"), F.round("spacing", 6).alias("spacing"))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return segmentation.wrap_titles(parts, "p_name").select("p_partkey", "lines")


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as titles in lines of least cost, with no line after a part's second token."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    never = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":1")).alias("item_id"), F.lit(1).cast("long").alias("pos"), F.lit("forbidden").alias("kind"))
    wrapped = segmentation.wrap_title_text(docs, "doc_id", "text", segmentation.Layout(400.0, 10.0), never)
    return wrapped.select("doc_id", F.md5("lines").alias("lines_md5"), F.size(F.split("lines", "\n")).alias("n"))


def own_text_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conv_turns(spark, sf_dir).select("item_id", F.col("utt").alias("seq"), "start_us", "end_us", "text")
    return segmentation.cues_from_timing_text(turns, conv_media(spark, sf_dir), 100_000)


def _even_lines(tokens: DataFrame) -> DataFrame:
    """Lines of seven tokens; every 50th line is missing."""
    by = tokens.groupBy("item_id", F.floor(F.col("pos") / 7).alias("line")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "").alias("text"))
    return by.where((F.col("item_id") + F.col("line")) % 50 != 49)


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, breaks = _both(spark, sf_dir)
    return segmentation.validate_layout(_even_lines(tokens).select("item_id", "line", "first_pos", "last_pos"), tokens, breaks, LAYOUT)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, breaks = _both(spark, sf_dir)
    named = breaks.select("item_id", "pos", F.when(F.col("kind") == "required", "ai_final").when(F.col("kind") == "preferred", "ai_sentence").otherwise("ai_break").alias("source"))
    return segmentation.annotate_break_source(_even_lines(tokens), named).select("item_id", "line", "break_source")


def line_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = conv_tokens(spark, sf_dir)
    return segmentation.cues_from_lines(_even_lines(tokens), conv_media(spark, sf_dir), 120_000)


def script_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), ((F.col("doc_id") % 90 + 1) * 1_000_000).alias("duration_us"))
    return segmentation.cues_from_script(docs, 300_000).select("item_id", "idx", "start_us", "end_us", F.md5("text").alias("text_md5"))


def timed_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's whole text on the times of its turns: of even items by sentences, of odd ones two turns as one phrase."""
    turns = conv_turns(spark, sf_dir)
    sentences = turns.where("item_id % 2 = 0").select("item_id", F.col("utt").alias("_a"), F.posexplode(scripts.split_sentences(F.col("text"))).alias("_b", "phrase"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt", "text"))), lambda x: x["text"]), " ")
    pairs = turns.where("item_id % 2 = 1").groupBy("item_id", F.floor(F.col("utt") / 2).alias("_a")).agg(listed.alias("phrase")).select("item_id", "_a", F.lit(0).alias("_b"), "phrase")
    order = F.row_number().over(Window.partitionBy("item_id").orderBy("_a", "_b")).cast("long")
    phrases = sentences.unionByName(pairs).withColumn("phrase_idx", order).select("item_id", "phrase_idx", "phrase")
    return segmentation.cues_script_on_timings(phrases, turns.select("item_id", F.col("utt").alias("seq"), "start_us", "end_us"), conv_media(spark, sf_dir))


def reflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences, every fifth of them edited."""
    tokens, breaks = _both(spark, sf_dir)
    turns = tokens.groupBy("item_id", "utt").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("start_us").alias("clip_start_us"), F.max("end_us").alias("clip_end_us"))
    no = F.lit(False)
    sentences = turns.select("item_id", F.format_string("s%03d", "utt").alias("sentence_id"), F.col("utt").alias("timeline_order"), "first_pos", "last_pos", (F.col("utt") % 5 == 1).alias("edited"), no.alias("pending"), no.alias("remove_video"), no.alias("gap"), "clip_start_us", "clip_end_us")
    return segmentation.reflow(sentences, tokens, breaks, LAYOUT).select("item_id", "timeline_order", "sentence_id", "first_pos", "last_pos", "clip_start_us", "clip_end_us")


QUERIES = {
    "chunk_by_pause": by_pause, "chunk_by_breaks": by_breaks, "overlapping_chunks": overlapping, "line_options": options, "line_cost": costs, "segment_lines": lines,
    "layout_context": contexts, "wrap_titles": wrapped, "validate_layout": validated, "annotate_break_source": sources, "cues_from_lines": line_cues, "cues_from_script": script_cues,
    "cues_script_on_timings": timed_cues, "reflow": reflowed, "wrap_title_text": wrapped_lines, "cues_from_timing_text": own_text_cues,
}

_KNOWN = f"""{TURNS_SQL}, known AS (
  SELECT item_id, pos, text, start_us, end_us, CASE WHEN trim(text) = '' THEN 0 ELSE (end_us - start_us) // 100000 END AS units, length(text) AS chars,
    greatest(0, coalesce(lead(start_us) OVER w - end_us, 0)) AS pause_us, lead(pos) OVER w IS NULL AS last, regexp_matches(text, '[。！？!?；;，,：:]$') AS signed,
    regexp_matches(text, '^[A-Za-z0-9]$') AND coalesce(regexp_matches(lead(text) OVER w, '^[A-Za-z0-9]'), false) AS latin,
    pos % 97 = 96 AS required, pos % 11 = 3 AS preferred, pos % 5 = 2 AND pos % 97 <> 96 AS forbidden
  FROM conv_tokens WINDOW w AS (PARTITION BY item_id ORDER BY pos)
)"""


def _chunks_sql(limit: int, cut: str, prefer: str) -> str:
    half = max(1, limit // 2)
    late = f"k.item_id = c.item_id AND k.pos >= c.first_pos + {half} AND k.pos < c.first_pos + {limit}"
    return f"""WITH RECURSIVE {_KNOWN}, sizes AS (SELECT item_id, max(pos) AS top FROM known GROUP BY item_id),
      marks AS MATERIALIZED (SELECT item_id, list(pos ORDER BY pos) FILTER (WHERE {cut}) AS cuts, list(pos ORDER BY pos) FILTER (WHERE {prefer}) AS prefers FROM known k GROUP BY item_id),
      c AS (SELECT item_id, 0::BIGINT AS chunk, -1::BIGINT AS last_pos, 0::BIGINT AS first_pos FROM sizes
        UNION ALL SELECT item_id, chunk + 1, e, nx FROM (SELECT c.item_id, c.chunk, c.last_pos + 1 AS nx,
          CASE WHEN c.last_pos + {limit} >= s.top THEN s.top ELSE coalesce(list_max(list_filter(m.cuts, lambda p: p >= c.last_pos + 1 + {half} AND p < c.last_pos + 1 + {limit})), list_max(list_filter(m.prefers, lambda p: p >= c.last_pos + 1 + {half} AND p < c.last_pos + 1 + {limit})), c.last_pos + {limit}) END AS e
          FROM c JOIN sizes s USING (item_id) JOIN marks m USING (item_id) WHERE c.last_pos < s.top))
      SELECT item_id, chunk, first_pos, last_pos FROM c WHERE chunk > 0"""


_OPTIONS = f"""{_KNOWN}, summed AS (
  SELECT *, coalesce(sum(units) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM known
), reach AS (
  SELECT item_id, pos, before, max(pos) OVER (PARTITION BY item_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 59 FOLLOWING) AS far_pos,
    min(pos) FILTER (WHERE required) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS must FROM summed
), ends AS (
  SELECT item_id, pos AS start_pos, before AS start_before, unnest(range(pos, least(far_pos, coalesce(must, far_pos)) + 1)) AS end_pos FROM reach
), pairs AS (
  SELECT ends.item_id, start_pos, end_pos, required, forbidden, last, preferred, pause_us, (before + units - start_before) * 16.0::DOUBLE AS width
  FROM ends JOIN summed ON summed.item_id = ends.item_id AND pos = end_pos
), allowed AS (
  SELECT *, preferred OR required OR (NOT last AND pause_us >= 180000) AS is_natural,
    row_number() OVER (PARTITION BY item_id, start_pos ORDER BY abs(width - 800), end_pos) AS near, max(end_pos) OVER (PARTITION BY item_id, start_pos) AS far
  FROM pairs WHERE width <= 950.5 AND (NOT forbidden OR last)
), kept AS (SELECT item_id, start_pos, end_pos, width, is_natural FROM allowed WHERE near <= 4 OR end_pos = far OR is_natural
), options AS (
  SELECT * FROM kept UNION ALL SELECT item_id, pos, pos, units * 16.0::DOUBLE, false FROM known k WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.item_id = k.item_id AND kept.start_pos = k.pos)
)"""
_EVEN = "even AS (SELECT item_id, pos // 7 AS line, min(pos) AS first_pos, max(pos) AS last_pos, min(start_us) AS start_us, max(end_us) AS end_us, string_agg(text, '' ORDER BY pos) AS text, sum(units) AS u, count(*) AS n, bool_or(required AND pos % 7 <> 6 AND NOT last) AS through, bool_or(forbidden AND (pos % 7 = 6) AND NOT last) AS ends_on FROM known GROUP BY item_id, pos // 7)"

ORACLE_SQL = {
    "chunk_by_pause": _chunks_sql(100, "pause_us >= 250000", "false"),
    "chunk_by_breaks": _chunks_sql(45, "required", "preferred OR pause_us >= 250000"),
    "overlapping_chunks": f"WITH {TURNS_SQL} SELECT item_id, pos, unnest(range(greatest(0, floor((start_us - 90000000) / 80000000)::BIGINT + 1), start_us // 80000000 + 1)) AS chunk FROM conv_tokens",
    "line_options": f"""WITH {_OPTIONS} SELECT item_id, start_pos, end_pos, width, is_natural AS "natural", round(width / 800, 3) AS fill, printf('o%03d-%03d', start_pos, end_pos + 1) AS option_id FROM options""",
    "line_cost": f"""WITH {_OPTIONS} SELECT item_id, start_pos, count(*) AS n, md5(string_agg(concat_ws(',', end_pos, round(cost * 1000000)::BIGINT), ';' ORDER BY end_pos)) AS ends_md5 FROM (SELECT o.item_id, start_pos, end_pos, round(8 * pow(width / 800 - 0.82, 2) + CASE WHEN end_pos - start_pos < 2 AND NOT k.last THEN 5 ELSE 0 END + CASE WHEN width > 950 THEN 1000 ELSE 0 END + CASE WHEN k.last THEN 0 ELSE
        CASE WHEN k.pause_us >= 250000 THEN -least(5.0, k.pause_us / 1000000 * 8) WHEN k.pause_us < 180000 THEN 1.2 ELSE 0 END - CASE WHEN k.signed THEN 3 ELSE 0 END - CASE WHEN k.preferred THEN 4 ELSE 0 END + CASE WHEN k.latin THEN 1000 ELSE 0 END END, 6)::DOUBLE AS cost FROM options o JOIN known k ON k.item_id = o.item_id AND k.pos = o.end_pos) GROUP BY item_id, start_pos""",
    "layout_context": """WITH s AS (SELECT p_partkey, greatest(0.2, p_partkey % 150 / 100) AS scale, 20 + p_partkey % 90 AS font_size, greatest(0.0, p_partkey % 300 * 720 / 1080) AS margin, 360 + (p_partkey % 200 - 100) * 720 / 1080 AS center, p_partkey % 5 * 720 / 1080 AS spacing FROM part),
      a AS (SELECT p_partkey, greatest(10.0, round(font_size * 1280 / 1920 * scale))::DOUBLE AS font_px, greatest(80.0, 2 * least(greatest(0.0, center - margin), greatest(0.0, 720 - margin - center)))::DOUBLE AS available, spacing FROM s)
      SELECT p_partkey, font_px, round(available, 6) AS available, round(available * 0.80::DOUBLE, 6) AS comfort, round(available * 0.95::DOUBLE, 6) AS hard, round(spacing::DOUBLE, 6) AS spacing FROM a""",
    "validate_layout": f"WITH {_KNOWN}, {_EVEN}, e AS (SELECT item_id, bool_or((item_id + line) % 50 = 49) AS cover, bool_or(through AND (item_id + line) % 50 <> 49) AS required, bool_or(ends_on AND (item_id + line) % 50 <> 49) AS forbidden, bool_or(u * 16 > 950.5 AND n > 1 AND (item_id + line) % 50 <> 49) AS wide FROM even GROUP BY item_id) SELECT item_id, concat_ws(',', CASE WHEN cover THEN 'cover' END, CASE WHEN required THEN 'required' END, CASE WHEN forbidden THEN 'forbidden' END, CASE WHEN wide THEN 'wide' END) AS errors FROM e WHERE cover OR required OR forbidden OR wide",
    "annotate_break_source": f"WITH {_KNOWN}, {_EVEN} SELECT e.item_id, line, CASE WHEN required THEN 'ai_final' WHEN preferred THEN 'ai_sentence' WHEN forbidden THEN 'ai_break' ELSE 'width' END AS break_source FROM even e JOIN known k ON k.item_id = e.item_id AND k.pos = e.last_pos WHERE (e.item_id + line) % 50 <> 49",
    "cues_from_lines": f"WITH {_KNOWN}, {_EVEN} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY start_us, end_us, text) AS idx, least(duration_us, start_us + 120000)::BIGINT AS start_us, greatest(least(duration_us, start_us + 120000) + 50000, least(duration_us, end_us + 120000))::BIGINT AS end_us, trim(text) AS text FROM even JOIN conv_media USING (item_id) WHERE (item_id + line) % 50 <> 49 AND end_us > start_us AND trim(text) <> ''",
    "wrap_titles": r"""WITH RECURSIVE t AS (SELECT p_partkey, regexp_extract_all(trim(coalesce(nullif(trim(p_name), ''), '未命名视频')), '[A-Za-z0-9_-]+|\s+|.') AS w FROM part),
      r AS (SELECT p_partkey, w, 0 AS i, '' AS now, []::VARCHAR[] AS done FROM t
        UNION ALL SELECT p_partkey, w, i + 1, CASE WHEN over THEN ltrim(w[i + 1]) ELSE now || w[i + 1] END, CASE WHEN over THEN list_append(done, trim(now)) ELSE done END
        FROM (SELECT *, now <> '' AND round_even((length(replace(now || w[i + 1], ' ', '')) + length(regexp_replace(now || w[i + 1], '[\x00-\x7F]', '', 'g'))) / 2, 0) > 10 AS over FROM r WHERE i < len(w)))
      SELECT p_partkey, array_to_string(list_append(done, trim(now))[1:3], chr(10)) AS lines FROM r WHERE i = len(w)""",
    "cues_script_on_timings": f"""WITH {TURNS_SQL}, l AS (SELECT conv_id AS item_id, turn AS utt, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))))) AS i FROM conversations WHERE conv_id % 2 = 0),
      s AS (SELECT item_id, utt, i, unnest(x) AS phrase, unnest(range(len(x))) AS k FROM (SELECT item_id, utt, i, regexp_extract_all(trim(line), '[^。！？!?；;，,、]*[。！？!?；;，,、]?') AS x FROM l)),
      o AS (SELECT item_id, utt AS a, i, k, trim(phrase) AS phrase FROM s WHERE trim(phrase) <> '' UNION ALL SELECT conv_id, turn // 2, 0, 0, string_agg(coalesce(text, ''), ' ' ORDER BY turn) FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id, turn // 2),
      p AS (SELECT item_id, phrase, row_number() OVER (PARTITION BY item_id ORDER BY a, i, k) - 1 AS j, count(*) OVER (PARTITION BY item_id) AS n FROM o),
      q AS (SELECT *, greatest(4, length(regexp_replace(phrase, '\\*\\*(.+?)\\*\\*', '\\1', 'g'))) AS wt FROM p), r AS (SELECT *, sum(wt) OVER (PARTITION BY item_id ORDER BY j) AS c, sum(wt) OVER (PARTITION BY item_id) AS t FROM q),
      m AS (SELECT item_id, count(*) AS m, list(start_us ORDER BY utt) AS ss, list(end_us ORDER BY utt) AS es FROM conv_turns WHERE end_us > start_us GROUP BY item_id),
      x AS (SELECT *, j * m // n AS a, greatest(j * m // n + 1, (j + 1) * m // n) AS b FROM r JOIN m USING (item_id) JOIN conv_media USING (item_id))
      SELECT item_id, j + 1 AS idx, (CASE WHEN n <= m THEN ss[a + 1] ELSE ss[1] + floor((greatest(ss[1] + 200000, es[-1]) - ss[1]) * (c - wt) / t) END)::BIGINT AS start_us,
        (CASE WHEN n <= m THEN greatest(ss[a + 1] + 200000, es[b]) WHEN j = n - 1 THEN greatest(ss[1] + 200000, es[-1]) ELSE ss[1] + floor((greatest(ss[1] + 200000, es[-1]) - ss[1]) * c / t) END)::BIGINT AS end_us, phrase AS text FROM x""",
}
