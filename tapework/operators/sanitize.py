"""Clean-up of what models and editors hand in: annotations, sentences, their tokens, and title clips.

Missing values are null. Times are microseconds and come out within the item. All windows run within one item.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import estimated_by_weight

ITEM = "item_id"
# Delete types, and the most characters that fields keep.
DELETE_TYPES = ["stutter", "false_start", "exact_repeat", "semantic_repeat", "filler", "redundant"]
OTHER_TYPE = "redundant"
REASON_CHARS, SENTENCE_CHARS, TITLE_CHARS, TOKEN_CHARS, TOKEN_ID_CHARS, ID_CHARS, SOURCE_CHARS = 300, 1000, 800, 200, 80, 40, 40
KINDS = ["corrections", "break_hints", "allowed_breaks", "forbidden_breaks", "protected_spans", "repeat_candidates", "delete_ranges", "final_sentences"]
GAP_END_US, MOST_ORDER = 3_600_000_000, 100_000.0


def sanitize_annotations(raw: DataFrame, value: str = "value", response: str | None = None) -> DataFrame:
    """Annotations of model responses: item_id, kind, seq (from 1 among what the kind lists), token_ids, after_token_id, type, text, replacement, confidence, reason.

    raw: item_id and value, a response as JSON text, perhaps with chatter around it. An item has one response, or several that the column
    `response` tells apart, which then comes after item_id; each is numbered and judged by itself. Entries without what their kind needs are
    left out. A response with a confidence that is no number, in an entry that would have stayed, is not used: it gives one row of
    the kind quarantined, as does a response that can't be read. Missing confidences are 0, others are held within 0 and 1.
    """
    by = [ITEM] if response is None else [ITEM, response]
    body = F.regexp_extract(F.coalesce(F.col(value), F.lit("")), r"(?s)\{.*\}", 0)
    read = raw.select(*by, F.try_parse_json(body).alias("_json"))
    none = F.expr("cast(array() as array<variant>)")

    def entries(kind: str) -> Column:
        return F.transform(F.coalesce(F.try_variant_get("_json", f"$.{kind}", "array<variant>"), none), lambda v, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("long").alias("seq"), v.alias("v")))

    listed = F.concat(*map(entries, KINDS))
    rows = read.select(*by, F.col("_json").isNull().alias("_unread"), F.explode_outer(listed).alias("e")).select(*by, "_unread", "e.kind", "e.seq", "e.v")
    get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    said = lambda name, most: F.left(F.coalesce(get(name), F.lit("")), F.lit(most))
    given = get("confidence", "variant")
    number = get("confidence", "double")
    ids = get("token_ids", "array<string>")
    rows = rows.select(
        *by, "_unread", "kind", "seq", ids.isNotNull().alias("_list"), F.filter(F.coalesce(ids, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & (x != "")).alias("token_ids"), get("after_token_id").alias("_after"),
        get("type").alias("_type"), F.when(F.col("kind") == "final_sentences", said("text", SENTENCE_CHARS)).otherwise(said("text", REASON_CHARS)).alias("text"), said("replacement", REASON_CHARS).alias("replacement"),
        F.when(given.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).alias("confidence"), (given.isNotNull() & number.isNull()).alias("_no_number"), said("reason", REASON_CHARS).alias("reason"),
    )
    n, kind = F.size("token_ids"), F.col("kind")
    span = (n >= 2) & (F.col("text") != "")
    after = F.coalesce(F.col("_after"), F.lit("")) != ""
    stays = (
        F.when(kind == "forbidden_breaks", span | after).when(kind.isin("break_hints", "allowed_breaks"), after).when(kind == "protected_spans", F.col("_list") & span)
        .when(kind == "delete_ranges", F.col("_list") & (n > 0)).when(kind == "final_sentences", F.col("_list") & (n > 0) & (F.col("text") != ""))
        .when(kind == "corrections", F.col("_list") & (F.col("replacement") != "")).otherwise(F.col("_list"))
    )
    # What fails a response is read before the entry is judged in full: of corrections and forbidden breaks every entry's confidence counts.
    asked = F.when(kind == "forbidden_breaks", F.lit(True)).when(kind == "corrections", F.col("_list")).when(kind == "final_sentences", F.lit(False)).otherwise(stays)
    rows = rows.withColumns({"_stays": F.coalesce(stays, F.lit(False)), "_fails": F.coalesce(asked & F.col("_no_number"), F.lit(False)) | F.col("_unread")})
    rows = rows.withColumn("_failed", F.max("_fails").over(Window.partitionBy(*by)))
    boundary = kind.isin("break_hints", "allowed_breaks") | ((kind == "forbidden_breaks") & ~span)
    none = F.lit(None).cast("string")
    good = rows.where("_stays AND NOT _failed").select(
        *by, "kind", "seq", F.when(boundary, F.expr("cast(array() as array<string>)")).otherwise(F.col("token_ids")).alias("token_ids"), F.when(boundary, F.col("_after")).alias("after_token_id"),
        F.when(kind == "delete_ranges", F.when(F.col("_type").isin(DELETE_TYPES), F.col("_type")).otherwise(OTHER_TYPE)).alias("type"), F.when(kind.isin("protected_spans", "final_sentences") | ((kind == "forbidden_breaks") & span), F.col("text")).alias("text"),
        F.when(kind == "corrections", F.col("replacement")).alias("replacement"), F.when(kind != "final_sentences", F.col("confidence")).alias("confidence"), F.when(kind != "final_sentences", F.col("reason")).alias("reason"),
    )
    bad = rows.where("_failed").select(*by).distinct().select(*by, F.lit("quarantined").alias("kind"), F.lit(0).cast("long").alias("seq"), F.expr("cast(array() as array<string>)").alias("token_ids"), *[none.alias(c) for c in ("after_token_id", "type", "text", "replacement")], F.lit(None).cast("double").alias("confidence"), none.alias("reason"))
    return good.unionByName(bad)


def clean_ids(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """rows with column as a clean name that no earlier row (by idx) of the item has; idx counts from 1.

    Signs become hyphens and names begin with the prefix; a name that is taken gets the first free number from 2 after it.
    Items without a name twice, which are most, need no more than that.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    numbered = F.format_string(f"{prefix}%03d", "idx")
    plain = F.when(plain == "", numbered).otherwise(plain)
    named = rows.withColumn(column, F.left(F.when(plain.startswith(prefix), plain).otherwise(F.concat(F.lit(f"{prefix}-"), plain)), F.lit(ID_CHARS)))
    twice = named.groupBy(ITEM, column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(ITEM).distinct()
    kind = rows.schema[ITEM].dataType.simpleString()

    def settle(of: pd.DataFrame) -> pd.DataFrame:
        """Names of one item, which holds some thousand at most, in order."""
        used: set[str] = set()
        following: dict[str, int] = {}
        of, out = of.sort_values("idx"), []
        for base in of["_name"]:
            name, n = base, following.get(base, 2)
            while name in used:
                name, n = f"{base}-{n}", n + 1
            following[base] = n
            used.add(name)
            out.append(name)
        return of.assign(_name=out)

    few = named.join(twice, ITEM, "left_semi").select(ITEM, "idx", F.col(column).alias("_name"))
    settled = few.groupBy(ITEM).applyInPandas(settle, f"{ITEM} {kind}, idx long, _name string")
    return named.join(settled, [ITEM, "idx"], "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _within(value: Column, top: Column) -> Column:
    return F.greatest(F.lit(0), F.least(top, value)).cast("long")


def sanitize_sentences(new: DataFrame, old: DataFrame, media: DataFrame) -> DataFrame:
    """The sentences of a saved project: clean ids, times within the item, texts cut, in timeline order numbered from 1.

    new: item_id, idx (from 1, as handed in) and sentence_id, start_us, end_us, clip_start_us, clip_end_us, text, original_text, enabled,
    remove_video, gap, synthetic_gap, edited, timing_pending, timeline_order, layout_source, layout_reason; each may be null,
    and then the old sentence of the id counts, or a default. old: the same without idx; media: item_id, duration_us.
    If a sentence of an item has no clip, all clips of the item are stretched to leave no gap in the order of their times.
    """
    named = clean_ids(new, "sentence_id", "s").join(media.select(ITEM, "duration_us"), ITEM)
    before = old.select(ITEM, "sentence_id", *[F.col(c).alias(f"_old_{c}") for c in old.columns if c not in (ITEM, "sentence_id")])
    rows = named.join(before, [ITEM, "sentence_id"], "left")
    had = lambda c: F.coalesce(F.col(c), F.col(f"_old_{c}"))
    flag = lambda c, default=False: F.coalesce(F.col(c), F.col(f"_old_{c}"), F.lit(default))
    gap = flag("synthetic_gap") & flag("gap")
    rows = rows.withColumns({"_gap": gap, "_top": F.when(gap, F.lit(GAP_END_US)).otherwise(F.col("duration_us"))})
    top = F.col("_top")
    rows = rows.withColumn("_start", _within(F.coalesce(had("start_us"), F.lit(0)), top))
    rows = rows.withColumn("_end", _within(F.coalesce(had("end_us"), F.least(top, F.col("_start") + 200_000)), top))
    rows = rows.withColumn("_end", F.when(F.col("_end") <= F.col("_start"), F.least(top, F.col("_start") + 200_000)).otherwise(F.col("_end")))
    rows = rows.withColumns({"_cs": _within(F.coalesce(had("clip_start_us"), F.col("_start")), top), "_ce": _within(F.coalesce(had("clip_end_us"), F.col("_end")), top)})
    rows = rows.withColumn("_ce", F.when(F.col("_ce") <= F.col("_cs"), F.least(top, F.col("_cs") + 50_000)).otherwise(F.col("_ce")))
    rows = rows.withColumn("_text", F.left(_strip(F.coalesce(had("text"), F.lit(""))), F.lit(SENTENCE_CHARS)))
    # A text that stands in for a missing original is stripped already; it may be cut at a line feed, and then only blanks go.
    rows = rows.withColumn("_original", F.left(F.coalesce(_strip(had("original_text")), F.trim("_text")), F.lit(SENTENCE_CHARS)))
    order = F.greatest(F.lit(0.0), F.least(F.lit(MOST_ORDER), F.coalesce(had("timeline_order"), F.col("idx")).cast("double")))
    item = Window.partitionBy(ITEM)
    rows = rows.withColumns({"_order": order, "_stretch": F.max(had("clip_start_us").isNull() | had("clip_end_us").isNull()).over(item)})
    times = item.orderBy("_start", "_end", "sentence_id")
    following = F.lead("_start").over(times)
    rows = rows.withColumns({
        "timeline_order": F.row_number().over(item.orderBy("_order", "_start", "_end", "sentence_id")).cast("long"),
        "_cs": F.when(F.col("_stretch") & (F.row_number().over(times) == 1), F.lit(0).cast("long")).otherwise(F.col("_cs")),
        "_ce": F.when(F.col("_stretch"), F.greatest("_ce", F.coalesce(following, F.col("duration_us")))).otherwise(F.col("_ce")),
    })
    cut = lambda c, most: F.left(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_old_{c}"), F.lit("")), F.lit(most)).alias(c)
    return rows.select(
        ITEM, "sentence_id", "timeline_order", F.col("_start").alias("start_us"), F.col("_end").alias("end_us"), F.col("_cs").alias("clip_start_us"), F.col("_ce").alias("clip_end_us"), F.col("_text").alias("text"), F.col("_original").alias("original_text"),
        flag("enabled", True).alias("enabled"), flag("remove_video").alias("remove_video"), flag("gap").alias("gap"), F.col("_gap").alias("synthetic_gap"), (flag("edited") | (F.col("_text") != F.col("_original"))).alias("edited"), flag("timing_pending").alias("timing_pending"),
        cut("layout_source", SOURCE_CHARS), cut("layout_reason", REASON_CHARS),
    )


def sanitize_tokens(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """The tokens of sentences, held within their sentence; of a sentence whose text they don't spell, estimated ones.

    tokens: item_id, sentence_id, idx (from 1), token_id, text, original_text, start_us, end_us, timing_source, edited; all but the
    first three may be null, and one without text doesn't count. sentences: item_id, sentence_id, text, start_us, end_us.
    """
    key = [ITEM, "sentence_id"]
    sides = sentences.select(*key, F.coalesce("text", F.lit("")).alias("_text"), F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
    some = tokens.where(F.coalesce(F.col("text"), F.lit("")) != "").join(sides, key)
    start = F.greatest("_from", F.least("_to", F.coalesce("start_us", "_from")))
    some = some.withColumn("_s", start).withColumn("_e", F.greatest("_s", F.least("_to", F.coalesce("end_us", "_s"))))
    or_else = lambda c, other, most: F.left(F.coalesce(F.nullif(F.col(c), F.lit("")), other), F.lit(most))
    held = some.select(
        *key, F.col("idx").cast("long").alias("idx"), or_else("token_id", F.format_string("%s-w%04d", "sentence_id", "idx"), TOKEN_ID_CHARS).alias("token_id"), F.left("text", F.lit(TOKEN_CHARS)).alias("text"), or_else("original_text", F.col("text"), TOKEN_CHARS).alias("original_text"),
        F.col("_s").alias("start_us"), F.col("_e").alias("end_us"), or_else("timing_source", F.lit("estimated"), SOURCE_CHARS).alias("timing_source"), F.coalesce("edited", F.lit(False)).alias("edited"),
    )
    spelled = held.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]), "").alias("_spelled"))
    judged = sides.join(spelled, key, "left")
    right = F.coalesce(_strip(F.col("_spelled")) == _strip(F.replace("_text", F.lit(" "), F.lit(""))), F.lit(False))
    kept = held.join(judged.where(right).select(*key), key, "left_semi")
    made = estimated_by_weight(judged.where(~right), key, F.col("_text"), F.col("_from"), F.col("_to"), F.col("sentence_id"))
    made = made.select(*key, (F.col("_at") + 1).cast("long").alias("idx"), "token_id", "text", F.col("text").alias("original_text"), "start_us", "end_us", "timing_source", F.lit(False).alias("edited"))
    return kept.unionByName(made)


def sanitize_title_clips(new: DataFrame, old: DataFrame, titles: DataFrame) -> DataFrame:
    """The title clips of items, within the item, ordered by time: item_id, clip_no (from 1), clip_id, start_us, end_us, text, enabled, title_text.

    new: item_id, idx (from 1), clip_id, start_us, end_us, text, enabled, use_for_cover; old: the same without idx; missing values are
    null and come from old. titles: item_id, duration_us, title_text, show_title; an item without clips gets one of the title,
    3 s long. A clip that stood for the cover loses its text, and the title's text goes with it: for later clips and in title_text.
    """
    top = F.col("duration_us")
    default = titles.join(new.select(ITEM).distinct(), ITEM, "left_anti").select(ITEM, F.lit(1).cast("long").alias("idx"), F.lit("t001").alias("clip_id"), F.lit(0).cast("long").alias("start_us"), F.least(F.greatest(top, F.lit(200_000)), F.lit(3_000_000)).cast("long").alias("end_us"), F.coalesce("title_text", F.lit("")).alias("text"), F.coalesce("show_title", F.lit(False)).alias("enabled"), F.lit(False).alias("use_for_cover"))
    named = clean_ids(new.unionByName(default), "clip_id", "t").join(titles.select(ITEM, "duration_us", "title_text"), ITEM)
    before = old.select(ITEM, "clip_id", *[F.col(c).alias(f"_old_{c}") for c in ("start_us", "end_us", "text", "enabled", "use_for_cover")])
    rows = named.join(before, [ITEM, "clip_id"], "left")
    had = lambda c: F.coalesce(F.col(c), F.col(f"_old_{c}"))
    cover = F.coalesce(had("use_for_cover"), F.lit(False))
    item = Window.partitionBy(ITEM)
    earlier = F.coalesce(F.max("_cover").over(item.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_cover", cover).withColumns({"_cleared": earlier, "_any": F.max("_cover").over(item), "_s": _within(F.coalesce(had("start_us"), F.lit(0)), top)})
    rows = rows.withColumn("_e", _within(F.coalesce(had("end_us"), F.least(top, F.col("_s") + 3_000_000)), top))
    rows = rows.withColumn("_e", F.when(F.col("_e") <= F.col("_s"), F.least(top, F.col("_s") + 200_000)).otherwise(F.col("_e")))
    title = F.coalesce("title_text", F.lit(""))
    text = F.left(F.coalesce(had("text"), F.when(F.col("_cleared"), "").otherwise(title)), F.lit(TITLE_CHARS))
    rows = rows.withColumns({"_t": F.when(F.col("_cover"), "").otherwise(text), "clip_no": F.row_number().over(item.orderBy("_s", "_e", "clip_id")).cast("long")})
    return rows.select(ITEM, "clip_no", "clip_id", F.col("_s").alias("start_us"), F.col("_e").cast("long").alias("end_us"), F.col("_t").alias("text"), (~F.col("_cover") & F.coalesce(had("enabled"), F.lit(False))).alias("enabled"), F.when(F.col("_any"), "").otherwise(title).alias("title_text"))
