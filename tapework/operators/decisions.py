"""Decisions on token ranges: which proposed deletions and corrections are taken.

tokens: item_id, pos (from 0), token_id, text, start_us, end_us, and more. annotations: item_id, seq, kind, type,
token_ids or positions, confidence, text, replacement. A proposed deletion has item_id, seq, type, confidence, positions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import span_form

ITEM = "item_id"

# The modes' base thresholds, what they allow, and the lowest threshold of each type.
MODES = {"conservative": 0.9, "standard": 0.82, "aggressive": 0.72}
ALLOWED = {
    "conservative": ["stutter", "false_start", "exact_repeat"],
    "standard": ["stutter", "false_start", "exact_repeat", "semantic_repeat", "filler"],
    "aggressive": ["stutter", "false_start", "exact_repeat", "semantic_repeat", "filler", "redundant"],
}
LOWEST = {"false_start": 0.86, "exact_repeat": 0.88, "filler": 0.9, "redundant": 0.9}
FILLERS = ["嗯", "啊", "呃", "额", "那个", "这个", "就是"]


def policy_table(spark: SparkSession) -> DataFrame:
    """mode, type, threshold: at most 18 rows, so it goes to every task."""
    rows = []
    for mode, base in MODES.items():
        for kind in ALLOWED[mode]:
            least = 0.94 if kind == "semantic_repeat" and mode == "standard" else max(base, LOWEST.get(kind, 0.0))
            rows.append((mode, kind, least))
    return spark.createDataFrame(rows, "mode string, type string, threshold double")


def delete_policy(deletes: DataFrame, mode: str) -> DataFrame:
    """deletes with passes_policy: the mode allows the type, the confidence reaches its threshold and a position is left."""
    policy = policy_table(deletes.sparkSession).where(F.col("mode") == mode).select("type", "threshold")
    joined = deletes.join(F.broadcast(policy), "type", "left")
    passes = F.col("threshold").isNotNull() & (F.col("confidence") >= F.col("threshold")) & (F.size("positions") > 0)
    return joined.withColumn("passes_policy", F.coalesce(passes, F.lit(False))).drop("threshold")


def contiguity(deletes: DataFrame) -> DataFrame:
    """deletes with n_tokens, first_pos, last_pos of their distinct positions, and contiguous: they are one run."""
    distinct = F.array_distinct("positions")
    out = deletes.withColumns({"n_tokens": F.size(distinct).cast("long"), "first_pos": F.array_min("positions"), "last_pos": F.array_max("positions")})
    return out.withColumn("contiguous", F.coalesce(F.col("last_pos") - F.col("first_pos") + 1 == F.col("n_tokens"), F.lit(False)))


def _protected_shape(protect_latin: bool) -> Column:
    shape = F.col("text").rlike(r"[0-9]")
    return shape | F.col("text").rlike(r"^[A-Za-z][A-Za-z0-9._+-]*$") if protect_latin else shape


def _protected_spans(spans: DataFrame) -> DataFrame:
    return spans.where("confidence >= 0.8").select(ITEM, F.explode("positions").alias("pos"))


def protected_tokens(tokens: DataFrame, spans: DataFrame | None = None, protect_latin: bool = True) -> DataFrame:
    """item_id and pos of tokens that no deletion may touch: with a digit, Latin words, and those of sure protected spans.

    spans: item_id, positions, confidence.
    """
    found = tokens.where(_protected_shape(protect_latin)).select(ITEM, "pos")
    if spans is not None:
        found = found.union(_protected_spans(spans))
    return found.distinct()


def delete_evidence(deletes: DataFrame, tokens: DataFrame, mode: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """deletes (with contiguity()) with deleted, right_text, evidence (true or false) and evidence_reason.

    What follows the deleted tokens has to show why: the next max(6, n + 2) tokens are read. more: aggregates over the tokens
    that are read, which have first_pos and last_pos beside them.
    """
    around = F.sequence("first_pos", F.col("last_pos") + F.greatest(F.lit(6), F.col("n_tokens") + 2))
    wanted = deletes.where("contiguous AND n_tokens > 0").select(ITEM, "seq", "first_pos", "last_pos", F.explode(around).alias("pos")).hint("merge")
    met = wanted.join(tokens, [ITEM, "pos"])
    side = lambda inside: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "text")))), lambda t: t["text"]), ""))
    texts = met.groupBy(ITEM, "seq").agg(side(F.col("pos") <= F.col("last_pos")).alias("deleted"), side(F.col("pos") > F.col("last_pos")).alias("right_text"), *more).hint("merge")
    out = deletes.join(texts, [ITEM, "seq"], "left").withColumns({"deleted": F.coalesce("deleted", F.lit("")), "right_text": F.coalesce("right_text", F.lit(""))})
    deleted, right, kind = F.col("deleted"), F.col("right_text"), F.col("type")
    lengths = F.sequence(F.lit(1), F.least(F.length(deleted), F.length(right)))
    shared = F.size(F.filter(lengths, lambda n: F.substring(deleted, F.lit(1), n) == F.substring(right, F.lit(1), n)))
    shared = F.when((F.length(deleted) > 0) & (F.length(right) > 0), shared).otherwise(0)
    starts = right.startswith(deleted)
    stutter = starts | right.startswith(F.right(deleted, F.lit(1)))
    restart = shared >= F.least(F.lit(2), F.length(deleted))
    missing = (deleted == "") | ((right == "") & ~kind.isin("filler", "redundant"))

    def reason(yes: Column, good: str, bad: str) -> Column:
        return F.when(yes, good).otherwise(bad)

    told = (
        F.when(missing, "missing_adjacent_evidence")
        .when(kind == "stutter", reason(stutter, "adjacent_stutter_match", "stutter_not_repeated"))
        .when(kind == "exact_repeat", reason(starts, "adjacent_exact_repeat", "exact_repeat_not_found"))
        .when(kind == "false_start", reason(restart, "adjacent_restart_match", "restart_prefix_not_found"))
        .when(kind == "filler", reason(deleted.isin(FILLERS), "known_filler", "unknown_filler"))
        .when(kind == "semantic_repeat", F.lit("high_confidence_semantic_repeat"))
        .when(kind == "redundant", F.lit("aggressive_redundancy" if mode == "aggressive" else "redundancy_requires_aggressive"))
        .otherwise("unsupported_delete_type")
    )
    accepted = ["adjacent_stutter_match", "adjacent_exact_repeat", "adjacent_restart_match", "known_filler", "aggressive_redundancy"]
    accepted += ["high_confidence_semantic_repeat"] if mode in ("standard", "aggressive") else []
    return out.withColumn("evidence_reason", told).withColumn("evidence", F.col("evidence_reason").isin(accepted))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals, which come in order of item and seq, with skip_reason. Accepted ranges of an item don't overlap, so only their neighbour in order is looked at."""
    item, budget, used, firsts, lasts = object(), 0, 0, [], []
    for proposals in batches:
        columns, told = [proposals.column(c).to_pylist() for c in (ITEM, "_total", "_early", "_late", "first_pos", "last_pos", "n_tokens")], []
        for key, total, early, late, first, last, n in zip(*columns, strict=True):
            if key != item:
                item, budget, used, firsts, lasts = key, max(1, total * 2 // 5), 0, [], []
            why = early
            if why is None:
                k = bisect_right(firsts, last)  # the last accepted range that begins before this one ends
                why = "overlapping_delete" if k and lasts[k - 1] >= first else late
            if why is None and used + n > budget:
                why = "deletion_budget_exceeded"
            if why is None:
                firsts.insert(k, first)
                lasts.insert(k, last)
                used += n
            told.append(why)
        yield pa.RecordBatch.from_arrays([*proposals.columns, pa.array(told, pa.string())], names=[*proposals.schema.names, "skip_reason"])


def accept_deletes(deletes: DataFrame, tokens: DataFrame, mode: str, spans: DataFrame | None = None, protect_latin: bool = True) -> DataFrame:
    """Each proposed deletion with applied, skip_reason or validation, and the range start_us to end_us that an applied one cuts.

    Rules in order: policy, contiguity, protected content, overlap with an accepted deletion, evidence, and the budget of 40 %
    of the item's tokens. Overlap and budget depend on what was accepted before, so an item's proposals are settled in order of
    seq; everything else is joined.
    """
    read, guarded = tokens.select(ITEM, "pos", "text", "start_us", "end_us"), F.coalesce(_protected_shape(protect_latin), F.lit(False))
    if spans is not None:
        read, guarded = read.join(_protected_spans(spans).distinct().withColumn("_sure", F.lit(True)), [ITEM, "pos"], "left"), guarded | F.coalesce("_sure", F.lit(False))
    inside = (F.col("pos") >= F.col("first_pos")) & (F.col("pos") <= F.col("last_pos"))
    more = (
        F.max(inside & guarded).alias("_protected"),
        F.min(F.when(F.col("pos") == F.col("first_pos"), F.col("start_us"))).alias("_s"), F.max(F.when(F.col("pos") == F.col("last_pos"), F.col("end_us"))).alias("_e"),
    )
    known = delete_evidence(contiguity(delete_policy(deletes, mode)), read, mode, more)
    early = F.when(~F.col("passes_policy"), "policy_or_confidence").when(~F.col("contiguous"), "non_contiguous_tokens").when(F.coalesce("_protected", F.lit(False)), "protected_content")
    totals = tokens.groupBy(ITEM).agg(F.count(F.lit(1)).alias("_total"))
    judged = known.withColumns({"_early": early, "_late": F.when(~F.col("evidence"), F.col("evidence_reason"))}).join(totals, ITEM)
    judged = judged.select(ITEM, "seq", "type", "confidence", "positions", "n_tokens", "first_pos", "last_pos", "evidence_reason", "_early", "_late", "_s", "_e", "_total")
    shape = T.StructType([*judged.schema.fields, T.StructField("skip_reason", T.StringType())])
    order = [F.asc_nulls_last(c) for c in (ITEM, "seq", "type", "confidence", "first_pos")]
    each = judged.repartition(ITEM).sortWithinPartitions(*order).mapInArrow(_settle, shape)
    each = each.withColumn("applied", F.col("skip_reason").isNull())
    first = F.greatest(F.lit(0), F.col("_s") - 25_000)
    times = {"start_us": F.when(F.col("applied"), first), "end_us": F.when(F.col("applied"), F.greatest(first + 40_000, F.col("_e") + 25_000)), "validation": F.when(F.col("applied"), F.col("evidence_reason"))}
    return each.withColumns(times).select(ITEM, "seq", "type", "confidence", "positions", "n_tokens", "first_pos", "last_pos", "applied", "skip_reason", "validation", "start_us", "end_us")


def removed_tokens(decided: DataFrame) -> DataFrame:
    """item_id and pos of the tokens that applied deletions remove."""
    return decided.where("applied").select(ITEM, F.explode("positions").alias("pos")).distinct()


def apply_corrections(tokens: DataFrame, corrections: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Tokens with sure corrections: the first token of one takes the replacement, the rest become empty; later ones win.

    corrections: item_id, seq, positions, replacement, confidence, reason.
    """
    sure = corrections.where((F.col("confidence") >= threshold) & (F.coalesce("replacement", F.lit("")) != ""))
    places = sure.select(ITEM, "seq", "replacement", "reason", "confidence", F.posexplode("positions").alias("_k", "pos"))
    places = places.join(tokens.select(ITEM, "pos"), [ITEM, "pos"], "left_semi")
    first = F.min("_k").over(Window.partitionBy(ITEM, "seq"))
    places = places.withColumn("_text", F.when(F.col("_k") == first, F.col("replacement")).otherwise(""))
    last = places.withColumn("_n", F.row_number().over(Window.partitionBy(ITEM, "pos").orderBy(F.desc("seq"), F.desc("_k")))).where("_n = 1")
    lead = F.when(F.col("_text") != "", F.col("confidence"))
    joined = tokens.join(last.select(ITEM, "pos", "_text", lead.alias("correction_confidence"), F.when(F.col("_text") != "", F.coalesce("reason", F.lit(""))).alias("correction_reason")), [ITEM, "pos"], "left")
    changed = F.col("_text").isNotNull()
    return joined.withColumns({"text": F.coalesce("_text", "text"), "edited": F.col("edited") | changed}).drop("_text")


def valid_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans with valid: their tokens follow each other and spell the span's text, blanks, signs and case aside.

    spans: item_id, seq, positions, text; positions that no token has are left out first.
    """
    places = spans.select(ITEM, "seq", F.posexplode("positions").alias("_k", "pos")).join(tokens.select(ITEM, "pos", F.col("text").alias("_token")), [ITEM, "pos"])
    listed = F.array_sort(F.collect_list(F.struct("_k", "pos", "_token")))
    read = places.groupBy(ITEM, "seq").agg(listed.alias("_l"))
    runs = F.size("_l") - 1 == F.element_at("_l", -1)["pos"] - F.element_at("_l", 1)["pos"]
    ascending = F.forall(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_l", i.cast("int"))["pos"] == F.element_at("_l", 1)["pos"] + i - 1)
    read = read.select(ITEM, "seq", (runs & ascending).alias("_run"), F.array_join(F.transform("_l", lambda t: t["_token"]), "").alias("_joined"), F.transform("_l", lambda t: t["pos"]).alias("_known"))
    out = spans.join(read, [ITEM, "seq"], "left")
    wanted = span_form(F.coalesce("text", F.lit("")))
    return out.withColumn("valid", F.coalesce(F.col("_run") & (wanted != "") & (span_form(F.col("_joined")) == wanted), F.lit(False))).withColumn("positions", F.coalesce("_known", F.expr("cast(array() as array<bigint>)"))).drop("_run", "_joined", "_known")


def break_sets(tokens: DataFrame, annotations: DataFrame) -> DataFrame:
    """item_id, pos, kind: after which tokens a line is preferred, required or forbidden to end.

    annotations: item_id, seq, kind, positions, after_pos, text, confidence, of the kinds break_hint, allowed_break,
    forbidden_break, final_sentence and protected_span. tokens may have manual_break_after, script_sentence_break_after and
    script_phrase_break_after.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in tokens.columns else F.lit(False)
    last = tokens.groupBy(ITEM).agg(F.max("pos").alias("pos"))
    at = tokens.select(ITEM, "pos")
    ann = valid_spans(annotations, tokens)
    single = annotations.where("after_pos IS NOT NULL").select(ITEM, "kind", "confidence", "seq", F.col("after_pos").alias("pos"))
    hints = single.where("kind IN ('break_hint', 'allowed_break') AND confidence >= 0.6").select(ITEM, "pos").join(at, [ITEM, "pos"], "left_semi")
    inner = lambda df: df.select(ITEM, F.explode(F.slice("positions", F.lit(1), F.greatest(F.size("positions") - 1, F.lit(0)))).alias("pos"))
    spans = ann.where("kind = 'forbidden_break' AND confidence >= 0.7")
    bare = spans.where("NOT valid AND after_pos IS NOT NULL").select(ITEM, F.col("after_pos").alias("pos")).join(at, [ITEM, "pos"], "left_semi")
    forbidden = inner(spans.where("valid")).union(bare)
    ends = ann.where("kind = 'final_sentence' AND valid").select(ITEM, F.element_at("positions", -1).alias("pos"))
    marks = tokens.where(flag("manual_break_after") | flag("script_sentence_break_after")).select(ITEM, "pos")
    required = ends.union(marks).distinct().join(last, [ITEM, "pos"], "left_anti")
    phrases = tokens.where(flag("script_phrase_break_after") & ~flag("manual_break_after") & ~flag("script_sentence_break_after")).select(ITEM, "pos")
    preferred = hints.union(phrases).union(required).distinct()
    word = F.regexp_replace("token_id", r"-c[0-9]+$", "")
    same = tokens.select(ITEM, "pos", word.alias("_w")).withColumn("_next", F.lead("_w").over(Window.partitionBy(ITEM).orderBy("pos"))).where("_w <> '' AND _w = _next").select(ITEM, "pos")
    protected = inner(ann.where("kind = 'protected_span' AND confidence >= 0.7 AND valid"))
    forbidden = forbidden.union(same).union(protected).distinct().join(required, [ITEM, "pos"], "left_anti")
    named = [preferred.withColumn("kind", F.lit("preferred")), required.withColumn("kind", F.lit("required")), forbidden.withColumn("kind", F.lit("forbidden"))]
    return named[0].union(named[1]).union(named[2])


def token_conservation(source: DataFrame, mapped: DataFrame, removed: DataFrame) -> DataFrame:
    """Items whose mapped tokens aren't the source's without the removed ones: item_id and counts of what is wrong.

    source and mapped: item_id, pos (order) and token_id; removed: item_id and token_id.
    """
    expected = source.join(removed.select(ITEM, "token_id").distinct(), [ITEM, "token_id"], "left_anti").select(ITEM, "token_id", F.col("pos").alias("_e"))
    got = mapped.select(ITEM, "token_id", F.col("pos").alias("_m"))
    by_id = got.groupBy(ITEM, "token_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m"))
    both = expected.join(by_id, [ITEM, "token_id"], "full")
    order = Window.partitionBy(ITEM).orderBy("_e")
    both = both.withColumn("_back", F.col("_e").isNotNull() & F.col("_m").isNotNull() & (F.col("_m") < F.max("_m").over(order.rowsBetween(Window.unboundedPreceding, -1))))
    counted = both.groupBy(ITEM).agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"),
        F.count_if(F.col("_n") > 1).alias("duplicates"), F.count_if("_back").alias("_backs"),
    )
    clean = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicates") == 0)
    return counted.withColumn("order_changed", clean & (F.col("_backs") > 0)).drop("_backs").where(~clean | F.col("order_changed"))


def write_conserved(source: DataFrame, mapped: DataFrame, removed: DataFrame, path: str, fail: bool = False) -> None:
    """Write mapped, in place of what is at path, in one pass that lets only conserved items through; see token_conservation().

    Rows of good items are in the folder's partition gate=clean, those of items with lost, added, repeated or moved tokens in gate=quarantine,
    with an error that says what is wrong. An item that lost all of its tokens has a row there of its own, without a position. With fail
    the write fails at the first such row, and nothing is at path then.
    """
    parts = [F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("missing", "unexpected", "duplicates")]
    error = F.concat_ws("; ", *parts, F.when(F.col("order_changed"), F.lit("order_changed=true")))
    broken = token_conservation(source, mapped, removed).select(ITEM, error.alias("error"))
    gone = broken.join(mapped.select(ITEM).distinct(), ITEM, "left_anti")
    rows = mapped.join(broken, ITEM, "left").unionByName(gone, allowMissingColumns=True)
    if fail:
        message = F.concat(F.lit("token integrity check failed for item "), F.col(ITEM).cast("string"), F.lit(": "), "error")
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(message).cast("string")))
    rows.withColumn("gate", F.when(F.col("error").isNull(), "clean").otherwise("quarantine")).write.mode("overwrite").partitionBy("gate").parquet(path)


def flag_repeats(sentences: DataFrame, candidates: DataFrame) -> DataFrame:
    """sentences with repeat_candidate: one of their positions is in a candidate. Both: item_id and positions; sentences: sentence_id."""
    marked = candidates.select(ITEM, F.explode("positions").alias("pos")).distinct()
    hit = sentences.select(ITEM, "sentence_id", F.explode("positions").alias("pos")).join(marked, [ITEM, "pos"], "left_semi").select(ITEM, "sentence_id").distinct()
    return sentences.join(hit.withColumn("_hit", F.lit(True)), [ITEM, "sentence_id"], "left").withColumn("repeat_candidate", F.coalesce("_hit", F.lit(False))).drop("_hit")


def keep_last_good(new: DataFrame, old: DataFrame) -> DataFrame:
    """new, but a failed analysis of an item whose old one is ok keeps the old payload with a warning. Both: item_id, status, payload."""
    before = old.select(ITEM, F.col("status").alias("_status"), F.col("payload").alias("_payload"))
    joined = new.join(before, ITEM, "left")
    keep = (F.col("status") != "ok") & (F.coalesce("_status", F.lit("")) == "ok")
    return joined.select(
        ITEM, F.when(keep, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(keep, F.col("_payload")).otherwise(F.col("payload")).alias("payload"),
        F.when(keep, "analysis_failed_kept_previous").alias("warning"),
    )
