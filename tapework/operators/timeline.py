"""Edited timelines: clips in the order of an edit, their plan, and cues on them.

sentences: item_id, sentence_id, start_us, end_us, clip_start_us, clip_end_us, timeline_order, text, enabled,
remove_video, gap, synthetic_gap. clips add clip_idx, from_us and to_us, the source range that is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import map_points

ITEM = "item_id"
GAP_LIMIT_US = 3_600_000_000
LEAST_CLIP_US = 50_000


def _clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def plan_clips(sentences: DataFrame, media: DataFrame) -> DataFrame:
    """The clips of an edit in timeline order; an item that shows nothing is shown whole.

    Removed sentences are left out, clips are clamped to the item and dropped if they last 50 ms or less; a synthetic gap
    may be longer than the item.
    """
    every = sentences.join(media.select(ITEM, "duration_us"), ITEM).where("NOT remove_video")
    synthetic = F.col("synthetic_gap") & F.col("gap")
    zero, limit = F.lit(0).cast("long"), F.when(synthetic, GAP_LIMIT_US).otherwise(F.col("duration_us"))
    start = _clamp(F.coalesce("clip_start_us", "start_us"), zero, limit)
    end = F.coalesce("clip_end_us", "end_us", F.when(synthetic, F.col("from_us") + 1_000_000).otherwise(F.col("from_us")))
    every = every.withColumn("from_us", start)
    every = every.withColumn("to_us", _clamp(end, F.when(synthetic, F.col("from_us") + LEAST_CLIP_US).otherwise(zero), limit))
    shown = every.where(F.col("to_us") - F.col("from_us") > LEAST_CLIP_US)
    order = Window.partitionBy(ITEM).orderBy("timeline_order", "start_us", "sentence_id")
    shown = shown.withColumn("clip_idx", F.row_number().over(order).cast("long")).drop("duration_us")
    empty = media.join(shown.select(ITEM).distinct(), ITEM, "left_anti")
    whole = empty.select(ITEM, F.lit(0).cast("long").alias("from_us"), F.col("duration_us").alias("to_us"), F.lit(1).cast("long").alias("clip_idx"), F.lit(False).alias("gap"), F.lit(False).alias("synthetic_gap"), F.lit(False).alias("remove_video"), F.lit(True).alias("enabled"))
    return shown.unionByName(whole, allowMissingColumns=True)


def coalesce_clips(clips: DataFrame, tol_us: int = 40_000) -> DataFrame:
    """Neighbours in timeline order whose ranges meet within tol_us, as one: item_id, run_idx, from_us, to_us, gap, n_clips.

    A clip joins if its start is within tol_us of the largest end of the run so far; gap clips never join. The running
    end depends on the decisions before it, so each item's clips are folded in order.
    """
    one = F.struct("clip_idx", "from_us", "to_us", "gap")
    listed = clips.groupBy(ITEM).agg(F.array_sort(F.collect_list(one)).alias("_clips"))
    run = lambda c: F.struct(c["from_us"].alias("from_us"), c["to_us"].alias("to_us"), c["gap"].alias("gap"), F.lit(1).cast("long").alias("n_clips"))

    def step(done: Column, clip: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & ~clip["gap"] & ~last["gap"] & (F.abs(last["to_us"] - clip["from_us"]) <= tol_us)
        grown = F.struct(last["from_us"].alias("from_us"), F.greatest(last["to_us"], clip["to_us"]).alias("to_us"), last["gap"].alias("gap"), (last["n_clips"] + 1).alias("n_clips"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(run(clip))))

    empty = F.expr("cast(array() as array<struct<from_us:bigint,to_us:bigint,gap:boolean,n_clips:bigint>>)")
    runs = listed.select(ITEM, F.posexplode(F.aggregate("_clips", empty, step)).alias("_at", "r"))
    return runs.select(ITEM, (F.col("_at") + 1).cast("long").alias("run_idx"), "r.from_us", "r.to_us", "r.gap", "r.n_clips")


def edit_plan(clips: DataFrame) -> DataFrame:
    """Each clip's place on the edited timeline, its type and the length of the whole."""
    order = Window.partitionBy(ITEM).orderBy("clip_idx")
    length = F.col("to_us") - F.col("from_us")
    end = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return clips.select(
        ITEM, "clip_idx", "sentence_id", F.when(F.col("gap") & ~F.col("remove_video"), "gap").otherwise("source").alias("type"),
        F.col("from_us").alias("source_start_us"), F.col("to_us").alias("source_end_us"), (end - length).alias("timeline_start_us"), end.alias("timeline_end_us"),
        "enabled", F.sum(length).over(Window.partitionBy(ITEM)).alias("edited_us"),
    )


def timeline_to_source(points: DataFrame, clips: DataFrame, point: str = "at_us") -> DataFrame:
    """points with source_us: the source time that is shown there; a gap shows its start, after the end the last clip's end."""
    plan = edit_plan(clips)
    gap = F.col("type") == "gap"
    steps = plan.select(ITEM, F.col("timeline_start_us").alias("at_us"), F.col("source_start_us").alias("_start"), F.col("source_end_us").alias("_end"), F.col("timeline_start_us").alias("_from"), gap.alias("_gap"), F.col("clip_idx").alias("_idx"))
    # At the border of two clips the earlier one counts, so a clip begins just after its start; the first begins at it.
    left = points.withColumns({"_is_point": F.lit(1), "_at": F.col(point) * 2})
    right = steps.withColumns({"_is_point": F.lit(0), "_at": F.when(F.col("_idx") == 1, -1).otherwise(F.col("at_us") * 2 + 1)}).drop("at_us", "_idx")
    every = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(ITEM).orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in ("_start", "_end", "_from", "_gap"):
        every = every.withColumn(c, F.last(c, ignorenulls=True).over(order))
    total = plan.groupBy(ITEM).agg(F.max("timeline_end_us").alias("_total"), F.max_by("source_end_us", "clip_idx").alias("_last"))
    found = every.where("_is_point = 1").join(total, ITEM, "left")
    inside = _clamp(F.col("_start") + F.col(point) - F.col("_from"), F.col("_start"), F.col("_end"))
    shown = F.when(F.col(point) > F.col("_total"), F.col("_last")).when(F.col("_gap"), F.greatest(F.lit(0), F.col("_start"))).otherwise(inside)
    return found.withColumn("source_us", F.coalesce(shown, F.lit(0)).cast("long")).drop("_is_point", "_at", "_start", "_end", "_from", "_gap", "_total", "_last")


def sentence_cues(clips: DataFrame, offset_us: int = 0) -> DataFrame:
    """Cues of enabled sentences with text on the edited timeline: item_id, idx, start_us, end_us, text."""
    plan = edit_plan(clips).select(ITEM, "clip_idx", "timeline_start_us", "edited_us")
    placed = clips.join(plan, [ITEM, "clip_idx"])
    length = F.col("to_us") - F.col("from_us")
    first = _clamp(F.coalesce("start_us", "from_us"), F.col("from_us"), F.col("to_us"))
    last = _clamp(F.coalesce("end_us", "to_us"), F.col("from_us"), F.col("to_us"))
    start = F.greatest(F.lit(0), F.col("timeline_start_us") + F.greatest(F.lit(0), first - F.col("from_us")) + offset_us)
    end = F.least(F.col("edited_us"), F.col("timeline_start_us") + F.least(length, last - F.col("from_us")) + offset_us)
    shown = placed.where(F.col("enabled") & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumns({"_from": start, "_to": end}).where("_to > _from")
    order = Window.partitionBy(ITEM).orderBy("clip_idx")
    return shown.select(ITEM, F.row_number().over(order).cast("long").alias("idx"), F.col("_from").cast("long").alias("start_us"), F.col("_to").cast("long").alias("end_us"), "text")


def removal_cues(sentences: DataFrame, removed: DataFrame, media: DataFrame, offset_us: int = 0) -> DataFrame:
    """Cues of enabled sentences on a timeline that removed intervals (merged) are cut from; a cue that ends inside one is left out."""
    shown = sentences.where("enabled AND NOT remove_video AND end_us > start_us")
    first = map_points(shown, removed, "drop", "start_us").withColumnRenamed("mapped_us", "_from")
    both = map_points(first, removed, "drop", "end_us").withColumnRenamed("mapped_us", "_to").where("_from IS NOT NULL AND _to IS NOT NULL")
    gone = removed.groupBy(ITEM).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("_gone"))
    ends = media.join(gone, ITEM, "left").select(ITEM, (F.col("duration_us") - F.coalesce("_gone", F.lit(0))).alias("_limit"))
    placed = both.join(ends, ITEM).withColumns({"_from": F.greatest(F.lit(0), F.col("_from") + offset_us), "_to": F.least(F.col("_limit"), F.col("_to") + offset_us)}).where("_to > _from")
    order = Window.partitionBy(ITEM).orderBy("timeline_order", "start_us", "sentence_id")
    return placed.select(ITEM, F.row_number().over(order).cast("long").alias("idx"), F.col("_from").cast("long").alias("start_us"), F.col("_to").cast("long").alias("end_us"), "text")


def title_cues(titles: DataFrame, media: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Cues of enabled title clips, clamped to the item, or mapped past removed intervals."""
    shown = titles.where("enabled").join(media.select(ITEM, "duration_us"), ITEM)
    if removed is None:
        placed = shown.withColumns({"_from": _clamp(F.col("start_us"), F.lit(0), F.col("duration_us")), "_to": _clamp(F.col("end_us"), F.lit(0), F.col("duration_us"))}).where("_to > _from")
    else:
        first = map_points(shown, removed, "drop", "start_us").withColumnRenamed("mapped_us", "_from")
        placed = map_points(first, removed, "drop", "end_us").withColumnRenamed("mapped_us", "_to").where("_to > _from")
        placed = placed.withColumns({"_from": F.greatest(F.lit(0), F.col("_from")), "_to": F.least("duration_us", "_to")})
    order = Window.partitionBy(ITEM).orderBy("start_us", "end_us", "title_id")
    return placed.select(ITEM, F.row_number().over(order).cast("long").alias("idx"), F.col("_from").cast("long").alias("start_us"), F.col("_to").cast("long").alias("end_us"), "text")


def fill_clip_gaps(sentences: DataFrame, media: DataFrame) -> DataFrame:
    """Clips without holes: the first starts at 0, each ends no earlier than the next starts, the last at the item's end."""
    order = Window.partitionBy(ITEM).orderBy("start_us", "end_us", "sentence_id")
    placed = sentences.join(media.select(ITEM, "duration_us"), ITEM).withColumns({"_n": F.row_number().over(order), "_next": F.lead("start_us").over(order)})
    first = F.when(F.col("_n") == 1, 0).otherwise(F.coalesce("clip_start_us", "start_us")).cast("long")
    last = F.greatest(F.coalesce("clip_end_us", "end_us"), F.coalesce("_next", "duration_us"))
    return placed.withColumns({"clip_start_us": first, "clip_end_us": last}).drop("_n", "_next", "duration_us")
