"""Interval algebra on timelines, in microseconds, within item_id.

intervals: item_id, start_us, end_us. media: item_id, duration_us, one row for each item.
Everything is a window over one item or an equality join on it; a range alone never joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "item_id"


def _ordered(*more: str) -> Window:
    return Window.partitionBy(ITEM).orderBy("start_us", "end_us", *more)


def _clipped(df: DataFrame, media: DataFrame) -> DataFrame:
    inside = df.join(media.select(ITEM, "duration_us"), ITEM)
    return inside.withColumns({"start_us": F.greatest("start_us", F.lit(0)), "end_us": F.least("end_us", "duration_us")})


def pad_intervals(df: DataFrame, media: DataFrame, padding_us: int, least_us: int = 50_000) -> DataFrame:
    """Shrink each interval by the padding at both ends, clip it to the item, keep it if it is longer than least_us."""
    moved = df.select(ITEM, (F.col("start_us") + padding_us).alias("start_us"), (F.col("end_us") - padding_us).alias("end_us"))
    return _clipped(moved, media).where(F.col("end_us") - F.col("start_us") > least_us).select(ITEM, "start_us", "end_us")


def merge_intervals(df: DataFrame, media: DataFrame | None = None, tol_us: int = 40_000, min_us: int = 40_000) -> DataFrame:
    """Union intervals that start no later than tol_us after the end of those before; drop results shorter than min_us.

    Empty intervals are dropped first; with media, intervals are clipped to [0, duration].
    """
    some = df.where("end_us > start_us").select(ITEM, "start_us", "end_us")
    some = some if media is None else _clipped(some, media)
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_us").over(before)
    marked = some.withColumn("_new", F.when(reach.isNull() | (F.col("start_us") > reach + tol_us), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(_ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy(ITEM, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return joined.where(F.col("end_us") - F.col("start_us") >= min_us).select(ITEM, "start_us", "end_us")


def complement_intervals(removed: DataFrame, media: DataFrame, min_gap_us: int = 40_000) -> DataFrame:
    """The gaps of more than min_gap_us that removed intervals leave of each item; an item without one is kept whole.

    Shorter gaps, slivers, vanish from both sides.
    """
    # An item's end is one more row after its intervals, so one window finds all gaps, and nothing is joined.
    ends = media.select(ITEM, F.lit(True).alias("_end"), F.col("duration_us").alias("start_us"), F.lit(None).cast("long").alias("end_us"))
    rows = removed.select(ITEM, F.lit(False).alias("_end"), "start_us", "end_us").unionByName(ends)
    order = Window.partitionBy(ITEM).orderBy("_end", "start_us", "end_us")
    cursor = F.greatest(F.lit(0), F.coalesce(F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_from", cursor).withColumn("_gap", F.col("start_us") - F.col("_from") > min_gap_us)
    none = F.col("_end") & (F.count_if("_gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0)
    kept = rows.withColumn("_whole", none).where("_gap OR _whole")
    return kept.select(ITEM, F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("_from")).cast("long").alias("start_us"), F.col("start_us").alias("end_us"))


def subtract_intervals(a: DataFrame, b: DataFrame, min_us: int = 40_000) -> DataFrame:
    """What of the intervals a no interval of b covers, as pieces of at least min_us; a's intervals mustn't overlap.

    A sweep over the ends of both: linear in the ends, without a range join.
    """
    ends = lambda da, db: F.array(*[F.struct(F.col(c).alias("at"), F.lit(s * da).alias("da"), F.lit(s * db).alias("db")) for c, s in (("start_us", 1), ("end_us", -1))])
    edges = a.where("end_us > start_us").select(ITEM, F.inline(ends(1, 0))).union(b.where("end_us > start_us").select(ITEM, F.inline(ends(0, 1))))
    # No two ends of an item meet often, so they are dealt by item at once, which serves all that follows.
    edges = edges.repartition(F.col(ITEM))
    points = edges.groupBy(ITEM, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(ITEM).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = points.withColumns({"_a": F.sum("da").over(so_far), "_b": F.sum("db").over(so_far), "_next": F.lead("at").over(order), "_starts": F.col("da") > 0})
    open_ = state.where("_a > 0 AND _b = 0 AND _next > at").select(ITEM, F.col("at").alias("start_us"), F.col("_next").alias("end_us"), "_starts")
    # Stretches that meet are one piece, unless another interval of a starts there.
    before = F.lag("end_us").over(Window.partitionBy(ITEM).orderBy("start_us"))
    marked = open_.withColumn("_new", F.when((before == F.col("start_us")) & ~F.col("_starts"), 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(Window.partitionBy(ITEM).orderBy("start_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy(ITEM, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return joined.where(F.col("end_us") - F.col("start_us") >= min_us).select(ITEM, "start_us", "end_us")


def _as_of(points: DataFrame, steps: DataFrame, carried: list[str], point: str) -> DataFrame:
    """points with the carried columns of the last step at or before them; steps have `at`."""
    left = points.withColumn("_is_point", F.lit(1)).withColumn("_at", F.col(point))
    right = steps.withColumn("_is_point", F.lit(0)).withColumn("_at", F.col("at")).drop("at")
    every = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(ITEM).orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in carried:
        every = every.withColumn(c, F.last(c, ignorenulls=True).over(order))
    return every.where("_is_point = 1").drop("_is_point", "_at")


def keep_steps(keeps: DataFrame) -> DataFrame:
    """Kept intervals with what the cut timeline holds before each: _before."""
    lengths = F.sum(F.col("end_us") - F.col("start_us")).over(_ordered().rowsBetween(Window.unboundedPreceding, -1))
    return keeps.select(ITEM, "start_us", "end_us").withColumn("_before", F.coalesce(lengths, F.lit(0)))


def map_points(points: DataFrame, intervals: DataFrame, policy: str = "snap", point: str = "at_us") -> DataFrame:
    """points with mapped_us, their place on the cut timeline.

    snap: intervals are what is kept; a point in a hole goes to the cut, one after all goes to the end. An item without
    kept intervals maps to 0. drop: intervals are what is removed, merged; a point in [start, end) of one maps to null.
    """
    if policy == "snap":
        steps = keep_steps(intervals).select(ITEM, F.col("start_us").alias("at"), F.col("start_us").alias("_start"), F.col("end_us").alias("_end"), "_before")
        # At the very end of an interval the interval itself counts, not the one that starts there.
        inclusive = F.col("_start").isNotNull()
        found = _as_of(points, steps, ["_start", "_end", "_before"], point)
        inside = F.col("_before") + F.least(F.col(point), F.col("_end")) - F.col("_start")
        return found.withColumn("mapped_us", F.when(inclusive, inside).otherwise(0).cast("long")).drop("_start", "_end", "_before")
    gone = F.sum(F.col("end_us") - F.col("start_us")).over(_ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = intervals.select(ITEM, "start_us", "end_us").withColumn("_gone", gone)
    steps = steps.select(ITEM, F.col("start_us").alias("at"), F.col("end_us").alias("_end"), "_gone")
    found = _as_of(points, steps, ["_end", "_gone"], point)
    mapped = F.when(F.col("_end").isNull(), F.col(point)).when(F.col(point) >= F.col("_end"), F.col(point) - F.col("_gone"))
    return found.withColumn("mapped_us", mapped.cast("long")).drop("_end", "_gone")


def map_tokens(tokens: DataFrame, keeps: DataFrame) -> DataFrame:
    """Tokens on the cut timeline: those that overlap what is kept, from their first to their last overlap.

    keeps don't overlap; pos numbers an item's tokens. The last kept intervals that begin by a token's start, and before its end, are found by
    two windows over one shuffle, so no token meets many intervals. source_start_us and source_end_us keep the old times; a token that would
    not last gets 40 to 300 ms of its length.
    """
    steps = keep_steps(keeps).where("end_us > start_us").select(ITEM, F.lit(0).alias("_is_token"), F.struct(F.col("start_us").alias("from"), F.col("end_us").alias("to"), F.col("_before").alias("before")).alias("_step"), F.col("start_us").alias("_first"), F.col("start_us").alias("_last"))
    left = tokens.withColumns({"_is_token": F.lit(1), "_first": F.col("start_us"), "_last": F.col("end_us") - 1})
    every = left.unionByName(steps, allowMissingColumns=True)
    for name, at in (("_a", "_first"), ("_b", "_last")):
        order = Window.partitionBy(ITEM).orderBy(at, "_is_token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = every.withColumn(name, F.last("_step", ignorenulls=True).over(order))
    # The intervals lie end to end on the cut timeline: a start in a hole goes to where the next one begins.
    found = every.where("_is_token = 1 AND end_us > start_us AND _b.to > start_us")
    first = F.coalesce(F.col("_a.before") + F.least("start_us", "_a.to") - F.col("_a.from"), F.lit(0)).cast("long")
    last = (F.col("_b.before") + F.least("end_us", "_b.to") - F.col("_b.from")).cast("long")
    found = found.withColumns({"_from": first, "_to": last})
    length = F.col("end_us") - F.col("start_us")
    to = F.when(F.col("_to") <= F.col("_from"), F.col("_from") + F.greatest(F.lit(40_000), F.least(F.lit(300_000), length))).otherwise(F.col("_to"))
    moved = found.withColumns({"source_start_us": F.col("start_us"), "source_end_us": F.col("end_us")})
    return moved.withColumns({"end_us": to, "start_us": F.col("_from")}).drop("_from", "_to", "_is_token", "_step", "_first", "_last", "_a", "_b")


def map_segments(segments: DataFrame, keeps: DataFrame) -> DataFrame:
    """Whole segments on the cut timeline; one that would not last gets 200 to 600 ms of its length. Columns: as segments."""
    length = F.col("end_us") - F.col("start_us")
    first = map_points(segments, keeps, "snap", "start_us").withColumnRenamed("mapped_us", "_from")
    both = map_points(first, keeps, "snap", "end_us").withColumnRenamed("mapped_us", "_to")
    to = F.when(F.col("_to") <= F.col("_from"), F.col("_from") + F.least(F.lit(600_000), F.greatest(F.lit(200_000), length))).otherwise(F.col("_to"))
    return both.withColumns({"end_us": to, "start_us": F.col("_from")}).drop("_from", "_to")


def detect_silence(levels: DataFrame, threshold: Column, min_us: int) -> DataFrame:
    """Runs of levels below the threshold that last at least min_us, from the first low sample to the one after the last.

    levels: item_id, at_us and value; a run that goes on to the end of the item ends at its last sample.
    """
    order = Window.partitionBy(ITEM).orderBy("at_us")
    low = levels.withColumns({"_low": F.col("value") < threshold, "_next": F.coalesce(F.lead("at_us").over(order), F.col("at_us"))})
    changes = low.withColumn("_new", F.when(F.lag("_low").over(order) == F.col("_low"), 0).otherwise(1))
    runs = changes.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = runs.where("_low").groupBy(ITEM, "_run").agg(F.min("at_us").alias("start_us"), F.max("_next").alias("end_us"))
    return found.where(F.col("end_us") - F.col("start_us") >= min_us).select(ITEM, "start_us", "end_us")


def downsample_levels(levels: DataFrame, bars: int = 320) -> DataFrame:
    """At most so many bars of each item: root mean square of equal chunks over 32768, times 4, at most 1, to 4 places.

    levels: item_id, sample_idx (from 0) and value.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(ITEM))
    chunk = F.greatest(F.lit(1), F.ceil(n / F.lit(bars)))
    by = levels.withColumn("bar", F.floor(F.col("sample_idx") / chunk).cast("long"))
    level = F.sqrt(F.avg(F.col("value") * F.col("value"))) / 32768 * 4
    return by.groupBy(ITEM, "bar").agg(F.round(F.least(F.lit(1.0), level), 4).alias("level"))
