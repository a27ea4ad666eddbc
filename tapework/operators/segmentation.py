"""Caption segmentation: chunks, line options and costs, lines of least cost, and cues.

Widths are visual weights: half units times half the font size, plus spacing. tokens: item_id, pos, token_id, text, start_us,
end_us. breaks: item_id, pos and kind (preferred, required, forbidden), as break_sets() gives them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, half_units
from .scripts import NO_TITLE, split_phrases, strip_marks

ITEM = "item_id"
PAUSE_US = 250_000
SOFT_PAUSE_US = 180_000
SIGNS = "。！？!?；;，,：:"
NO_BLANKS = str.maketrans("", "", BLANKS)


@dataclass(frozen=True)
class Layout:
    """Widths that a line may have, in pixels, and those of a half unit and of the spacing after a character."""

    available: float
    half_width: float
    spacing: float = 0.0

    @property
    def comfort(self) -> float:
        return self.available * 0.80

    @property
    def hard(self) -> float:
        return self.available * 0.95


def layout_context(styles: DataFrame, width: int, height: int) -> DataFrame:
    """styles with available, comfort, hard and font_size for a canvas. styles: scale, font_size, margin_x, position_x, letter_spacing."""
    scale = F.greatest(F.lit(0.2), F.col("scale") / 100)
    size = F.greatest(F.lit(10.0), F.round(F.col("font_size") * height / 1920 * scale))
    margin = F.greatest(F.lit(0.0), F.col("margin_x") * width / 1080)
    center = F.lit(width / 2) + F.col("position_x") * width / 1080
    room = F.greatest(F.lit(80.0), 2 * F.least(F.greatest(F.lit(0.0), center - margin), F.greatest(F.lit(0.0), F.lit(float(width)) - margin - center)))
    out = styles.withColumns({"font_px": size, "available": room, "spacing": F.col("letter_spacing") * width / 1080})
    return out.withColumns({"comfort": F.col("available") * 0.80, "hard": F.col("available") * 0.95})


def measured(tokens: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """tokens with half units, pause after, and the flags preferred, required and forbidden."""
    kinds = ["preferred", "required", "forbidden"]
    if breaks is None:
        tokens = tokens.withColumns({k: F.lit(False) for k in kinds})
    else:
        # Tokens and breaks are dealt once, by item, which serves this window and all that follow; a join would deal both by item and place.
        marks = breaks.select(ITEM, "pos", *[(F.col("kind") == k).alias(k) for k in kinds])
        both = tokens.withColumn("_token", F.lit(True)).unionByName(marks, allowMissingColumns=True).repartition(F.col(ITEM))
        flags = {k: F.coalesce(F.max(k).over(Window.partitionBy(ITEM, "pos")), F.lit(False)) for k in kinds}
        tokens = both.withColumns(flags).where("_token").drop("_token").hint("merge")
    return _in_order(tokens, ITEM)


def _in_order(tokens: DataFrame, *by: str) -> DataFrame:
    """tokens with their half units and what the next token of the same key shows."""
    order = Window.partitionBy(*by).orderBy("pos")
    units = F.when(F.trim("text") == "", 0).otherwise(half_units(F.col("text"))).cast("long")
    out = tokens.withColumns({"units": units, "chars": F.length("text").cast("long"), "pause_us": F.greatest(F.lit(0), F.coalesce(F.lead("start_us").over(order) - F.col("end_us"), F.lit(0))), "_next": F.lead("text").over(order)})
    latin = F.col("text").rlike("^[A-Za-z0-9]$") & F.coalesce(F.col("_next").rlike("^[A-Za-z0-9]"), F.lit(False))
    return out.withColumns({"latin": latin, "last": F.col("_next").isNull(), "signed": F.col("text").rlike("[。！？!?；;，,：:]$")}).drop("_next")


def _fold_chunks(tokens: DataFrame, limit: int, cut_here: Column, prefer_here: Column | None, from_half: int) -> DataFrame:
    """item_id, chunk, first_pos, last_pos: chunks of at most `limit` tokens.

    A chunk that doesn't reach the end is cut after its last token, from place from_half on, where cut_here holds; failing
    that where prefer_here holds; failing that at the limit. Each cut depends on the one before, so an item's tokens are folded
    once, keeping for the open chunk the last place of each kind.
    """
    prefer = F.lit(False) if prefer_here is None else prefer_here
    one = F.struct("pos", cut_here.alias("cut"), prefer.alias("prefer"))
    listed = tokens.groupBy(ITEM).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    at = lambda n: F.lit(n).cast("long")
    # Which places a chunk may end at only shows once `limit` tokens are read, so the state holds the chunk's candidates.
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("ends"), at(0).alias("first"), F.expr("cast(array() as array<bigint>)").alias("cuts"), F.expr("cast(array() as array<bigint>)").alias("prefers"))

    def step(s: Column, x: Column) -> Column:
        full = x["pos"] - s["first"] == limit  # x opens the next chunk or lies in it: the open one has its `limit` tokens
        late = lambda xs: F.filter(xs, lambda p: p >= s["first"] + from_half)
        end = F.coalesce(F.try_element_at(late(s["cuts"]), F.lit(-1)), F.try_element_at(late(s["prefers"]), F.lit(-1)), x["pos"] - 1)
        first = F.when(full, end + 1).otherwise(s["first"])
        cuts, prefers = F.filter(s["cuts"], lambda p: p >= first), F.filter(s["prefers"], lambda p: p >= first)
        return F.struct(
            F.when(full, F.concat(s["ends"], F.array(end))).otherwise(s["ends"]).alias("ends"), first.alias("first"),
            F.when(x["cut"], F.concat(cuts, F.array(x["pos"]))).otherwise(cuts).alias("cuts"),
            F.when(x["prefer"], F.concat(prefers, F.array(x["pos"]))).otherwise(prefers).alias("prefers"),
        )

    ends = listed.select(ITEM, F.element_at("_t", -1)["pos"].alias("_last"), F.aggregate("_t", start, step)["ends"].alias("_e"))
    ends = ends.select(ITEM, F.posexplode(F.concat("_e", F.array("_last"))).alias("_n", "last_pos"))
    first = F.coalesce(F.lag("last_pos").over(Window.partitionBy(ITEM).orderBy("_n")) + 1, F.lit(0))
    return ends.select(ITEM, (F.col("_n") + 1).cast("long").alias("chunk"), first.cast("long").alias("first_pos"), "last_pos")


def chunk_by_pause(tokens: DataFrame, limit: int = 100) -> DataFrame:
    """Chunks of at most limit tokens, cut after the last pause of 250 ms in the back half if they are cut within the text."""
    known = measured(tokens)
    return _fold_chunks(known, limit, F.col("pause_us") >= PAUSE_US, None, max(1, limit // 2))


def chunk_by_breaks(tokens: DataFrame, breaks: DataFrame, limit: int = 45) -> DataFrame:
    """Chunks of at most limit tokens, cut at the last required break in the back half, else at a preferred one or a pause."""
    known = measured(tokens, breaks)
    return _fold_chunks(known, limit, F.col("required"), F.col("preferred") | (F.col("pause_us") >= PAUSE_US), max(1, limit // 2))


def overlapping_chunks(tokens: DataFrame, window_us: int = 90_000_000, overlap_us: int = 10_000_000) -> DataFrame:
    """tokens with chunk: each token once for every window that its start lies in; windows start window - overlap apart."""
    step = window_us - overlap_us
    last = F.floor(F.col("start_us") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("start_us") - window_us) / step) + 1)
    return tokens.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


#: Tokens that are worked on at once: whole items, and of them spans side by side.
ITEM_TOKENS, SPAN_TOKENS = 200_000, 65_536


def _item_codes(tokens: pa.Table) -> np.ndarray:
    return tokens[ITEM].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _by_items(known: DataFrame, columns: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over tables of whole items, in order of pos. known comes from measured(), so that an item's tokens are in one partition already."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ITEM_TOKENS:
                continue
            tokens = pa.Table.from_batches(held)
            code = _item_codes(tokens)
            full = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0  # the last item may go on
            if full:
                yield from run(tokens.slice(0, full))
                held = tokens.slice(full).combine_chunks().to_batches()
        if sum(map(len, held)):
            yield from run(pa.Table.from_batches(held))

    dealt = known.select(ITEM, *columns).sortWithinPartitions(ITEM, "pos")
    return dealt.mapInArrow(whole, f"{ITEM} {known.schema[ITEM].dataType.simpleString()}, {schema}")


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _to_tenth(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10 + 0.5) / 10


def _rest(t: dict[str, np.ndarray], final: np.ndarray) -> np.ndarray:
    """What ending a line at a token costs, whatever the line; nothing at an item's end."""
    rest = np.where(t["pause_us"] >= PAUSE_US, -np.minimum(5.0, t["pause_us"] / 1_000_000 * 8), np.where(t["pause_us"] < SOFT_PAUSE_US, 1.2, 0.0))
    rest = rest - np.where(t["signed"], 3.0, 0.0) - np.where(t["preferred"], 4.0, 0.0) + np.where(t["latin"], 1000.0, 0.0)
    return np.where(final, 0.0, rest)


def _options(layout: Layout, at_once: int = 4_096):
    """Options of whole items; starts are taken some at a time, so that their candidates stay few. Without final, which marks items' ends, there is one item."""
    limit = layout.hard + 0.5

    def run(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, units, chars = len(t["pos"]), _sums(t["units"]), _sums(t["chars"])
        final = t.get("final", np.arange(n) == n - 1)
        width = lambda s, e: (units[e + 1] - units[s]) * layout.half_width + (chars[e + 1] - chars[s] - 1) * layout.spacing
        # The last end before a line would pass a required break or the item, and then the last before it would be too wide.
        marks = np.flatnonzero(t["required"] | final)
        stop = marks[np.searchsorted(marks, np.arange(n))]
        if layout.spacing >= 0:
            so_far = units * layout.half_width + chars * layout.spacing
            stop = np.minimum(stop, np.searchsorted(so_far, so_far[:-1] + layout.spacing + limit + 1e-6, side="right") - 2)
        else:  # a longer line can be less wide
            for s in range(n):
                over = np.flatnonzero(width(s, np.arange(s, stop[s] + 1)) > limit)
                stop[s] = s + over[0] - 1 if len(over) else stop[s]
        found = []
        for first in range(0, n, at_once):
            starts = np.arange(first, min(n, first + at_once))
            counts = np.maximum(0, stop[starts] - starts + 1)
            s = np.repeat(starts, counts)
            e = s + np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
            fits = (width(s, e) <= limit) & (~t["forbidden"][e] | final[e])
            s, e = s[fits], e[fits]
            w = width(s, e)
            natural = t["preferred"][e] | t["required"][e] | (~final[e] & (t["pause_us"][e] >= SOFT_PAUSE_US))
            order = np.lexsort((e, np.abs(_to_tenth(w) - layout.comfort), s))
            heads = np.searchsorted(s, s)  # s ascends, and so it does in the order
            near = np.empty(len(s), np.int64)
            near[order] = np.arange(len(s)) - heads
            kept = (near < 4) | np.append(s[1:] != s[:-1], True)[: len(s)] | natural
            alone = np.setdiff1d(starts, s[kept])
            s, e, natural = np.concatenate([s[kept], alone]), np.concatenate([e[kept], alone]), np.concatenate([natural[kept], np.zeros(len(alone), bool)])
            order = np.argsort(s, kind="stable")
            s, e = s[order], e[order]
            found.append((s, e, t["pos"][s], t["pos"][e], width(s, e).astype(float), natural[order]))
        return dict(zip(("first", "last", "start_pos", "end_pos", "width", "natural"), map(np.concatenate, zip(*found, strict=True)), strict=True))

    return run


def _option_rows(layout: Layout, at_once: int = 16_384):
    """The options of whole items with what each costs, a row for each start."""
    options = _options(layout)

    def run(tokens: pa.Table) -> Iterator[pa.RecordBatch]:
        t = {c: tokens[c].to_numpy() for c in OPTION_COLUMNS}
        item = _item_codes(tokens)
        t["final"] = np.append(item[1:] != item[:-1], True)
        found = options(t)
        s, e, shown = found["first"], found["last"], _to_tenth(found["width"])
        ratio = shown / max(1.0, layout.comfort) - 0.82
        cost = 8 * (ratio * ratio) + np.where((e - s <= 1) & ~t["final"][e], 5.0, 0.0) + np.where(shown > layout.hard, 1000.0, 0.0) + _rest(t, t["final"])[e]
        heads = np.searchsorted(s, np.arange(len(item) + 1))
        for a in range(0, len(item), at_once):
            b = min(len(item), a + at_once)
            of = slice(heads[a], heads[b])
            ends = pa.StructArray.from_arrays([pa.array(x[of]) for x in (found["end_pos"], found["width"], found["natural"], cost)], ["end_pos", "width", "natural", "cost"])
            listed = pa.ListArray.from_arrays(pa.array((heads[a : b + 1] - heads[a]).astype(np.int32)), ends)
            yield from pa.table({ITEM: tokens[ITEM].slice(a, b - a), "start_pos": pa.array(t["pos"][a:b]), "ends": listed}).combine_chunks().to_batches()

    return run


OPTION_COLUMNS = ["pos", "units", "chars", "preferred", "required", "forbidden", "pause_us", "signed", "latin"]


def line_ends(tokens: DataFrame, breaks: DataFrame, layout: Layout) -> DataFrame:
    """The options of line_options() and line_cost() as one row for each token: item_id, start_pos and ends (end_pos, width, natural and cost, unrounded)."""
    return _by_items(measured(tokens, breaks), OPTION_COLUMNS, _option_rows(layout), "start_pos long, ends array<struct<end_pos:bigint,width:double,natural:boolean,cost:double>>")


def _named(options: DataFrame, layout: Layout) -> DataFrame:
    return options.withColumns({"width": F.round("width", 1), "fill": F.round(F.col("width") / max(1.0, layout.comfort), 3), "option_id": F.format_string("o%03d-%03d", "start_pos", F.col("end_pos") + 1)})


def line_options(tokens: DataFrame, breaks: DataFrame, layout: Layout) -> DataFrame:
    """Lines that may start at each token: item_id, start_pos, end_pos, width, fill, natural, and the option's id.

    Ends go on until a line would be over the hard width or a required break is passed, however many tokens that are;
    forbidden ends are left out but for the last. Of them, the four nearest to the comfortable width, the longest and all
    natural ones are kept; a token without an option stands alone.
    """
    return _named(line_ends(tokens, breaks, layout).select(ITEM, "start_pos", F.inline("ends")).drop("cost"), layout)


def line_cost(tokens: DataFrame, breaks: DataFrame, layout: Layout) -> DataFrame:
    """line_options() with cost, to 6 places."""
    return _named(line_ends(tokens, breaks, layout).select(ITEM, "start_pos", F.inline("ends")), layout).withColumn("cost", F.round("cost", 6))


def _span_lines(layout: Layout, t: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of least cost of spans of tokens of t, at first and of so many tokens, as the tokens that they begin and end at.

    The spans go through their tokens side by side. At a span's i-th token column w of the state is the line that would start w tokens
    before: whether it may still end here or later, and the least cost of all lines before it.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    rows, most = len(size), int(size[0])
    at = np.minimum(first[:, None] + np.arange(most), first[:, None] + size[:, None] - 1)
    sums = {c: np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(t[c][at], axis=1)], axis=1) for c in ("units", "chars")}
    allowed, rest, final = t["allowed"][at], t["rest"][at], t["final"][at]
    start_of = np.zeros((rows, most), np.int64)
    open_, spent = np.zeros((rows, 8), bool), np.zeros((rows, 8))
    open_[:, 0] = True
    for i in range(most):
        m = int(np.searchsorted(-size, -i))  # spans of more than i tokens
        if open_[:m, -1].any():
            open_, spent = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (open_, spent))
        w = np.arange(min(open_.shape[1], i + 1))
        units, chars = (x[:m, i + 1, None] - x[:m, i - w] for x in (sums["units"], sums["chars"]))
        width = units * layout.half_width + (chars - 1) * layout.spacing
        ratio = width / max(1.0, layout.comfort) - 0.82
        cost = 8 * (ratio * ratio) + np.where((w <= 1) & ~final[:m, i, None], 5.0, 0.0) + np.where(width > layout.hard, 1000.0, 0.0)
        total = np.where(open_[:m, : len(w)], spent[:m, : len(w)] + (cost + rest[:m, i, None]), np.inf)
        best = len(w) - 1 - total[:, ::-1].argmin(axis=1)  # of equal ones the earliest start
        ends = allowed[:m, i]
        start_of[:m, i] = i - best
        # A start is closed once a line from it that may end here is over the hard width, unless the line is one token.
        alive = open_[:m, : len(w)] & ((width <= layout.hard) | (w == 0) | ~ends[:, None])
        open_[:m, 1 : len(w) + 1] = alive[:, : open_.shape[1] - 1]
        spent[:m, 1 : len(w) + 1] = spent[:m, : len(w)][:, : open_.shape[1] - 1].copy()
        open_[:m, 0], spent[:m, 0] = ends, total[np.arange(m), best]
    starts, ends, row, end = [], [], np.arange(rows), size - 1
    while len(row):
        start = start_of[row, end]
        starts.append(first[row] + start)
        ends.append(first[row] + end)
        row, end = row[start > 0], start[start > 0] - 1
    return np.concatenate(starts), np.concatenate(ends)


def _segments(layout: Layout, t: dict[str, np.ndarray], item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that lines of whole items begin and end at, in order. item: a number for each token's item, equal ones side by side."""
    t["final"] = np.append(item[1:] != item[:-1], True)
    t["rest"] = _rest(t, t["final"])
    last = t["required"] | t["final"]
    t["allowed"] = last | ~t["forbidden"]
    stop = np.flatnonzero(last) + 1
    first = np.concatenate([[0], stop[:-1]])
    size = stop - first
    parts = []
    # Spans of about a length go side by side, so many that their state stays small.
    of_length = np.floor(np.log2(size)).astype(np.int64)
    for length in np.unique(of_length):
        which = np.flatnonzero(of_length == length)
        step = max(1, SPAN_TOKENS >> int(length))
        parts += [_span_lines(layout, t, first[w], size[w]) for w in (which[k : k + step] for k in range(0, len(which), step))]
    start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(start)
    return start[order], end[order]


def _lines(layout: Layout):
    def run(tokens: pa.Table) -> Iterator[pa.RecordBatch]:
        t = {c: tokens[c].to_numpy() for c in OPTION_COLUMNS}
        item = _item_codes(tokens)
        start, end = _segments(layout, t, item)
        found = pa.table({ITEM: tokens[ITEM].take(pa.array(start)), "first_pos": pa.array(t["pos"][start]), "last_pos": pa.array(t["pos"][end]), "line": pa.array(_line_numbers(item[start]))})
        yield from found.combine_chunks().to_batches()

    return run


def _line_numbers(of: np.ndarray) -> np.ndarray:
    """The numbers, from 1 within an item, of lines in order. of: their items' numbers."""
    head = np.flatnonzero(np.diff(of, prepend=-1))
    return np.arange(len(of)) - np.repeat(head, np.diff(np.append(head, len(of)))) + 1


def _lines_of_tokens(layout: Layout, columns: list[str]):
    """Lines with the columns of their item, and _l, their tokens' _t in order."""

    def run(tokens: pa.Table) -> Iterator[pa.RecordBatch]:
        item = _item_codes(tokens)
        start, _ = _segments(layout, {c: tokens[c].to_numpy() for c in OPTION_COLUMNS}, item)
        members = pa.ListArray.from_arrays(pa.array(np.append(start, len(tokens)).astype(np.int32)), tokens["_t"].combine_chunks())
        found = pa.table({c: tokens[c].take(pa.array(start)) for c in (ITEM, *columns)} | {"line": pa.array(_line_numbers(item[start])), "_l": members})
        yield from found.combine_chunks().to_batches()

    return run


def segment_lines(tokens: DataFrame, breaks: DataFrame, layout: Layout) -> DataFrame:
    """Each item in lines of least total cost: item_id, line, first_pos, last_pos. No line passes a required break.

    Candidates from a start end at every allowed token up to and including the first allowed one over the hard width.
    Of equal costs the earliest start wins. Spans between required breaks are the units of work: they don't depend on each other but
    for the pause and signs at their ends, so spans of many items are segmented side by side, as arrays.
    """
    return _by_items(measured(tokens, breaks), OPTION_COLUMNS, _lines(layout), "first_pos long, last_pos long, line long")


def validate_layout(lines: DataFrame, tokens: DataFrame, breaks: DataFrame, layout: Layout) -> DataFrame:
    """Items whose lines (first_pos, last_pos) break a rule: item_id and errors.

    Lines have to cover the tokens once and in order, be at most half a pixel over the hard width unless they are one token,
    end on every required break and never on a forbidden one but at the end.
    """
    known = measured(tokens, breaks)
    inside = lines.select(ITEM, "line", "first_pos", "last_pos", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    met = known.join(inside, [ITEM, "pos"], "full")
    by_token = met.groupBy(ITEM, "pos").agg(F.count("line").alias("_n"), F.max("units").alias("_units"), F.max(F.col("required") & (F.col("pos") != F.col("last_pos")) & ~F.col("last")).alias("_through"), F.max(F.col("forbidden") & (F.col("pos") == F.col("last_pos")) & ~F.col("last")).alias("_on"))
    cover = by_token.groupBy(ITEM).agg(F.max((F.col("_n") != 1) | F.col("_units").isNull()).alias("cover"), F.max("_through").alias("required"), F.max("_on").alias("forbidden"))
    width = F.sum("units") * layout.half_width + (F.sum("chars") - 1) * layout.spacing
    wide = met.where("line IS NOT NULL").groupBy(ITEM, "line").agg(((width > layout.hard + 0.5) & (F.count(F.lit(1)) > 1)).alias("_w")).groupBy(ITEM).agg(F.max("_w").alias("wide"))
    out = cover.join(wide, ITEM, "left")
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(c)) for c in ("cover", "required", "forbidden", "wide")]))
    return out.select(ITEM, F.array_join(errors, ",").alias("errors")).where("errors <> ''")


def wrap_titles(df: DataFrame, title: str, most_units: int = 10, most_lines: int = 3) -> DataFrame:
    """df with lines: a title as a cover shows it, wrapped to at most so many visual units a line and so many lines, own line feeds kept.

    A line takes words, signs and blanks as long as its units, of which an ASCII sign is half of one, round to no more than most_units; halves
    round to the even number. A word that is longer alone has a line of its own. A blank title is NO_TITLE.
    """
    most = 2 * most_units + (most_units % 2 == 0)  # in half units
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("units"))
    words = lambda line: F.regexp_extract_all(F.trim(line), F.lit(r"[A-Za-z0-9_-]+|\s+|."), F.lit(0))
    weigh = lambda x: F.when(F.trim(x) == "", 0).otherwise(half_units(x)).cast("long")

    def step(s: Column, x: Column) -> Column:
        over = (s["now"] != "") & (s["units"] + weigh(x) > most)
        return F.struct(F.when(over, F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"]).alias("done"), F.when(over, F.ltrim(x)).otherwise(F.concat(s["now"], x)).alias("now"), F.when(over, weigh(x)).otherwise(s["units"] + weigh(x)).alias("units"))

    wrap = lambda line: F.aggregate(words(line), start, step, lambda s: F.concat(s["done"], F.array(F.trim(s["now"]))))
    shown = F.coalesce(F.nullif(F.trim(F.col(title)), F.lit("")), F.lit(NO_TITLE))
    lines = F.filter(F.flatten(F.transform(F.split(shown, "\r?\n"), wrap)), lambda x: x != "")
    return df.withColumn("lines", F.array_join(F.slice(lines, 1, most_lines), "\n"))


def wrap_title_text(df: DataFrame, key: str, title: str, layout: Layout, breaks: DataFrame | None = None) -> DataFrame:
    """df with lines: each line of the title wrapped by segment_lines() to the layout, by itself; empty lines go. key: a column that names a row.

    breaks: item_id (the key, a colon and the number of the title's line, from 1), pos and kind, as for segment_lines().
    """
    source = F.split(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), "\r\n?", "\n"), "\n")
    pieces = F.transform(source, lambda x: F.regexp_extract_all(F.trim(x), F.lit(r"[A-Za-z0-9_+\-./#]+|\s+|."), F.lit(0)))
    none = F.expr("cast(array() as array<struct<line:bigint,pos:bigint,kind:string>>)")
    named = df.withColumn("_key", F.col(key).cast("string"))
    if breaks is None:
        marked = named.withColumn("_marks", none)
    else:
        part = lambda n: F.regexp_extract(ITEM, r"(?s)^(.*):([0-9]+)$", n)
        marks = breaks.select(part(1).alias("_key"), F.struct(part(2).try_cast("long").alias("line"), F.col("pos").cast("long").alias("pos"), "kind").alias("_m")).where("_m.line IS NOT NULL")
        marked = named.join(marks.groupBy("_key").agg(F.collect_list("_m").alias("_marks")).hint("merge"), "_key", "left").withColumn("_marks", F.coalesce("_marks", none))
    wrap = _title_lines(layout)
    return marked.withColumn("lines", wrap(pieces, F.col("_marks"))).select(*[F.col(f"`{c}`") for c in df.columns if c != "lines"], "lines")


def _title_lines(layout: Layout) -> Callable[..., Column]:
    """The wrapped lines of titles, from the pieces of their lines and the breaks in them, as one text each. Titles are taken some at a time."""

    def some(pieces: pa.Array, marks: pa.Array) -> list[str]:
        lines, counts = pieces.flatten(), pieces.value_lengths().to_numpy()
        sizes = lines.value_lengths().to_numpy()
        words = lines.flatten().to_pylist()
        out: list[list[str]] = [[] for _ in range(len(pieces))]
        if not words:
            return [""] * len(out)
        first_line, head = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
        blank = {w: not w.strip(" ") for w in set(words)}
        units = {w: 0 if blank[w] else max(1, sum(1 if c.isascii() else 2 for c in w.translate(NO_BLANKS))) for w in blank}
        item = np.repeat(np.arange(len(lines)), sizes)
        t = {"units": np.array([units[w] for w in words], np.int64), "chars": np.array([len(w) for w in words], np.int64), "pause_us": np.zeros(len(words), np.int64)}
        t["signed"] = np.array([w[-1] in SIGNS for w in words])
        begins = np.array([w[0].isascii() and w[0].isalnum() for w in words])
        t["latin"] = (t["chars"] == 1) & begins & np.append(begins[1:] & (item[1:] == item[:-1]), False)
        title, flat = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy()), marks.flatten()
        line, pos, kind = flat.field("line").to_numpy() - 1, flat.field("pos").to_numpy(zero_copy_only=False), np.array(flat.field("kind").to_pylist(), object)
        inside = (line >= 0) & (line < counts[title])
        title, line, pos, kind = title[inside], line[inside], pos[inside], kind[inside]
        of = first_line[title] + line
        inside = (pos >= 0) & (pos < sizes[of])
        at, kind = (head[of] + pos)[inside].astype(np.int64), kind[inside]
        for k in ("preferred", "required", "forbidden"):
            t[k] = np.zeros(len(words), bool)
            t[k][at[kind == k]] = True
        title_of = np.repeat(np.arange(len(pieces)), counts)
        for a, b in zip(*_segments(layout, t, item), strict=True):
            if text := "".join(words[a : b + 1]).strip(" "):
                out[title_of[item[a]]].append(text)
        return ["\n".join(x) for x in out]

    @F.arrow_udf("string")
    def wrap(pieces: pa.Array, marks: pa.Array) -> pa.Array:
        each = np.cumsum(_pieces_of(pieces))
        out, row = [], 0
        while row < len(pieces):
            upto = max(row + 1, int(np.searchsorted(each, (each[row - 1] if row else 0) + ITEM_TOKENS, side="right")))
            out += some(pieces.slice(row, upto - row), marks.slice(row, upto - row))
            row = upto
        return pa.array(out, pa.string())

    return wrap


def _pieces_of(pieces: pa.Array) -> np.ndarray:
    """How many pieces each title has."""
    counts, sizes = pieces.value_lengths().to_numpy(), pieces.flatten().value_lengths().to_numpy()
    upto = _sums(sizes)
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def reflow(sentences: DataFrame, tokens: DataFrame, breaks: DataFrame, layout: Layout) -> DataFrame:
    """Sentences whose runs between barriers are cut into lines anew; barriers stay as they are.

    sentences: item_id, sentence_id, timeline_order, first_pos, last_pos, edited, pending, remove_video, gap, clip_start_us,
    clip_end_us. New sentences are named by a hash of their tokens; the first and last of a run take over its clip's ends.
    """
    barrier = F.col("edited") | F.col("pending") | F.col("remove_video") | F.col("gap")
    order = Window.partitionBy(ITEM).orderBy("timeline_order")
    marked = sentences.withColumn("_bar", barrier).withColumn("_run", F.sum(F.col("_bar").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    loose = marked.where("NOT _bar")
    # Places of sentences, tokens and breaks are dealt once, by item, and meet at their places; all that follows is done where they are, up to whole lines.
    places = loose.select(ITEM, "_run", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    kinds = ["preferred", "required", "forbidden"]
    both = places.unionByName(tokens.select(ITEM, "pos", F.struct("pos", "token_id", "text", "start_us", "end_us").alias("_t")), allowMissingColumns=True)
    both = both.unionByName(breaks.select(ITEM, "pos", *[(F.col("kind") == k).alias(k) for k in kinds]), allowMissingColumns=True).repartition(F.col(ITEM))
    here = Window.partitionBy(ITEM, "pos")
    inside = both.withColumns({"_t": F.first("_t", ignorenulls=True).over(here)} | {k: F.coalesce(F.max(k).over(here), F.lit(False)) for k in kinds}).where("_run IS NOT NULL AND _t IS NOT NULL")
    # Each run is an item of its own for the segmentation.
    known = _in_order(inside.select(ITEM, "_run", "pos", "_t", *kinds, "_t.text", "_t.start_us", "_t.end_us"), ITEM, "_run")
    known = known.select(F.concat_ws(":", F.col(ITEM).cast("string"), F.col("_run").cast("string")).alias(ITEM), F.col(ITEM).alias("_of"), "_run", *OPTION_COLUMNS, "_t")
    shape = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in ("_of", "_run")) + f", line long, _l array<{known.schema['_t'].dataType.simpleString()}>"
    lines = _by_items(known, ["_of", "_run", *OPTION_COLUMNS, "_t"], _lines_of_tokens(layout, ["_of", "_run"]), shape)
    each = lambda c: F.transform("_l", lambda t: t[c])
    made = lines.select(
        F.col("_of").alias(ITEM), "_run", "line", F.concat(F.lit("r"), F.left(F.sha1(F.array_join(each("token_id"), ",")), F.lit(10))).alias("sentence_id"), F.array_join(each("text"), "").alias("text"),
        F.array_min(each("start_us")).alias("start_us"), F.array_max(each("end_us")).alias("end_us"), F.array_min(each("pos")).alias("first_pos"), F.array_max(each("pos")).alias("last_pos"),
    )
    edges = loose.groupBy(ITEM, "_run").agg(F.min("timeline_order").alias("_order"), F.min_by("clip_start_us", "timeline_order").alias("_cs"), F.max_by("clip_end_us", "timeline_order").alias("_ce"))
    run = Window.partitionBy(ITEM, "_run").orderBy("line")
    made = made.hint("merge").join(edges, [ITEM, "_run"]).withColumns({"_next": F.lead("start_us").over(run), "_n": F.row_number().over(run)})
    made = made.select(
        ITEM, "sentence_id", "first_pos", "last_pos", F.when(F.col("_n") == 1, F.col("_cs")).otherwise(F.col("start_us")).alias("clip_start_us"), F.coalesce("_next", F.greatest("_ce", "end_us")).alias("clip_end_us"),
        "text", F.col("_order").alias("_o"), F.col("line").alias("_k"),
    )
    kept = marked.where("_bar").select(ITEM, "sentence_id", "first_pos", "last_pos", "clip_start_us", "clip_end_us", F.lit(None).cast("string").alias("text"), F.col("timeline_order").alias("_o"), F.lit(0).cast("long").alias("_k"))
    every = made.unionByName(kept)
    return every.withColumn("timeline_order", F.row_number().over(Window.partitionBy(ITEM).orderBy("_o", "_k")).cast("long")).drop("_o", "_k")


def annotate_break_source(lines: DataFrame, breaks_by_source: DataFrame) -> DataFrame:
    """lines with break_source by their last token: ai_final, ai_sentence, ai_break or width. breaks_by_source: item_id, pos, source."""
    ranks = breaks_by_source.groupBy(ITEM, F.col("pos").alias("last_pos")).agg(*[F.max(F.col("source") == s).alias(f"_{s}") for s in ("ai_final", "ai_sentence", "ai_break")])
    source = F.when(F.col("_ai_final"), "ai_final").when(F.col("_ai_sentence"), "ai_sentence").when(F.col("_ai_break"), "ai_break").otherwise("width")
    return lines.join(ranks, [ITEM, "last_pos"], "left").withColumn("break_source", source).drop("_ai_final", "_ai_sentence", "_ai_break")


def cues_from_lines(lines: DataFrame, media: DataFrame, delay_us: int = 0) -> DataFrame:
    """Cues of lines with text and length: clamped to the item, at least 50 ms long, numbered from 1. lines: start_us, end_us, text."""
    some = lines.where("end_us > start_us AND trim(text) <> ''").join(media.select(ITEM, "duration_us"), ITEM)
    start = F.greatest(F.lit(0), F.least("duration_us", F.col("start_us") + delay_us)).cast("long")
    order = Window.partitionBy(ITEM).orderBy("start_us", "end_us", "text")
    out = some.withColumns({"idx": F.row_number().over(order).cast("long"), "_s": start})
    return out.select(ITEM, "idx", F.col("_s").alias("start_us"), F.greatest(F.col("_s") + 50_000, F.least("duration_us", F.col("end_us") + delay_us)).cast("long").alias("end_us"), F.trim("text").alias("text"))


def cues_from_script(scripts: DataFrame, delay_us: int = 0) -> DataFrame:
    """Cues of the phrases of a text without timings, by length. scripts: item_id, text, duration_us.

    A phrase weighs its visible characters, at least 4; none is shorter than the smaller of 800 ms and an equal share before
    all are scaled to the spoken time; the last ends with the item.
    """
    rows = split_phrases(scripts.where("duration_us > 0"))
    whole = Window.partitionBy(ITEM)
    order = whole.orderBy("phrase_idx")
    rows = rows.withColumns({"_w": F.greatest(F.lit(4), F.length(strip_marks(F.col("phrase")))), "_n": F.count(F.lit(1)).over(whole)})
    delay = F.greatest(F.lit(0), F.least(F.lit(delay_us), F.col("duration_us") - 200_000)).cast("double")
    rows = rows.withColumns({"_delay": delay, "_spoken": F.greatest(F.lit(200_000.0), F.col("duration_us") - delay)})
    rows = rows.withColumn("_d", F.greatest(F.least(F.lit(800_000.0), F.col("_spoken") / F.col("_n")), F.col("_spoken") * F.col("_w") / F.sum("_w").over(whole)))
    rows = rows.withColumn("_c", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("_d").over(whole) * F.col("_spoken"))
    end = F.when(F.col("phrase_idx") == F.col("_n"), F.col("duration_us")).otherwise(F.least(F.col("duration_us"), F.round(F.col("_delay") + F.col("_c")).cast("long")))
    rows = rows.withColumn("_end", end)
    start = F.coalesce(F.lag("_end").over(order), F.col("_delay").cast("long"))
    return rows.select(ITEM, F.col("phrase_idx").alias("idx"), start.alias("start_us"), F.greatest(start, F.col("_end")).alias("end_us"), F.col("phrase").alias("text"))


def cues_script_on_timings(phrases: DataFrame, timings: DataFrame, media: DataFrame, delay_us: int = 0) -> DataFrame:
    """The phrases of a script on the timings of another transcript. phrases: item_id, phrase_idx, phrase. timings: item_id, seq, start_us, end_us.

    As many or more timings than phrases: each phrase gets an equal share of the timings in order. Fewer: the phrases are
    dealt out over the time from the first start to the last end, by length.
    """
    order = Window.partitionBy(ITEM).orderBy("seq")
    some = timings.where("end_us > start_us").withColumns({"_i": F.row_number().over(order).cast("long") - 1, "_m": F.count(F.lit(1)).over(Window.partitionBy(ITEM))})
    whole = Window.partitionBy(ITEM)
    rows = phrases.withColumns({"_n": F.count(F.lit(1)).over(whole), "_j": F.col("phrase_idx") - 1, "_w": F.greatest(F.lit(4), F.length(strip_marks(F.col("phrase"))))})
    rows = rows.withColumns({"_c": F.sum("_w").over(whole.orderBy("phrase_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_t": F.sum("_w").over(whole)})
    sides = some.groupBy(ITEM).agg(F.max("_m").alias("_m"), F.min_by("start_us", "_i").alias("_first"), F.max_by("end_us", "_i").alias("_last"))
    rows = rows.join(sides, ITEM).join(media.select(ITEM, "duration_us"), ITEM)
    clamp = lambda c: F.greatest(F.lit(0), F.least("duration_us", c + delay_us))
    dealt = rows.where("_n <= _m").withColumns({"_a": F.floor(F.col("_j") * F.col("_m") / F.col("_n")), "_b": F.floor((F.col("_j") + 1) * F.col("_m") / F.col("_n"))})
    dealt = dealt.withColumn("_b", F.greatest(F.col("_a") + 1, F.col("_b")) - 1)
    at = lambda name, side: some.select(ITEM, F.col("_i").alias(name), F.col(side).alias(f"_{side}"))
    dealt = dealt.join(at("_a", "start_us"), [ITEM, "_a"]).join(at("_b", "end_us"), [ITEM, "_b"])
    start = clamp(F.col("_start_us"))
    dealt = dealt.select(ITEM, F.col("phrase_idx").alias("idx"), start.cast("long").alias("start_us"), F.greatest(start + 200_000, F.least("duration_us", F.col("_end_us") + delay_us)).cast("long").alias("end_us"), F.col("phrase").alias("text"))
    few = rows.where("_n > _m").withColumn("_s", clamp(F.col("_first"))).withColumn("_e", F.greatest(F.col("_s") + 200_000, F.least("duration_us", F.col("_last") + delay_us)))
    point = lambda c: (F.col("_s") + F.floor((F.col("_e") - F.col("_s")) * c / F.col("_t"))).cast("long")
    few = few.select(ITEM, F.col("phrase_idx").alias("idx"), point(F.col("_c") - F.col("_w")).alias("start_us"), F.when(F.col("_j") == F.col("_n") - 1, F.col("_e")).otherwise(point(F.col("_c"))).cast("long").alias("end_us"), F.col("phrase").alias("text"))
    return dealt.unionByName(few)


def cues_from_timing_text(timings: DataFrame, media: DataFrame, delay_us: int = 0) -> DataFrame:
    """Cues of each timing's own text: its phrases share the timing's time by length. timings: item_id, seq, start_us, end_us, text.

    A phrase weighs its visible characters, at least 4. Timings are moved by the delay and held within the item, and last at least 200 ms;
    those without time or text have no cue. idx counts an item's cues from 1.
    """
    some = timings.where("end_us > start_us AND trim(text) <> ''").join(media.where("duration_us > 0").select(ITEM, "duration_us"), ITEM)
    split = split_phrases(some)
    whole = some.join(split.select(ITEM, "seq").distinct(), [ITEM, "seq"], "left_anti").withColumns({"phrase_idx": F.lit(1).cast("long"), "phrase": F.trim("text")})
    rows = split.unionByName(whole.select(*split.columns)).withColumn("_w", F.greatest(F.lit(4), F.length(strip_marks(F.col("phrase")))))
    of_timing = Window.partitionBy(ITEM, "seq")
    rows = rows.withColumns({"_c": F.sum("_w").over(of_timing.orderBy("phrase_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_t": F.sum("_w").over(of_timing)})
    rows = rows.withColumn("_s", F.greatest(F.lit(0), F.least("duration_us", F.col("start_us") + delay_us)))
    rows = rows.withColumn("_e", F.greatest(F.col("_s") + 200_000, F.least("duration_us", F.col("end_us") + delay_us)))
    point = lambda c: (F.col("_s") + F.floor((F.col("_e") - F.col("_s")) * c / F.col("_t"))).cast("long")
    idx = F.row_number().over(Window.partitionBy(ITEM).orderBy("seq", "phrase_idx")).cast("long")
    return rows.select(ITEM, idx.alias("idx"), point(F.col("_c") - F.col("_w")).alias("start_us"), point(F.col("_c")).alias("end_us"), F.col("phrase").alias("text"))
