"""Alignment of a script to spoken tokens by unique anchors and longest common subsequences between them.

tokens: item_id, pos, token_id, text. scripts: item_id, script. Three units in a row that occur once on both sides of an item are
anchors, and those that cross others are dropped. In each stretch between anchors a longest common subsequence is paired,
so text of which nothing occurs once is matched too. What stays open between matches is classified.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import stored
from ..functions.text import fold

ITEM = "item_id"
# What a script's units are, and its punctuation.
LEXICAL = r"(?s)[A-Za-z0-9_+\-./#]+|\||[。！？!?；;]|[，,、：:]|\s+|."
STRONG, WEAK = "。！？!?；;", "，,、：:"
LEAST_RATIO = 0.55
SHORT_REPLACE = 4


def script_units(scripts: DataFrame) -> DataFrame:
    """item_id, unit (from 0), text, manual_break, punctuation: the lexical units of a script with the marks that follow them."""
    cut = scripts.select(ITEM, F.posexplode(F.regexp_extract_all(F.coalesce("script", F.lit("")), F.lit(LEXICAL), F.lit(0))).alias("_at", "text"))
    mark = F.when(F.col("text") == "|", "break").when(F.col("text").rlike(f"^[{STRONG}{WEAK}]$"), "sign").when(F.col("text").rlike(r"^[^A-Za-z0-9㐀-鿿]+$"), "none").otherwise("unit")
    cut = cut.withColumn("_kind", mark).where("_kind <> 'none'")
    so_far = Window.partitionBy(ITEM).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("unit", F.count_if(F.col("_kind") == "unit").over(so_far).cast("long") - 1).where("unit >= 0")
    pick = lambda kind: F.max_by(F.when(F.col("_kind") == kind, F.col("text")), F.when(F.col("_kind") == kind, F.col("_at")))
    return cut.groupBy(ITEM, "unit").agg(pick("unit").alias("text"), F.max(F.col("_kind") == "break").alias("manual_break"), pick("sign").alias("punctuation"))


def alignment_prefilter(tokens: DataFrame, units: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """item_id, upper_ratio and passes: twice the common multiset over both lengths bounds any alignment's ratio from above."""
    side = lambda df, ours: df.select(ITEM, fold(F.col("text")).alias("_f"), F.lit(ours).alias("_ours"))
    both = side(tokens, True).unionByName(side(units, False)).groupBy(ITEM, "_f").agg(F.count_if("_ours").alias("_a"), F.count_if(~F.col("_ours")).alias("_b"))
    sums = both.groupBy(ITEM).agg(F.sum(F.when(F.col("_f").isNotNull(), F.least("_a", "_b")).otherwise(0)).alias("_common"), F.sum("_a").alias("token_count"), F.sum("_b").alias("unit_count"))
    ratio = 2 * F.col("_common") / (F.col("token_count") + F.col("unit_count"))
    return sums.where("token_count > 0 AND unit_count > 0").select(ITEM, "token_count", "unit_count", F.round(ratio, 6).alias("upper_ratio"), (ratio >= least).alias("passes"))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides (item_id, at, f) as rows with ours, which tells them apart, dealt by item once for all that follows.

    What is made of the rows takes several times what they take, so their partitions mustn't be put together by that.
    """
    rows = a.withColumn("ours", F.lit(True)).unionByName(b.withColumn("ours", F.lit(False)))
    return rows.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), ITEM)


def _calm(pairs: DataFrame) -> DataFrame:
    """The pairs (item_id, a, b) that no other one crosses or shares a side with.

    What comes after a pair is read backwards: a frame that goes on to the end is summed anew for each row.
    """
    up, down = Window.partitionBy(ITEM).orderBy("a", "b"), Window.partitionBy(ITEM).orderBy(F.desc("a"), F.desc("b"))
    sides = {"_lo": F.max("b").over(up.rowsBetween(Window.unboundedPreceding, -1)), "_before": F.lag("a").over(up)}
    pairs = pairs.withColumns(sides).withColumns({"_hi": F.min("b").over(down.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.lag("a").over(down)})
    alone = "(_before IS NULL OR _before < a) AND (_after IS NULL OR _after > a)"
    return pairs.where(f"(_lo IS NULL OR _lo < b) AND (_hi IS NULL OR _hi > b) AND {alone}").select(ITEM, "a", "b")


def _anchors(a: DataFrame, b: DataFrame, n: int = 3) -> DataFrame:
    """Pairs (item_id, a, b) of n units in a row that occur once on both sides."""
    order = Window.partitionBy(ITEM, "ours").orderBy("at")
    grams = _sides(a, b).withColumn("gram", F.array(*[F.lead("f", k).over(order) for k in range(n)])).where(~F.exists("gram", lambda x: x.isNull()))
    of = lambda ours: F.when(F.col("ours") == ours, F.col("at"))
    once = grams.groupBy(ITEM, "gram").agg(F.count(of(True)).alias("_n"), F.count(of(False)).alias("_m"), F.min(of(True)).alias("a"), F.min(of(False)).alias("b")).where("_n = 1 AND _m = 1")
    starts = _calm(once.select(ITEM, "a", "b"))
    each = starts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(ITEM, (F.col("a") + F.col("_k")).alias("a"), (F.col("b") + F.col("_k")).alias("b"))
    return _calm(each.distinct())


#: Bytes of rows that are held to read a pairing from.
HELD = 16 << 20


def _rows(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """For each beginning of a the row of lengths of longest common subsequences with all beginnings of b, bit-parallel.

    A row is one whole number: bit j is 0 where the length rises with b's j-th unit. So a step is a few operations on words of 64 cells: an
    addition carries each rise to the first match before it.
    """
    n = len(b)
    order = np.argsort(b, kind="stable")
    heads = np.flatnonzero(np.diff(b[order], prepend=b[order[0]] - 1)).tolist()
    wanted, at = set(a.tolist()), {}
    for head, end in zip(heads, [*heads[1:], n], strict=True):
        places = order[head:end]
        if (symbol := int(b[places[0]])) in wanted:
            bits = np.zeros(n // 8 + 1, np.uint8)
            np.bitwise_or.at(bits, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
            at[symbol] = int.from_bytes(bits.tobytes(), "little")
    every = (1 << n) - 1
    row = every
    for symbol in a.tolist():
        if hit := at.get(symbol):
            met = row & hit
            row = ((row + met) | (row - met)) & every
        yield row


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of a with each beginning of b."""
    last = deque(_rows(a, b), maxlen=1)[0]
    flat = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - flat.astype(np.int64))])


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two sequences.

    It is read from all rows where they take little memory; else halves of a meet the parts of b that suit them best.
    """
    if not len(a) or not len(b):
        return []
    if len(a) == 1 or len(b) == 1:
        found = np.flatnonzero(a == b)[:1].tolist()
        return [(0, k) if len(a) == 1 else (k, 0) for k in found]
    if len(a) * len(b) > 8 * HELD and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return common_subsequence(a[:half], b[:cut]) + [(half + x, cut + y) for x, y in common_subsequence(a[half:], b[cut:])]
    rows = [r.to_bytes(len(b) // 8 + 1, "little") for r in _rows(a, b)]
    rises = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if not rises(i, j):
            j -= 1
        elif i and rises(i - 1, j):
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def _open(a: DataFrame, b: DataFrame, matched: DataFrame) -> DataFrame:
    """What lies open between matched pairs: item_id, stretch, _a and _b, the open units (at, f) of both sides in order.

    stretch is the number of matched units before them, the same on both sides.
    """
    places = F.array(*[F.struct(F.col(c).alias("at"), F.lit(ours).alias("ours")) for c, ours in (("a", True), ("b", False))])
    hits = matched.select(ITEM, F.inline(places), F.lit(0).alias("_unit"), F.lit(1).alias("_m"))
    rows = a.withColumn("ours", F.lit(True)).unionByName(b.withColumn("ours", F.lit(False))).withColumn("_unit", F.lit(1))
    rows = rows.unionByName(hits, allowMissingColumns=True).repartition(F.col(ITEM))
    order = Window.partitionBy(ITEM, "ours").orderBy("at", "_unit")  # a unit's match comes right before it
    rows = rows.withColumns({"stretch": F.count("_m").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_last": F.lag("at").over(order)})
    side = lambda ours: F.array_sort(F.collect_list(F.when(F.col("ours") == ours, F.struct("at", "f"))))
    return rows.where("_unit = 1 AND (_last IS NULL OR _last < at)").groupBy(ITEM, "stretch").agg(side(True).alias("_a"), side(False).alias("_b"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))
def _paired(left: pa.Array, right: pa.Array) -> pa.Array:
    """Places of a longest common subsequence of two arrays of texts in each row."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    texts = pa.chunked_array([left.flatten(), right.flatten()]).combine_chunks()
    code = texts.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    ends = [np.cumsum(side.value_lengths().to_numpy(zero_copy_only=False)).tolist() for side in (left, right)]
    begins = [[0, *ends[0]], [k + len(left.flatten()) for k in [0, *ends[1]]]]
    found = [common_subsequence(code[begins[0][k] : begins[0][k + 1]], code[begins[1][k] : begins[1][k + 1]]) for k in range(len(left))]
    flat = np.array([p for of in found for p in of], np.int32).reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pairs).cast(kind)


def align_pairs(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """item_id, a (token place) and b (unit place) of matched pairs, in order on both sides."""
    a = stored(tokens.select(ITEM, F.col("pos").alias("at"), fold(F.col("text")).alias("f")))
    b = stored(units.select(ITEM, F.col("unit").alias("at"), fold(F.col("text")).alias("f")))
    anchors = stored(_anchors(a, b))
    texts = lambda c: F.transform(c, lambda x: x["f"])
    # A stretch, which its item bounds, is a row; most are short, so many go to Python at once.
    between = _open(a, b, anchors).where("size(_a) > 0 AND size(_b) > 0").withColumn("_p", _paired(texts("_a"), texts("_b")))
    place = lambda side, k: F.element_at(side, k + 1)["at"]
    met = F.transform("_p", lambda p: F.struct(place("_a", p["a"]).alias("a"), place("_b", p["b"]).alias("b")))
    return stored(anchors.unionByName(between.select(ITEM, F.inline(met))))


def align_script(tokens: DataFrame, scripts: DataFrame, least: float = LEAST_RATIO) -> dict[str, DataFrame]:
    """tokens, corrections, spans, report: tokens with the script's spelling and breaks, and what was found.

    Equal units keep the script's spelling (confidence .99); open stretches of as many tokens as units, at most four, are
    corrected one by one (.96); others are spans: asr_only, script_only, and ambiguous where both are there. An item whose
    matches reach less than `least` of both lengths is rejected and its tokens stay as they are.
    """
    tokens, units = stored(tokens), stored(script_units(scripts))
    gate = stored(alignment_prefilter(tokens, units, least))
    passed = gate.where("passes").select(ITEM)
    near, wanted = tokens.join(passed, ITEM, "left_semi"), units.join(passed, ITEM, "left_semi")
    pairs = align_pairs(near, wanted)
    sums = gate.join(pairs.groupBy(ITEM).agg(F.count(F.lit(1)).alias("_m")), ITEM, "left")
    similarity = F.coalesce(2 * F.col("_m") / (F.col("token_count") + F.col("unit_count")), F.lit(0.0))
    similarity = F.when(F.col("passes"), similarity).otherwise(F.col("upper_ratio"))
    report = stored(sums.select(ITEM, F.when(F.col("passes") & (similarity >= least), "aligned").otherwise("rejected").alias("status"), F.round(similarity, 4).alias("similarity"), "token_count", "unit_count", F.coalesce("_m", F.lit(0)).alias("exact_match_count")))
    fine = report.where("status = 'aligned'").select(ITEM)
    open_ = _open(near.select(ITEM, F.col("pos").alias("at"), F.col("text").alias("f")), wanted.select(ITEM, F.col("unit").alias("at"), F.col("text").alias("f")), pairs)
    open_ = stored(open_.join(fine, ITEM, "left_semi"))
    pairs = pairs.join(fine, ITEM, "left_semi")
    short = (F.size("_a") == F.size("_b")) & (F.size("_a") <= SHORT_REPLACE)
    replaced = open_.where(short).select(ITEM, F.explode(F.arrays_zip("_a", "_b")).alias("z")).select(ITEM, F.col("z._a.at").alias("a"), F.col("z._b.at").alias("b"), F.lit(0.96).alias("confidence"))
    every = pairs.withColumn("confidence", F.lit(0.99)).unionByName(replaced)
    joined = every.join(units.select(ITEM, F.col("unit").alias("b"), F.col("text").alias("replacement"), "manual_break", "punctuation"), [ITEM, "b"])
    changed = joined.join(tokens.select(ITEM, F.col("pos").alias("a"), "token_id", F.col("text").alias("original")), [ITEM, "a"])
    corrections = changed.where("original <> replacement").select(ITEM, F.col("a").alias("pos"), "token_id", "original", "replacement", "confidence")
    text = lambda c: F.array_join(F.transform(c, lambda x: x["f"]), "")
    kind = F.when((F.size("_a") > 0) & (F.size("_b") > 0), "ambiguous").when(F.size("_a") > 0, "asr_only").otherwise("script_only")
    spans = open_.where(~short & (F.size("_a") + F.size("_b") > 0)).select(ITEM, "stretch", kind.alias("kind"), text("_a").alias("asr_text"), text("_b").alias("script_text"))
    return {"tokens": carry_breaks(tokens, joined.select(ITEM, "a", "replacement", "manual_break", "punctuation")), "corrections": corrections, "spans": spans, "report": report}


def carry_breaks(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """tokens with the spelling, manual break and punctuation of the script unit they are paired with (a is the token's place)."""
    joined = tokens.join(pairs.withColumnRenamed("a", "pos"), [ITEM, "pos"], "left")
    strong = F.coalesce(F.col("punctuation").rlike(f"^[{STRONG}]$"), F.lit(False))
    weak = F.coalesce(F.col("punctuation").rlike(f"^[{WEAK}]$"), F.lit(False))
    return joined.withColumns({"original_text": F.col("text"), "text": F.coalesce("replacement", "text"), "manual_break_after": F.coalesce("manual_break", F.lit(False)), "script_punctuation_after": F.col("punctuation"), "script_sentence_break_after": strong, "script_phrase_break_after": weak}).drop("replacement", "manual_break", "punctuation")


def alignment_report(aligned: dict[str, DataFrame]) -> DataFrame:
    """The report with how many corrections and spans of each kind an item has."""
    counts = aligned["corrections"].groupBy(ITEM).agg(F.count(F.lit(1)).alias("corrections"))
    kinds = aligned["spans"].groupBy(ITEM).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("asr_only", "script_only", "ambiguous")])
    out = aligned["report"].join(counts, ITEM, "left").join(kinds, ITEM, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("corrections", "asr_only", "script_only", "ambiguous")})
