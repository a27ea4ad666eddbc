"""Tokens with times, from words or from estimates.

tokens: item_id, utt, pos (from 0 within the item), token_id, text, original_text, start_us, end_us, timing_source, edited.
All windows run within one item_id, which a recording's length bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_units, pieces

TOKEN_COLUMNS = ["item_id", "utt", "pos", "token_id", "text", "original_text", "start_us", "end_us", "timing_source", "edited"]


def _tokens(df: DataFrame) -> DataFrame:
    """The columns of tokens.

    Spark takes exploded rows to be as few as the texts, and would send all tokens to every task in a join; the hint prevents that.
    """
    return df.withColumns({"original_text": F.col("text"), "edited": F.lit(False)}).select(*TOKEN_COLUMNS).hint("merge")


def _with_position(df: DataFrame) -> DataFrame:
    """pos counts an item's tokens in order of utterance and place."""
    order = Window.partitionBy("item_id").orderBy("utt", "_at")
    return _tokens(df.withColumn("pos", F.row_number().over(order).cast("long") - 1))


#: Pieces of a text that are dealt with in one row.
BLOCK = 256


def _weighed(df: DataFrame, key: list[str], text: Column, start: Column, end: Column, prefix: Column) -> DataFrame:
    """Blocks of the pieces of each text: key, _block, _pieces, _units (of each piece), and sums over the text's other blocks.

    Sums over blocks, and within a block, spare sorting the pieces themselves, which are many times as many rows.
    """
    cut = df.select(*key, start.alias("_from"), end.alias("_to"), prefix.alias("_prefix"), pieces(text).alias("_all"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_all")), F.lit(BLOCK))
    cut = cut.where(F.size("_all") > 0).withColumn("_pieces", F.transform(starts, lambda at: F.slice("_all", at, BLOCK)))
    cut = cut.select(*key, "_from", "_to", "_prefix", F.posexplode("_pieces").alias("_block", "_pieces"))
    cut = cut.withColumn("_units", F.transform("_pieces", half_units))
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    units = F.aggregate("_units", F.lit(0).cast("long"), lambda a, u: a + u)
    cut = cut.withColumns({"_sum": units, "_size": F.size("_pieces")})
    return cut.withColumns({"_before": F.coalesce(F.sum("_sum").over(before), F.lit(0)), "_total": F.sum("_sum").over(whole), "_n": F.sum("_size").over(whole)})


def _dealt(blocks: DataFrame, key: list[str]) -> DataFrame:
    """The pieces of blocks (key, _at from 0, text) with token_id and times."""
    ends = F.aggregate("_units", F.array("_before"), lambda done, u: F.concat(done, F.array(F.element_at(done, -1) + u)))
    cut = blocks.withColumn("_upto", F.slice(ends, F.lit(2), F.size("_units")))
    cut = cut.select(*key, "_from", "_to", "_prefix", "_block", "_total", "_n", F.posexplode(F.arrays_zip("_pieces", "_units", "_upto")).alias("_k", "_z"))
    cut = cut.withColumns({"_at": F.col("_block") * BLOCK + F.col("_k"), "text": F.col("_z._pieces"), "_sum": F.col("_z._upto"), "_units": F.col("_z._units")})
    length = F.greatest(F.lit(1000), F.col("_to") - F.col("_from"))
    at = lambda units: F.col("_from") + F.floor(length * units / F.col("_total")).cast("long")
    first = at(F.col("_sum") - F.col("_units"))
    last = F.when(F.col("_at") == F.col("_n") - 1, F.col("_to")).otherwise(at(F.col("_sum")))
    cut = cut.withColumns({"start_us": first, "end_us": F.greatest(first, last)})
    return cut.withColumns({"token_id": F.format_string("%s-w%04d", "_prefix", F.col("_at") + 1), "timing_source": F.lit("estimated")})


def estimated_by_weight(df: DataFrame, key: list[str], text: Column, start: Column, end: Column, prefix: Column) -> DataFrame:
    """The pieces of each text (key, _at from 0, text) with token_id and times dealt out by visual weight."""
    return _dealt(_weighed(df, key, text, start, end, prefix), key)


def tokens_estimated(df: DataFrame, text: str = "text", start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Deal [start, end] of each utterance out to the pieces of its text, by visual weight; the last piece ends exactly at end.

    df: item_id, utt and the three columns; a text without pieces gives no token.
    """
    prefix = F.format_string("u%04d", "utt")
    blocks = _weighed(df, ["item_id", "utt"], F.col(text), F.col(start), F.col(end), prefix)
    before = Window.partitionBy("item_id").orderBy("utt", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    dealt = _dealt(blocks, ["item_id", "utt", "_first"])
    return _tokens(dealt.withColumn("pos", (F.col("_first") + F.col("_k")).cast("long")))


def tokens_from_words(utterances: DataFrame) -> DataFrame:
    """Tokens of utterances with timed words; utterances without usable words get estimated times.

    utterances: item_id, utt, text, start_us, end_us and words, an array of (text, start_us, end_us). A word of several pieces
    is split evenly, its last piece ends with the word; a word that doesn't end after its start ends 20 ms later, or with
    its utterance if that is later.
    """
    words = utterances.select("item_id", "utt", F.col("end_us").alias("_utt_end"), F.posexplode_outer("words").alias("_word", "w"))
    words = words.withColumn("_text", F.trim(F.coalesce(F.col("w.text"), F.lit("")))).where("_text <> ''")
    start = F.coalesce("w.start_us", F.lit(0))
    end = F.coalesce("w.end_us", start)
    words = words.withColumns({"_from": start, "_to": F.when(end <= start, F.greatest(start + 20_000, F.col("_utt_end"))).otherwise(end)})
    split = words.select("item_id", "utt", "_word", "_from", "_to", F.posexplode(pieces(F.col("_text"))).alias("_piece", "text"), F.size(pieces(F.col("_text"))).alias("_n"))
    each = (F.col("_to") - F.col("_from")) / F.col("_n")
    first = F.col("_from") + F.floor(F.col("_piece") * each).cast("long")
    last = F.when(F.col("_piece") == F.col("_n") - 1, F.col("_to")).otherwise(F.col("_from") + F.floor((F.col("_piece") + 1) * each).cast("long"))
    name = F.format_string("u%04d-w%04d", F.col("utt"), F.col("_word") + 1)
    timed = split.select(
        "item_id", "utt", (F.col("_word").cast("long") * (1 << 31) + F.col("_piece")).alias("_at"), "text", first.alias("start_us"), last.alias("end_us"),
        F.when(F.col("_n") > 1, F.format_string("%s-c%02d", name, F.col("_piece") + 1)).otherwise(name).alias("token_id"),
        F.when(F.col("_n") > 1, "interpolated-within-word").otherwise("asr").alias("timing_source"),
    )
    has_words = F.exists(F.coalesce("words", F.array()), lambda w: F.trim(F.coalesce(w["text"], F.lit(""))) != "")
    bare = utterances.where(~has_words)
    estimated = estimated_by_weight(bare, ["item_id", "utt"], F.col("text"), F.col("start_us"), F.col("end_us"), F.format_string("u%04d", "utt"))
    return _with_position(timed.unionByName(estimated.select(*timed.columns)))


def pause_after(tokens: DataFrame) -> DataFrame:
    """tokens with pause_us: the time from a token's end to the next one's start, 0 after the last and never negative."""
    following = F.lead("start_us").over(Window.partitionBy("item_id").orderBy("pos"))
    return tokens.withColumn("pause_us", F.greatest(F.lit(0), F.coalesce(following - F.col("end_us"), F.lit(0))).cast("long"))
