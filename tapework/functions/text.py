"""Text columns: pieces of speech text, their visual weight, and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is: a run of Latin letters, digits and joining signs, a run of blanks, or one other character.
PIECE = r"(?s)[A-Za-z0-9_+\-./#]+|\s+|."
BLANKS = " \t\n\x0b\x0c\r"
#: What is left out when spans are compared.
SPAN_NOISE = r"[\s，。！？!?；;：:,]"


def pieces(text: Column) -> Column:
    """The token pieces of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def half_units(text: Column) -> Column:
    """Visual weight in halves: an ASCII character counts 1, another 2, a blank 0; at least 1."""
    shown = F.translate(text, BLANKS, "")
    n = F.length(shown)
    # A text of as many bytes as characters is all ASCII, which spares the pattern.
    others = F.when(F.octet_length(shown) == n, 0).otherwise(n - F.length(F.regexp_replace(shown, r"[^\x00-\x7F]", "")))
    return F.greatest(F.lit(1), n + others).cast("long")


def half_units_of_pieces(text: Column) -> Column:
    """The sum of half_units() over the pieces of a text: a run of blanks is a piece, and so weighs 1."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    return (F.length(F.translate(ascii_only, BLANKS, "")) + F.regexp_count(text, F.lit(r"\s+")) + 2 * (F.length(text) - F.length(ascii_only))).cast("long")


def fold(text: Column) -> Column:
    """Lower case for comparisons, with ss for sharp s."""
    return F.lower(F.replace(text, F.lit("ß"), F.lit("ss")))


def span_form(text: Column) -> Column:
    """A text without blanks and sentence signs, folded."""
    return fold(F.regexp_replace(text, SPAN_NOISE, ""))


def to_us(value: Column) -> Column:
    """A number of over 100 is milliseconds, else seconds; anything else is 0. In microseconds."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    number = F.when(F.isnan(number), 0.0).otherwise(number)
    return F.round(F.when(number > 100, number / 1000).otherwise(number) * 1_000_000).cast("long")


def srt_time(us: Column) -> Column:
    """HH:MM:SS,mmm of microseconds."""
    ms = F.floor(F.greatest(us, F.lit(0)) / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
