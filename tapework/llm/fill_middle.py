"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one array of bytes. A scan finds where tokens begin and so where each text is cut. Prefix, middle and suffix of
a text move as wholes: each adds the difference of its displacement to the one before to a difference array, whose cumulative sum is
every byte's displacement, and one scatter builds all outputs of the batch. Restoring reads the marks of an output and gathers its
bytes by the inverse displacements. Nothing is done text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import some_at_a_time, table, text_or_empty, unused, without
from .flat import begins_character, flat, runs_of, unflat

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The sign inside each mark, in the order that a form's output has them. All marks are three bytes long.
ORDER = {"psm": b"PSM", "spm": b"SPM"}
MARK = 3
CUT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
CUT_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def displacements(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """How far each of size bytes moves. Parts begin at starts, in ascending order, and move by shifts; parts may be empty."""
    difference = np.zeros(size + 1, np.int64)
    np.add.at(difference, starts, np.diff(shifts, prepend=0))
    return np.cumsum(difference)[:size]


def token_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where a token begins: a run of A-Z and a-z, or any other code point."""
    letter = (data | 0x20) - np.uint8(97) < 26
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[ends[:-1][ends[:-1] < len(data)]] = False
    return np.flatnonzero(begins_character(data) & ~goes_on)


def _holds_mark(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the marks."""
    return np.diff(np.searchsorted(_marks(data, ends), ends)) > 0


def _marks(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of all marks that lie within one text."""
    at = np.flatnonzero(data[: max(0, len(data) - 2)] == ord("<"))
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    return at[ends[np.searchsorted(ends, at, "right")] >= at + MARK]


def transform(texts: pa.Array, h: np.ndarray, plain_from: int, spm_below: int) -> pa.StructArray:
    """The cut of each text, as CUT_TYPE. h has four numbers for each text: two for the cuts, one for plain, one for the order."""
    data, ends = flat(texts)
    start, end = ends[:-1], ends[1:]
    tokens = token_starts(data, ends)
    first = np.searchsorted(tokens, ends)
    n = np.diff(first)
    cuts = np.sort(h[:2] % (n + 1), axis=0)
    tokens = np.append(tokens, len(data))
    a, b = (np.where(cut < n, tokens[first[:-1] + cut], end) for cut in cuts)
    plain = (n == 0) | _holds_mark(data, ends) | (h[2] % 100 >= plain_from)
    spm = ~plain & (h[3] % 100 < spm_below)
    a, b = np.where(plain, end, a), np.where(plain, end, b)
    prefix, middle, suffix = a - start, b - a, end - b
    out = runs_of(np.where(plain, end - start, end - start + 3 * MARK))
    begin = out[:-1]
    # Where each part begins in the output: prefix, suffix, middle, or suffix, prefix, middle.
    to_prefix = begin + np.where(plain, 0, np.where(spm, 2 * MARK + suffix, MARK))
    to_suffix = begin + np.where(spm, MARK, 2 * MARK + prefix)
    to_middle = begin + 3 * MARK + prefix + suffix
    shift = displacements(np.stack([start, a, b], 1).ravel(), np.stack([to_prefix - start, to_middle - a, to_suffix - b], 1).ravel(), len(data))
    built = np.zeros(out[-1], np.uint8)
    built[np.arange(len(data)) + shift] = data
    for mark, place in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k, sign in enumerate(mark.encode()):
            built[place[~plain] - MARK + k] = sign
    characters = runs_of(begins_character(data))
    counts = [pa.array(characters[y] - characters[x], pa.int64(), mask=plain) for x, y in ((start, a), (a, b))]
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), form, *counts, unflat(built, out)], fields=list(CUT_TYPE))


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs of these forms were built from. An output without exactly its form's marks raises ValueError; null stays null."""
    data, ends = flat(outputs)
    start, end = ends[:-1], ends[1:]
    valid = outputs.is_valid().to_numpy(zero_copy_only=False)
    form = np.array(forms.fill_null("").to_pylist(), object)
    spm, cut = form == "spm", np.isin(form, list(ORDER)) & valid
    if (valid & ~cut & (form != "plain")).any():
        raise ValueError("forms are plain, psm and spm")
    marks = _marks(data, ends)
    owner = np.searchsorted(ends, marks, "right") - 1
    marks = marks[cut[owner]]
    if (np.bincount(owner, minlength=len(start))[cut] != 3).any():
        raise ValueError("an output doesn't have its three marks")
    at = np.repeat(end[:, None], 3, axis=1)
    at[cut] = marks.reshape(-1, 3)
    signs = np.stack([data[m + 1] for m in marks.reshape(-1, 3).T], 1) if len(marks) else np.zeros((0, 3), np.uint8)
    wanted = np.array([list(ORDER[f]) for f in form[cut]], np.uint8).reshape(-1, 3)
    if (signs != wanted).any() or (at[cut, 0] != start[cut]).any():
        raise ValueError("an output's marks aren't those of its form")
    one, two, three = at[:, 1] - start - MARK, at[:, 2] - at[:, 1] - MARK, end - at[:, 2] - MARK
    prefix, suffix, middle = np.where(spm, two, one), np.where(spm, one, two), three
    prefix, suffix, middle = (np.where(cut, x, y) for x, y in ((prefix, end - start), (suffix, 0), (middle, 0)))
    out = runs_of(prefix + suffix + middle)
    begin = out[:-1]
    from_prefix = np.where(cut, np.where(spm, at[:, 1], start) + MARK, start)
    from_suffix = np.where(spm, start, at[:, 1]) + MARK
    from_middle = at[:, 2] + MARK
    parts = np.stack([begin, begin + prefix, begin + prefix + middle], 1)
    shift = displacements(parts.ravel(), (np.stack([from_prefix, from_middle, from_suffix], 1) - parts).ravel(), int(out[-1]))
    return unflat(data[np.arange(int(out[-1])) + shift], out, valid)


def _cut_texts(plain_from: int, spm_below: int):
    @F.arrow_udf(CUT)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *numbers in batches:
            h = np.array([x.to_numpy(zero_copy_only=False) for x in numbers], np.int64).reshape(4, -1)
            parts = [transform(part, h[:, at : at + len(part)], plain_from, spm_below) for at, part in some_at_a_time(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], CUT_TYPE)

    return run.asNondeterministic()


def _restore():
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            parts = [restored(outputs.slice(at, len(part)), forms.slice(at, len(part))) for at, part in some_at_a_time(outputs.fill_null(""))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run.asNondeterministic()


def numbers(doc_id: str = "doc_id", seed: str = "1:") -> list[Column]:
    """Four unsigned numbers of 32 bits: the first groups of eight digits of the hex sha256 of seed and the id as text. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output.

    A token is a run of A-Z and a-z or any other code point. Two numbers from the id cut a text between tokens into prefix, middle and
    suffix. Form plain leaves the text: empty and null texts, texts that hold a mark, and those whose third number modulo 100
    is plain_from or more; their two counts are null. Otherwise the form is spm where the fourth number modulo 100 is below spm_below,
    else psm. Texts are taken whole and few MB at a time; a text longer than that is worked on alone. Repeated rows give equal rows, an empty
    table none; columns of docs with the names of the new ones are replaced.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    docs = without(docs, *made)
    cut = unused(docs, "_cut")
    out = docs.withColumn(cut, _cut_texts(plain_from, spm_below)(text_or_empty(), *numbers(seed=seed)))
    return out.select(*docs.columns, *[F.col(f"{cut}.{name}").alias(name) for name in made])


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was built from, null for null. Outputs without the marks of their form raise an error."""
    return _restore()(output, F.coalesce(form, F.lit("plain")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in the middle, and restored from that."""
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    cut = cut.withColumn("restored", restore(F.col("output"), F.col("form")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || doc_id) AS digest
  FROM documents
), numbered AS (
  SELECT *, len(tokens) AS n, [('0x' || substr(digest, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM cut
), ends AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM ends
), built AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM built
"""
