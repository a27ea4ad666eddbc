"""Readers and writers of transcripts, scripts, subtitles, segments and job folders.

Paths are whatever Spark's readers open. Every parser also works on a text column, so that it can be used on tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path
from ..functions.text import srt_time, to_us
from ..operators.scripts import strip_marks
from ..operators.tokens import tokens_from_words

_WORD = "start_time string, end_time string, start string, end string, text string, word string"
_UTTERANCE = f"start_time string, end_time string, start string, end string, text string, words array<struct<{_WORD.replace(' string', ':string')}>>"
_ONE = f"struct<{_UTTERANCE.replace('words array', 'words:array').replace(' string', ':string')}>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def _time(x: Column, name: str) -> Column:
    return F.coalesce(x[f"{name}_time"], x[name])


def parse_asr(df: DataFrame, item: str, text: str) -> DataFrame:
    """Utterances of speech recognition responses: item_id, utt (from 1), text, start_us, end_us, words.

    A response is a list of utterances or an object with them; times are seconds or, over 100, milliseconds. Blank utterances are
    left out after numbering; an unreadable response has none.
    """
    listed = F.coalesce(F.from_json(text, f"struct<utterances:array<{_ONE}>>")["utterances"], F.from_json(text, f"array<{_ONE}>"))
    rows = df.select(F.col(item).alias("item_id"), F.posexplode(listed).alias("_at", "u"))
    word = lambda w: F.struct(F.coalesce(w["text"], w["word"]).alias("text"), to_us(_time(w, "start")).alias("start_us"), to_us(_time(w, "end")).alias("end_us"))
    rows = rows.where(F.trim(F.coalesce("u.text", F.lit(""))) != "")
    return rows.select("item_id", (F.col("_at") + 1).cast("long").alias("utt"), F.trim("u.text").alias("text"), to_us(_time(F.col("u"), "start")).alias("start_us"), to_us(_time(F.col("u"), "end")).alias("end_us"), F.transform("u.words", word).alias("words"))


def read_asr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Utterances and tokens of the response files at path; item_id is the file."""
    utterances = parse_asr(_whole(spark, path), "file", "value")
    return utterances, tokens_from_words(utterances)


def _read_other(data: bytes) -> str:
    """Bytes that aren't UTF-8 as GB18030, and failing that as UTF-8 without what can't be read."""
    try:
        return data.decode("gb18030")
    except UnicodeDecodeError:
        return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "ignore")


def script_text(content: Column) -> Column:
    """The text of a script's bytes: UTF-8 with or without its mark, else GB18030, else UTF-8 without unreadable bytes."""

    @F.arrow_udf("string")
    def other(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else _read_other(d) for d in data.to_pylist()], pa.string())

    valid = F.is_valid_utf8(content.cast("string"))
    # Only bytes that aren't UTF-8 go to Python.
    return F.coalesce(F.when(valid, F.regexp_replace(content.cast("string"), "^\ufeff", "")), other(F.when(~valid, content)))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """file and text of the script files at path, but for empty ones; see script_text()."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), script_text(F.col("content")).alias("text"))


def _srt_us(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, r"([0-9]+):([0-9]+):([0-9]+)[,.]([0-9]{1,3})", n).cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000 + part(4) * 1000


def parse_srt(df: DataFrame, item: str, text: str) -> DataFrame:
    """Cues of subtitle texts: item_id, idx (from 1), start_us, end_us, text. Blocks without a time line are left out."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "^﻿", ""), r"\n[ \t]*\n+")
    rows = df.select(F.col(item).alias("item_id"), F.posexplode(blocks).alias("_at", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: F.trim(x))
    time = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"[0-9]+:[0-9]+:[0-9]+[,.][0-9]+ *--> *[0-9]+:[0-9]+:[0-9]+[,.][0-9]+")), F.lit(1))
    rows = rows.withColumns({"_time": time, "_text": F.array_join(F.filter(lines, lambda x: (x != "") & ~x.contains("-->") & ~x.rlike("^[0-9]+$")), " ")}).where("_time IS NOT NULL")
    sides = F.split("_time", "-->")
    order = F.row_number().over(_by_item("_at"))
    return rows.select("item_id", order.cast("long").alias("idx"), _srt_us(sides[0]).alias("start_us"), _srt_us(sides[1]).alias("end_us"), F.col("_text").alias("text"))


def _by_item(column: str):
    from pyspark.sql import Window

    return Window.partitionBy("item_id").orderBy(column)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of the subtitle files at path; item_id is the file."""
    return parse_srt(_whole(spark, path), "file", "value")


def srt_texts(cues: DataFrame) -> DataFrame:
    """item_id and value: each item's subtitle file, keyword marks left out."""
    block = F.format_string("%d\n%s --> %s\n%s\n", "idx", srt_time(F.col("start_us")), srt_time(F.col("end_us")), strip_marks(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct("idx", block.alias("block"))))
    return cues.groupBy("item_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n").alias("value"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One folder for each item with its subtitle file."""
    srt_texts(cues).write.mode("overwrite").partitionBy("item_id").text(path)


def segments_json(segments: DataFrame) -> DataFrame:
    """item_id and value: segments (start_us, end_us, text, token_ids) as JSON with seconds and milliseconds."""
    one = F.struct((F.col("start_us") / 1_000_000).alias("start"), (F.col("end_us") / 1_000_000).alias("end"), (F.col("start_us") / 1000).cast("long").alias("start_ms"), (F.col("end_us") / 1000).cast("long").alias("end_ms"), "text", "token_ids")
    return segments.groupBy("item_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))


def parse_segments(df: DataFrame) -> DataFrame:
    """Segments of segments_json() values: those with readable times whose end is after their start."""
    kind = "array<struct<start:string,end:string,text:string,token_ids:array<string>>>"
    rows = df.select("item_id", F.explode(F.from_json("value", kind)).alias("s"))
    us = lambda c: F.round(F.col(c).try_cast("double") * 1_000_000).cast("long")
    return rows.select("item_id", us("s.start").alias("start_us"), us("s.end").alias("end_us"), "s.text", "s.token_ids").where("end_us > start_us")


def write_segments(segments: DataFrame, path: str) -> None:
    """One JSON row for each item."""
    segments_json(segments).write.mode("overwrite").json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments that write_segments() wrote."""
    return parse_segments(spark.read.schema("item_id string, value string").json(path))


def parse_tolerant_json(text: Column, schema: str) -> Column:
    """A struct of a JSON text with chatter around it or with single backslashes; null if it can't be read.

    The outermost braces are taken; if that can't be read, every backslash that starts no escape is doubled.
    """
    body = F.regexp_extract(F.regexp_replace(text, "^﻿", ""), r"(?s)\{.*\}", 0)
    double = lambda b: F.regexp_replace(b, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = lambda c: F.from_json(c, f"{schema}, _bad string", options)
    good = lambda r: r.isNotNull() & r["_bad"].isNull()
    # Each step is a lambda's argument, so that Spark works it out once for a row, however often it is used below.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    second = lambda d: once(read(d), lambda r: F.when(good(r), r.dropFields("_bad")))
    # Quotes aside (they may be escaped where strings are in single ones), what was doubled can't be read as it is.
    hopeless = lambda b, d: (d != b) & ~F.contains(b, F.lit("\\'"))
    again = lambda b, d: F.when(hopeless(b, d), second(d)).otherwise(once(read(b), lambda r: F.when(good(r), r.dropFields("_bad")).when(d != b, second(d))))
    return once(body, lambda b: F.when(b != "", once(double(b), lambda d: again(b, d))))


#: Kinds of files in an item's folder, in the folder itself or below.
ITEM_FILES = ("transcript_analysis", "ai_decisions", "training_feedback", "media", "stage_validated", "stage_completed", "auto_edit_baseline")


def split_job_files(files: DataFrame) -> DataFrame:
    """job_id, item_id, kind, value, readable of files (path, value): */job.json, whose item_id is null, and */work/<item>/.../<kind>.json.

    Ids and kinds come from the paths; other files are left out. value stays as it is, also where it isn't JSON (readable is false then).
    """
    name, item = F.regexp_extract("path", r"([^/]+)\.json$", 1), F.regexp_extract("path", r"/work/([^/]+)/", 1)
    job = F.when(item == "", F.regexp_extract("path", r"([^/]+)/job\.json$", 1)).otherwise(F.regexp_extract("path", r"([^/]+)/work/[^/]+/", 1))
    rows = files.select(job.alias("job_id"), F.nullif(item, F.lit("")).alias("item_id"), name.alias("kind"), "value")
    known = (F.col("item_id").isNull() & (F.col("kind") == "job") & (F.col("job_id") != "")) | (F.col("item_id").isNotNull() & F.col("kind").isin(*ITEM_FILES))
    return rows.where(known).withColumn("readable", F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False)))


def job_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Files (path, value) of job folders as tables: jobs and items of the job files, each of ITEM_FILES as JSON text, and corrupt.

    The files are read once, into a table in the shared folder that is partitioned by kind, so each table reads its own files' rows only.
    A file that can't be read is an empty record, and its text is in corrupt; a missing one is no row.
    """
    spark, path = files.sparkSession, shared_path(files.sparkSession, "jobs")
    rows = split_job_files(files)
    rows.write.partitionBy("kind").parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    item = "struct<id:string,status:string,source_name:string,video:string,outputs:map<string,string>>"
    jobs = kept.where("kind = 'job'").select("job_id", F.from_json(F.when(F.col("readable"), F.col("value")).otherwise("{}"), f"status string, created_at string, updated_at string, params struct<title:string,items:array<{item}>>").alias("j"))
    tables = {"jobs": jobs.select("job_id", "j.status", "j.created_at", "j.updated_at", "j.params.title"), "items": jobs.select("job_id", F.explode("j.params.items").alias("i")).select("job_id", F.coalesce("i.id", F.lit("001")).alias("item_id"), "i.status", "i.source_name", F.coalesce(F.size("i.outputs"), F.lit(0)).alias("output_count"))}
    for kind in ITEM_FILES:
        tables[kind] = kept.where(F.col("kind") == kind).select("job_id", "item_id", F.when(F.col("readable"), F.col("value")).otherwise("{}").alias("value"))
    return tables | {"corrupt": kept.where("NOT readable").select("job_id", "item_id", "kind", "value")}


def read_job_tree(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The job folders below root as tables, in one scan of their files; see job_tables()."""
    scan = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(root, wholetext=True)
    return job_tables(scan.select(F.col("_metadata.file_path").alias("path"), "value"))
