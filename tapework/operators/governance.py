"""Snapshots, their differences, reviews, and what may leave: consent, redaction, deletion."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redaction import allowed, redacted_columns
from ..functions.shared import remove, stored

ITEM = "item_id"
DECISION_KEYS = ["corrections", "break_hints", "allowed_breaks", "forbidden_breaks", "protected_spans", "delete_ranges", "applied_delete_ranges", "skipped_delete_ranges", "final_sentences"]
SNAPSHOT_FIELDS = ["sentence_id", "start_us", "end_us", "text", "enabled", "remove_video", "timeline_order"]


def snapshot(sentences: DataFrame) -> DataFrame:
    """item_id, snapshot (JSON of the stable fields in timeline order, synthetic gaps left out) and snapshot_sha256."""
    fields = F.struct("timeline_order", *[c for c in SNAPSHOT_FIELDS if c != "timeline_order"])
    listed = sentences.where(~F.coalesce("synthetic_gap", F.lit(False))).groupBy(ITEM).agg(F.array_sort(F.collect_list(fields)).alias("_s"))
    return listed.withColumn("snapshot", F.to_json("_s")).select(ITEM, "snapshot", F.sha2("snapshot", 256).alias("snapshot_sha256"))


def _boundaries(sentences: DataFrame) -> DataFrame:
    """The last token of every sentence of an item but the last in timeline order."""
    order = Window.partitionBy(ITEM).orderBy("timeline_order", "sentence_id")
    inner = sentences.withColumn("_next", F.lead("sentence_id").over(order)).where("_next IS NOT NULL AND size(token_ids) > 0")
    return inner.select(ITEM, F.element_at("token_ids", -1).alias("key")).distinct()


def diff_snapshots(base: DataFrame, final: DataFrame, base_titles: DataFrame, final_titles: DataFrame, base_items: DataFrame, final_items: DataFrame) -> DataFrame:
    """item_id, change, key, before and after for each of 14 kinds of change between two versions.

    Sentences: sentence_id, start_us, end_us, text, remove_video, timeline_order, style, token_ids. Titles: title_id, value.
    Items: cover, preset, subtitle_offset.
    """
    names = ["start_us", "end_us", "text", "remove_video", "timeline_order", "style"]
    side = lambda df, p: df.select(ITEM, "sentence_id", *[F.col(c).alias(f"{p}_{c}") for c in names], F.lit(True).alias(f"{p}_here"))
    both = side(base, "b").join(side(final, "a"), [ITEM, "sentence_id"], "full")
    b_here, a_here = F.coalesce("b_here", F.lit(False)), F.coalesce("a_here", F.lit(False))
    kept = b_here & a_here
    b_gone, a_gone = F.coalesce("b_remove_video", F.lit(False)), F.coalesce("a_remove_video", F.lit(False))
    changed = lambda c: kept & ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    span = lambda p: F.concat_ws("-", f"{p}_start_us", f"{p}_end_us")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def row(when: Column, change: str, before: Column = none, after: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(change).alias("change"), before.alias("before"), after.alias("after")))

    rows = F.array_compact(
        F.array(
            row(b_gone & ~a_gone, "restored"), row(a_gone & ~b_gone, "removed"), row(a_here & ~b_here, "added"), row(b_here & ~a_here, "missing"),
            row(changed("text"), "text", text("b_text"), text("a_text")), row(changed("start_us") | changed("end_us"), "timing", span("b"), span("a")),
            row(changed("timeline_order"), "order", text("b_timeline_order"), text("a_timeline_order")), row(changed("style"), "style", text("b_style"), text("a_style")),
        )
    )
    sentences = both.select(ITEM, F.col("sentence_id").alias("key"), F.explode(rows).alias("r")).select(ITEM, "r.change", "key", "r.before", "r.after")
    old, new = _boundaries(base), _boundaries(final)
    bare = lambda df, change: df.select(ITEM, F.lit(change).alias("change"), "key", none.alias("before"), none.alias("after"))
    splits = bare(new.join(old, [ITEM, "key"], "left_anti"), "split").union(bare(old.join(new, [ITEM, "key"], "left_anti"), "merged"))
    title = lambda df, name: df.select(ITEM, F.col("title_id").alias("key"), F.col("value").alias(name), F.lit(True).alias(f"_{name}"))
    titles = title(base_titles, "before").join(title(final_titles, "after"), [ITEM, "key"], "full").where("_before IS NULL OR _after IS NULL OR NOT (before <=> after)")
    titles = titles.select(ITEM, F.lit("title").alias("change"), "key", "before", "after")
    items = base_items.select(ITEM, *[F.col(c).cast("string").alias(f"b_{c}") for c in ("cover", "preset", "subtitle_offset")]).join(final_items.select(ITEM, *[F.col(c).cast("string").alias(f"a_{c}") for c in ("cover", "preset", "subtitle_offset")]), ITEM)
    which = F.array_compact(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.struct(F.lit(c).alias("change"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after"))) for c in ("cover", "preset", "subtitle_offset")]))
    settings = items.select(ITEM, F.explode(which).alias("r")).select(ITEM, "r.change", none.alias("key"), "r.before", "r.after")
    return sentences.union(splits).union(titles).union(settings)


def review_state(feedback: DataFrame, current: DataFrame) -> DataFrame:
    """item_id and state: completed only if the reviewed hash is the current snapshot's; an edit since then needs_review; else pending.

    feedback: item_id, review_status, reviewed_sha256. current: item_id, snapshot_sha256.
    """
    joined = feedback.join(current.select(ITEM, "snapshot_sha256"), ITEM, "left")
    same = F.col("reviewed_sha256").eqNullSafe(F.col("snapshot_sha256")) & F.col("snapshot_sha256").isNotNull()
    done = F.coalesce("review_status", F.lit("")) == "completed"
    return joined.select(ITEM, F.when(done & same, "completed").when(done, "needs_review").otherwise(F.coalesce("review_status", F.lit("pending"))).alias("state"))


def redact(df: DataFrame, json_columns: Iterable[str] = ()) -> DataFrame:
    """df without sensitive keys, at every depth of columns, structs, arrays, maps, VARIANT values and JSON in texts.

    A text in json_columns has to be JSON and is null where it can't be read. Any other text stays unless it is JSON with such keys, which go,
    or broken JSON that shows one, which is null.
    """
    strict = set(json_columns)
    fields = [f for f in df.schema.fields if allowed(f.name)]
    rows, clean = redacted_columns(df, [(F.col(f"`{f.name}`"), f.dataType) for f in fields])
    json = lambda k, c: F.when(F.try_parse_json(F.col(f"g{k}")).isNotNull(), c)
    return rows.select(*[(json(k, c) if f.name in strict else c).alias(f.name) for k, (f, c) in enumerate(zip(fields, clean, strict=True))])


def feedback_records(files: DataFrame, text: str = "value") -> DataFrame:
    """Feedback files (a JSON text each) as rows that training_export() takes, their free parts as VARIANT. Unreadable files give no row."""
    # Exploded, not filtered: a filter on a parsed text moves down to the rows the text is made of, and makes and parses it again for each of its conditions.
    parsed = F.filter(F.array(F.try_parse_json(text)), lambda v: v.isNotNull() & F.rlike(F.col(text), F.lit(r"^[ \t\r\n]*\{")))
    read = files.select(F.explode(parsed).alias("v"))
    part = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    consent = F.coalesce(part("data_policy.training_consent", "boolean"), F.lit(False))
    or_empty = lambda name, empty: F.coalesce(part(name, "variant"), F.parse_json(F.lit(empty))).alias(name)
    return read.select(
        part("job_id", "string").alias("job_id"), part("item_id", "string").alias("item_id"), part("updated_at", "string").alias("updated_at"), consent.alias("training_consent"),
        or_empty("raw_transcript", "[]"), or_empty("initial_result", "{}"), or_empty("final_result", "{}"), or_empty("user_changes", "{}"), or_empty("ai_decision", "{}"),
    )


def _decision(feedback: DataFrame) -> tuple[Column, Column]:
    """The decision keys of ai_decision, an empty list for those it hasn't, and its mode."""
    kind, whole = feedback.schema["ai_decision"].dataType, F.col("ai_decision")
    if isinstance(kind, T.VariantType):
        part = lambda name: F.coalesce(F.try_variant_get(whole, f"$.{name}", "variant"), F.parse_json(F.lit("[]")))
        return F.struct(*[part(k).alias(k) for k in DECISION_KEYS]), F.coalesce(F.try_variant_get(whole, "$.auto_edit_mode", "string"), F.lit("standard"))
    has = set(kind.names)
    parts = F.struct(*[(whole[k] if k in has else F.expr("cast(array() as array<string>)")).alias(k) for k in DECISION_KEYS])
    return parts, F.coalesce(whole["auto_edit_mode"], F.lit("standard")) if "auto_edit_mode" in has else F.lit("standard")


def training_export(feedback: DataFrame) -> DataFrame:
    """Records of feedback with consent, redacted: id, schema_version, prompt, rejected, chosen, ai_decision, user_changes.

    feedback: job_id, item_id, updated_at, training_consent, raw_transcript, initial_result, final_result, user_changes and
    ai_decision, a struct with some of the decision keys or a VARIANT. id is 24 signs of a hash of job, item and time of update.
    """
    ident = F.left(F.sha2(F.to_json(F.struct(F.col("item_id").alias("item"), F.col("job_id").alias("job"), F.col("updated_at").alias("updated"))), 256), F.lit(24))
    decision, mode = _decision(feedback)
    records = feedback.where("coalesce(training_consent, false)").select(
        ident.alias("id"), F.lit(1).alias("schema_version"), F.struct(F.col("raw_transcript"), mode.alias("auto_edit_mode")).alias("prompt"),
        F.col("initial_result").alias("rejected"), F.col("final_result").alias("chosen"), decision.alias("ai_decision"), "user_changes",
    )
    return redact(records)


def write_training_export(feedback: DataFrame, path: str) -> tuple[int, int]:
    """Write training_export() as a JSON row for each record, in place of what is at path; how many were exported, and skipped for want of consent.

    Both are counted in the pass that writes, by an observation below the filter, so nothing is read twice.
    """
    seen = Observation()
    consent = F.coalesce(F.col("training_consent"), F.lit(False))
    counted = feedback.observe(seen, F.count_if(consent).alias("exported"), F.count_if(~consent).alias("skipped"))
    training_export(counted).write.mode("overwrite").json(path)
    return seen.get["exported"], seen.get["skipped"]


def forget(df: DataFrame, keys: DataFrame) -> DataFrame:
    """df without the items of keys."""
    return df.join(keys.select(ITEM).distinct(), ITEM, "left_anti")


def _folder(values: Row) -> str:
    """The folder that Spark's writer gives a partition."""
    escape = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None or v == "" else "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in str(v))
    return "/".join(f"{k}={escape(v)}" for k, v in values.asDict().items())


# Signs that are escaped in the names of partitions' folders.
_ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in by])


def forget_in_tables(spark: SparkSession, tables: dict[str, list[str]], keys: DataFrame) -> DataFrame:
    """Delete the items of keys from partitioned Parquet tables, with proof. A row for each table: path, partitions, rewritten, emptied, deleted, left.

    tables: path to partition columns. Only partitions that hold a key (`rewritten`, of so many `partitions`) are read as a whole and
    replaced, by dynamic partition overwrite from a copy in the shared folder; those that hold nothing else (`emptied` of them) lose
    their folder. deleted counts rows; left counts rows of the keys afterwards, over all files of the table, and is 0. A null item_id in keys
    matches nothing. What is deleted isn't found again, so a run can be repeated; nobody else may write those partitions meanwhile, and if
    Spark dies while it puts the new partitions in place, their rows are in the copy.
    """
    wanted, report = stored(keys.select(ITEM).where(F.col(ITEM).isNotNull()).distinct()), []
    for path, by in tables.items():
        # As text, partition values keep the very form that their folders have.
        shape = T.StructType([T.StructField(f.name, T.StringType() if f.name in by else f.dataType) for f in spark.read.parquet(path).schema])
        table = spark.read.schema(shape).parquet(path)
        partitions = table.select(*by).distinct().count()
        held = stored(table.join(wanted, ITEM, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("deleted")))
        touched = held.select(*[F.col(c).alias(f"_{c}") for c in by])
        # Partitions are few and may be large: their names go to every task, and a large one is written by several.
        rest = stored(table.join(F.broadcast(touched), _same(table, touched, by), "left_semi").join(wanted, ITEM, "left_anti"))
        rest.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        kept = rest.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
        emptied = [remove(spark, f"{path}/{_folder(row)}") for row in held.join(kept, _same(held, kept, by), "left_anti").select(*by).toLocalIterator()]
        spark.catalog.refreshByPath(path)
        rewritten, deleted = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("deleted"), F.lit(0))).first()
        left = spark.read.schema(shape).parquet(path).join(wanted, ITEM, "left_semi").count()
        report.append((path, partitions, rewritten, len(emptied), deleted, left))
    return spark.createDataFrame(report, "path string, partitions long, rewritten long, emptied long, deleted long, left long")


def auto_apply(suggestions: DataFrame) -> DataFrame:
    """Suggestions that may be applied unasked: sure, of low risk, repeats or fillers, of at most two seconds."""
    return suggestions.where((F.col("confidence") >= 0.9) & (F.col("risk") == "low") & F.col("category").isin("repeat", "filler") & (F.col("seconds") <= 2.0))
