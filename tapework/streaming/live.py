"""Live operators. Each takes a streaming (or batch) DataFrame and returns one; event_time columns are TIMESTAMP."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.shared import stored


def stage_progress(events: DataFrame) -> DataFrame:
    """The latest stage of each item and when it came: item_id, stage, updated_at. Use update mode. events: item_id, stage, ts, event_id."""
    return events.groupBy("item_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("updated_at"))


def usage_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Usage events with each event_id once: a retried one within the delay counts only the first time."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stage_latency(first: DataFrame, last: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Pairs of an item's first-stage and last-stage events at most `within` apart: item_id, first_id, last_id, seconds."""
    a = first.select("item_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", delay)
    b = last.select(F.col("item_id").alias("_item"), F.col("event_id").alias("last_id"), F.col("ts").alias("last_ts")).withWatermark("last_ts", delay)
    met = a.join(b, F.expr(f"item_id = _item AND last_ts >= first_ts AND last_ts <= first_ts + INTERVAL {within}"))
    return met.select("item_id", "first_id", "last_id", ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1_000_000).alias("seconds"))


def ops_metrics(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Calls, failures, success rate and tokens of each window; late rows beyond the delay are dropped. events: ts, ok, tokens."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    by = events.withWatermark("ts", delay).groupBy(span.alias("w"))
    sums = by.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failures"), F.sum("tokens").alias("tokens"))
    return sums.select(F.col("w.start").alias("window_start"), "calls", "failures", F.round(1 - F.col("failures") / F.col("calls"), 6).alias("success_rate"), "tokens")


def edit_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of an item's edits: item_id, session_start, seconds from first to last edit, edits. events: item_id, ts."""
    by = events.withWatermark("ts", delay).groupBy("item_id", F.session_window("ts", gap).alias("s"))
    sums = by.agg(F.count(F.lit(1)).alias("edits"), F.max("ts").alias("_last"))
    return sums.select("item_id", F.col("s.start").alias("session_start"), ((F.unix_micros("_last") - F.unix_micros("s.start")) / 1_000_000).alias("seconds"), "edits")


def stalled_items(events: DataFrame, now: Column, timeout_s: int, resumable: Column) -> DataFrame:
    """item_id, state, new_state of items: without an event for timeout_s, running and queued ones are queued again if they can be
    resumed and else paused; cancelling ones are cancelled and pausing ones paused. events: item_id, state, ts, event_id.
    """
    last = events.groupBy("item_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("_last"))
    quiet = (F.unix_micros(now) - F.unix_micros("_last")) > timeout_s * 1_000_000
    new = (
        F.when(~quiet, F.col("state")).when(F.col("state") == "cancelling", "cancelled").when(F.col("state") == "pausing", "paused")
        .when(F.col("state").isin("running", "queued"), F.when(resumable, "queued").otherwise("paused")).otherwise(F.col("state"))
    )
    return last.select("item_id", "state", new.alias("new_state"))


class _Stalled(StatefulProcessor):
    """An item's last event, whether it has stalled, and when its timer is due, as state variables."""

    def __init__(self, timeout_s: int, forget_s: int, resumable: Callable[[object], bool]):
        self.timeout_ms, self.forget_ms, self.resumable = timeout_s * 1000, forget_s * 1000, resumable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_us long, event_id long, state string")
        self.stalled = handle.getValueState("stalled", "stalled boolean")
        self.due = handle.getValueState("due", "at_ms long")

    def _wait_until(self, at_ms: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at_ms)
        self.due.update((at_ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = tuple(self.last.get()) if self.last.exists() else None
        held = known
        for batch in rows:
            for ts, event_id, name in zip(batch["ts"], batch["event_id"], batch["state"], strict=True):
                event = (int(ts.value // 1000), int(event_id), name)
                held = event if held is None else max(held, event, key=lambda x: x[:2])
        if held == known:
            return
        self.last.update(held)
        self._wait_until(max(held[0] // 1000 + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if self.stalled.exists():
            self.stalled.clear()
            yield pd.DataFrame({"item_id": [key[0]], "state": [held[2]], "new_state": [held[2]], "stalled": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        if self.stalled.exists():
            self.last.clear()
            self.stalled.clear()
            return
        now = self.last.get()[2]
        new = {"cancelling": "cancelled", "pausing": "paused"}.get(now, ("queued" if self.resumable(key[0]) else "paused") if now in ("running", "queued") else now)
        self.stalled.update((True,))
        self._wait_until(at + self.forget_ms)
        yield pd.DataFrame({"item_id": [key[0]], "state": [now], "new_state": [new], "stalled": [True]})


def stalled_items_stream(events: DataFrame, timeout_s: int, resumable: Callable[[object], bool], delay: str = "10 minutes", forget_s: int = 7 * 86_400) -> DataFrame:
    """item_id, state, new_state, stalled: a row when an item has been without an event for timeout_s of event time, and one when it goes on.

    new_state is as in stalled_items(); resumable(item_id) tells whether an item can be resumed. Use update mode, and RocksDB as the state
    store (streaming.run.rocksdb_state()). An item's state is its last event and a timer; late events beyond the delay are dropped, and one
    before the last event changes nothing. forget_s after it has stalled an item leaves no state; what comes then is a new item's.
    """
    kind = events.schema["item_id"].dataType.simpleString()
    by = events.select("item_id", "state", "ts", "event_id").withWatermark("ts", delay).groupBy("item_id")
    return by.transformWithStateInPandas(_Stalled(timeout_s, forget_s, resumable), f"item_id {kind}, state string, new_state string, stalled boolean", "update", "eventTime")


def silence(levels: DataFrame, threshold: float, frame: str, min_s: float, delay: str = "10 minutes") -> DataFrame:
    """Runs of samples below the threshold that follow each other within `frame` and last min_s: item_id, start, end, samples."""
    by = levels.where(F.col("value") < threshold).withWatermark("ts", delay).groupBy("item_id", F.session_window("ts", frame).alias("s"))
    runs = by.agg(F.count(F.lit(1)).alias("samples"), F.max("ts").alias("_last"))
    length = (F.unix_micros("_last") - F.unix_micros("s.start")) / 1_000_000
    return runs.where(length >= min_s).select("item_id", F.col("s.start").alias("start"), F.col("_last").alias("end"), "samples")


def content_key(version: str, kind: str, model: str, payload: Column) -> Column:
    """What a result is cached by."""
    return F.sha2(F.concat_ws("\x01", F.lit(version), F.lit(kind), F.lit(model), payload), 256)


def pending_chunks(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks (with content_key) whose key has no ok result in the cache, each key once: the one with the smallest chunk_id."""
    once = chunks.groupBy("content_key").agg(F.min_by(F.struct("chunk_id", "payload"), "chunk_id").alias("c")).select("content_key", "c.chunk_id", "c.payload")
    return once.join(cache.where("status = 'ok'").select("content_key").distinct(), "content_key", "left_anti")


def enrich_incremental(chunks: DataFrame, cache: DataFrame, annotate: Callable[[pd.DataFrame], pd.DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Results of all chunks (chunk_id, content_key, status, result, tokens, cached) and the new cache rows.

    annotate gets pending chunks (content_key, payload) and gives content_key, status, result, tokens; it is asked once for each
    key, and what it says is written before anything reads it, as it may be paid for. Only ok results are cached, and a
    cached row counts no tokens. cache: content_key, status, result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield annotate(batch[["content_key", "payload"]])

    fresh = stored(pending_chunks(chunks, cache).mapInPandas(run, "content_key string, status string, result string, tokens long"))
    known = cache.where("status = 'ok'").groupBy("content_key", "status").agg(F.min("result").alias("result"))
    every = known.withColumns({"tokens": F.lit(0).cast("long"), "cached": F.lit(True)}).unionByName(fresh.withColumn("cached", F.lit(False)))
    return chunks.select("chunk_id", "content_key").join(every, "content_key"), fresh.where("status = 'ok'")


def trace_rows(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """One trace for each chunk: its first and last token, how many, and the hash of its text. chunks: item_id, chunk, first_pos, last_pos, without overlaps.

    A token finds its chunk by a window over its item, so tokens are shuffled once.
    """
    starts = chunks.select("item_id", F.col("first_pos").alias("pos"), F.lit(0).alias("_is_token"), F.struct("chunk", "last_pos").alias("_c"))
    every = tokens.select("item_id", "pos", "token_id", "text", F.lit(1).alias("_is_token")).unionByName(starts, allowMissingColumns=True)
    so_far = Window.partitionBy("item_id").orderBy("pos", "_is_token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("_c", F.last("_c", ignorenulls=True).over(so_far)).where("_is_token = 1")
    inside = every.select("item_id", "_c.chunk", "_c.last_pos", "pos", "token_id", "text").where("pos <= last_pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "")
    return inside.groupBy("item_id", "chunk").agg(F.min_by("token_id", "pos").alias("first_token"), F.max_by("token_id", "pos").alias("last_token"), F.count(F.lit(1)).alias("tokens"), F.sha2(text, 256).alias("text_sha256"))
