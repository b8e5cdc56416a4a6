"""Micro-batching of events and logs: keyed buffers with timers, in RocksDB state.

A buffer belongs to one key. Streams too heavy for their few keys add `salts`: ids are spread by
hash, so all events of one id still meet in one buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUFFERED = T.StructType([T.StructField("id", T.StringType()), T.StructField("at", T.LongType()),
                         T.StructField("seq", T.LongType()), T.StructField("body", T.StringType())])
CLOCK = T.StructType([T.StructField("at", T.LongType()), T.StructField("batch", T.LongType())])
OUT = ("buffer string, batch bigint, reason string, size int, place int, id string, at timestamp, body string")
OUT_TYPE = T.StructType([
    T.StructField("buffer", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("size", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("body", T.StringType())])


class _Buffer(StatefulProcessor):
    """Common part: rows arrive in any order within a micro-batch and are taken by (time, seq)."""

    def __init__(self, wait_ms: int, limit: int) -> None:
        self.wait_ms, self.limit = wait_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", BUFFERED)
        self.clock = handle.getValueState("clock", CLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch bounds what one key brings; the source's rate limit bounds the micro-batch.
        new = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        last, batch = self.clock.get() if self.clock.exists() else (0, 0)
        out: list[pd.DataFrame] = []

        def flush(reason: str, flushed: list) -> None:
            nonlocal batch
            if flushed:
                out.append(self.emit(key, batch, reason, flushed))
                batch += 1

        for row in zip(new["id"], (int(t.timestamp() * 1000) for t in new["at"]), new["seq"], new["body"], new["urgent"]):
            last, held = self.take(row, last, held, flush)
        self.save(held, last, batch)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            return
        held = [tuple(r) for r in self.rows.get()]
        last, batch = self.clock.get()
        self.save([], last, batch + 1)
        yield self.emit(key, batch, "timer", held)

    def save(self, held: list, last: int, batch: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.rows.put(held)
            self.handle.registerTimer(last + self.wait_ms)
        else:
            self.rows.clear()
        self.clock.update((last, batch))

    def emit(self, key, batch: int, reason: str, held: list) -> pd.DataFrame:
        buffer = ":".join(str(k) for k in key)
        return pd.DataFrame({
            "buffer": buffer, "batch": batch, "reason": reason, "size": len(held), "place": range(len(held)),
            "id": [r[0] for r in held], "at": pd.to_datetime([r[1] for r in held], unit="ms"), "body": [r[3] for r in held]})

    def close(self) -> None:
        pass


class _EventBuffer(_Buffer):
    """The last event per id; the wait restarts with every event; the limit counts distinct ids."""

    def take(self, row, last, held, flush):
        id_, at, seq, body, _ = row
        if held and at - last >= self.wait_ms:
            flush("timer", held)
            held = []
        place = next((i for i, r in enumerate(held) if r[0] == id_), None)
        if place is None:
            held.append((id_, at, seq, body))
        else:
            held[place] = (id_, at, seq, body)
        if len(held) >= self.limit:
            flush("threshold", held)
            held = []
        return at, held


class _LogBuffer(_Buffer):
    """All entries; the wait counts from the first; an urgent entry flushes and passes by itself."""

    def take(self, row, last, held, flush):
        id_, at, seq, body, urgent = row
        if held and at - held[0][1] >= self.wait_ms:
            flush("timer", held)
            held = []
        if urgent:
            flush("manual", held)
            flush("pass", [(id_, at, seq, body)])
            return at, []
        if not held:
            last = at
        held.append((id_, at, seq, body))
        if len(held) >= self.limit:
            flush("threshold", held)
            held = []
        return last, held


def _run(rows: DataFrame, keys: list[str], processor: _Buffer, watermark: str) -> DataFrame:
    timed = rows.withWatermark("at", watermark)
    return timed.groupBy(*keys).transformWithStateInPandas(
        processor, OUT_TYPE, "append", "eventTime", eventTimeColumnName="at")


def discovery_batches(events: DataFrame, gap_ms: int = 250, max_ids: int = 20, keys: list[str] | None = None,
                      salts: int = 1, watermark: str = "1 second") -> DataFrame:
    """Events (platform, source_id, seq, at timestamp, …) in batches: OUT rows, `body` is the event as JSON.

    A batch ends ``gap_ms`` after its last event (reason timer) or at ``max_ids`` distinct ids (threshold).
    """
    keys = list(keys or ["platform"])
    rows = events
    if salts > 1:
        rows, keys = rows.withColumn("salt", F.pmod(F.xxhash64("source_id"), F.lit(salts))), [*keys, "salt"]
    rows = rows.select(*keys, F.col("source_id").alias("id"), "at", "seq", F.to_json(F.struct(*events.columns)).alias("body"),
                       F.lit(False).alias("urgent"))
    return _run(rows, keys, _EventBuffer(gap_ms, max_ids), watermark)


def log_batches(logs: DataFrame, delay_ms: int = 400, max_rows: int = 20, keys: list[str] | None = None,
                watermark: str = "1 second") -> DataFrame:
    """Logs (id, level, seq, at timestamp, …) as they reach the log table.

    Entries wait at most ``delay_ms`` from the first; warnings and errors flush the buffer and pass at once. Every
    flush of a buffer adds a summary row (id NULL).
    """
    keys = list(keys or ["worker_id"])
    rows = logs.select(*keys, "id", "at", "seq", F.to_json(F.struct(*logs.columns)).alias("body"),
                       F.col("level").isin("warn", "error").alias("urgent"))
    flushed = _run(rows, keys, _LogBuffer(delay_ms, max_rows), watermark)
    last = (F.col("place") == F.col("size") - 1) & (F.col("reason") != "pass")
    summary = F.to_json(F.struct(
        F.lit("debug").alias("level"), F.lit("background.log-buffer").alias("scope"),
        F.lit("debug.log_buffer_flushed").alias("code"), F.lit("Flushed buffered background logs.").alias("message"),
        F.struct(F.col("size").alias("batchSize"), F.col("reason").alias("reason")).alias("details")))
    own = F.struct("place", "id", "body")
    extra = F.struct(F.col("size").alias("place"), F.lit(None).cast("string").alias("id"), summary.alias("body"))
    rows = F.when(last, F.array(own, extra)).otherwise(F.array(own))
    return flushed.select("buffer", "batch", "reason", "size", "at", F.explode(rows).alias("r")).select(
        "buffer", "batch", "reason", "size", "at", "r.*")


def discovery_sessions(events: DataFrame, gap: str = "250 milliseconds", watermark: str = "1 second") -> DataFrame:
    """The gap rule alone as session windows: (platform, source_id) keeps its last event of each session.

    Sessions are per conversation here, which needs no state of our own and no common buffer.
    """
    rest = [x for x in events.columns if x not in ("platform", "source_id", "seq")]
    return (events.withWatermark("at", watermark).groupBy("platform", "source_id", F.session_window("at", gap))
            .agg(F.max_by(F.struct("seq", *rest), "seq").alias("_row")).select("platform", "source_id", "_row.*"))


def on_flush(batches: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Call ``fn(batch_rows, batch_id)`` for every micro-batch of flushed rows."""
    return (batches.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
