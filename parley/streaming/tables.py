"""Streams into tables. A micro-batch writes what it changes and no more; a retried one overwrites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.identity import HASH_VERSION
from parley.operators import KEY, analytics, archive, discovery
from parley.sources.changes import ChangeLog


def _start(stream: DataFrame, fn, checkpoint: str, trigger: dict):
    return (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _before(log: ChangeLog, batch: DataFrame, batch_id: int) -> DataFrame:
    """What ``log`` held of the batch's keys before it: a batch that is tried again does not see its own rows."""
    known = log.known(batch_id)
    return known.join(batch.select(*KEY).distinct(), KEY, "left_semi")


def ingest_changes(batch: DataFrame, known: DataFrame, history: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captures with their status, changed conversations, new revisions) of one batch, from the rows of its keys."""
    done = archive.ingest(batch, known, history)
    touched = done.where(F.col("status") != "duplicate").select(*KEY).distinct()
    changed = archive.upsert_conversations(known, done, now).join(touched, KEY, "left_semi")
    return done, changed, archive.new_revisions(history, batch, now)


def index_changes(batch: DataFrame, known: DataFrame, now: str, version: str = HASH_VERSION) -> tuple[DataFrame, DataFrame]:
    """(changed index rows, queueable events) of one batch of discovery events, from the index rows of its keys."""
    out = discovery.dedupe_then_apply(known, batch, now, version=version)
    return out["index"].join(batch.select(*KEY).distinct(), KEY, "left_semi"), out["queueable"]


def stream_ingest(stream: DataFrame, logs: dict[str, ChangeLog], now: str, checkpoint: str, sink=None, **trigger):
    """Captures with `seq` into the archive's logs, continuously. Redelivered captures come out as duplicates.

    Status, revisions and conversations come from the batch operators, so a hot conversation is as spread as there.
    ``sink(rows, batch_id)`` receives the captures with their status; a batch that is tried again reaches it again.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        known, history = (_before(logs[name], batch, batch_id) for name in ("conversations", "revisions"))
        done, conversations, revisions = ingest_changes(batch, known, history, now)
        if sink is not None:
            sink(done, batch_id)
        logs["revisions"].append(revisions, batch_id)
        logs["conversations"].append(conversations, batch_id)

    return _start(stream, apply, checkpoint, trigger)


def stream_dedupe(events: DataFrame, within: str, time: str = "at", keys: list[str] | None = None) -> DataFrame:
    """Drop repeats of (KEY, fingerprint) that arrive ``within`` each other."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys or [*KEY, "revision_fingerprint"])


def stream_index(events: DataFrame, log: ChangeLog, now: str, checkpoint: str, on_queueable=None,
                 version: str = HASH_VERSION, **trigger):
    """The passive path per micro-batch: dedupe, change detection, and the changed rows into the index's log.

    ``on_queueable(rows, batch_id)`` is called before the log is written; a batch that is tried again calls it again.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        rows, queueable = index_changes(batch, _before(log, batch, batch_id), now, version)
        if on_queueable is not None:
            on_queueable(queueable, batch_id)
        log.append(rows, batch_id)

    return _start(events, apply, checkpoint, trigger)


def platform_windows(rows: DataFrame, size: str, time: str = "at", watermark: str | None = None) -> DataFrame:
    """(platform, window_start, status, n): tumbling counts of state changes; the same on tables and streams."""
    timed = rows if watermark is None else rows.withWatermark(time, watermark)
    return timed.groupBy("platform", F.window(time, size), "status").agg(F.count(F.lit(1)).alias("n")).select(
        "platform", F.col("window.start").alias("window_start"), "status", "n")


def stream_log_tail(logs: DataFrame, tail: ChangeLog, n: int, checkpoint: str, **trigger):
    """Logs into the log ``tail``, each micro-batch cut to its newest ``n``; `analytics.retain_logs` of its rows is the
    tail, and a compaction of that keeps the log short."""
    return _start(logs, lambda batch, batch_id: tail.append(analytics.retain_logs(batch, n), batch_id), checkpoint, trigger)
