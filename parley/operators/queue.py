"""The export queue. `pos` is the table order; new rows go to the front (smaller `pos`)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.identity import queue_key
from parley.functions.times import epoch_ms, iso_from_ms
from parley.operators import KEY
from parley.operators.artifacts import front_of

# Priorities in the order they are served, and the states of a row.
PRIORITIES = ("realtime", "retry", "backfill")
STATUSES = ("pending", "processing", "completed", "failed", "skipped", "cancelled")
RESETTABLE = ("failed", "cancelled", "skipped")
# Waiting times in milliseconds.
ORPHAN_MS, STALE_MS, GHOST_MS, COOLDOWN_MS = 30_000, 90_000, 30_000, 1_800_000

EVENT = ["url", "title", "source_updated_at", "source_updated_label"]


def _null() -> Column:
    return F.lit(None).cast("string")


def _edit(queue: DataFrame, hit: Column, changes: dict[str, Column], now: str | None) -> DataFrame:
    if now is not None:
        changes = {**changes, "updated_at": F.lit(now)}
    return queue.withColumns({n: F.when(hit, x).otherwise(F.col(n)) for n, x in changes.items() if n in queue.columns})


def _inserted(events: DataFrame, columns: list[str], kind: str, priority: str, now: str, front: Column) -> DataFrame:
    c = F.col
    made = {"pos": front - c("seq"), "kind": F.lit(kind), "priority": F.lit(priority),
            "key": queue_key(c("platform"), c("source_id"), c("revision_fingerprint")),
            "status": F.lit("pending"), "attempts": F.lit(0), "discovered_at": F.lit(now), "updated_at": F.lit(now)}
    empty = {n: _null() for n in columns if n not in made and n not in events.columns}
    return events.withColumns({**made, **empty}).select(*columns)


def merge_queue(queue: DataFrame, events: DataFrame, now: str, kind: str = "export", priority: str = "realtime",
                force: bool = False, front: int | None = None) -> DataFrame:
    """Merge discovery events, at most one per KEY, into the queue.

    An absent (NULL) field of an event leaves the row's value. ``events`` carry `seq`.
    """
    c = F.col
    front = front_of(queue) if front is None else F.lit(front)
    ev = events.select(*KEY, *[c(f).alias(f"e_{f}") for f in (*EVENT, "revision_fingerprint")],
                       queue_key(c("platform"), c("source_id"), c("revision_fingerprint")).alias("e_key"))
    facts = queue.join(ev.select(*KEY, "e_key"), KEY).groupBy(*KEY).agg(
        F.bool_or(c("key") == c("e_key")).alias("_exact"),
        F.min_by(F.struct("key", "status", "source_updated_at"), "pos").alias("_first"))
    plan = ev.join(facts, KEY, "left").withColumn("target", F.when(c("_exact"), c("e_key")).when(
        (c("_first.status") != "completed")
        & (c("_first.source_updated_at").isNull() | c("e_source_updated_at").isNull()), c("_first.key")))
    hits = plan.where(c("target").isNotNull()).select(
        c("target").alias("key"), *[c(f"e_{f}") for f in (*EVENT, "revision_fingerprint")])
    rows = queue.join(hits, "key", "left")
    hit = c("e_revision_fingerprint").isNotNull()
    reset = hit & (c("status").isin(*RESETTABLE) | (F.lit(force) & (c("status") != "processing")))
    dated = hit & c("e_source_updated_at").isNotNull() & c("source_updated_at").isNull()
    fingerprint = F.when(dated, c("e_revision_fingerprint")).otherwise(c("revision_fingerprint"))
    after = rows.withColumns({
        "key": F.when(dated, queue_key(c("platform"), c("source_id"), fingerprint)).otherwise(c("key")),
        "revision_fingerprint": fingerprint,
        **{f: F.coalesce(f"e_{f}", f) for f in EVENT},
        "kind": F.when(hit, kind).otherwise(c("kind")),
        "priority": F.when(reset, priority).otherwise(c("priority")),
        "status": F.when(reset, "pending").otherwise(c("status")),
        "worker_id": F.when(~reset | ~hit, c("worker_id")),
        "last_error": F.when(~reset | ~hit, c("last_error")),
        "updated_at": F.when(hit, now).otherwise(c("updated_at"))}).select(*queue.columns)
    fresh = events.join(plan.where(c("target").isNull()).select(*KEY), KEY, "left_semi")
    return after.unionByName(_inserted(fresh, queue.columns, kind, priority, now, front))


def fold_queue(queue: DataFrame, events: DataFrame, now: str, kind: str = "export", priority: str = "realtime",
               force: bool = False, front: int | None = None) -> DataFrame:
    """merge_queue for several events per KEY, applied in `seq` order.

    Re-keying makes the merges order-dependent, so a key's events are read in order. They stream
    through sorted partitions; the state is one row per distinct fingerprint the events name, plus
    the key's first row, found by key. All other queue rows never leave Spark.
    """
    c = F.col
    front = front_of(queue) if front is None else F.lit(front)
    named = events.select(*KEY, queue_key(c("platform"), c("source_id"), c("revision_fingerprint")).alias("key")).distinct()
    first = queue.join(events.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.min_by("key", "pos").alias("key"))
    involved = named.unionByName(first).select("key").distinct()
    idle = queue.join(involved, "key", "left_anti")
    live = queue.join(involved, "key", "left_semi").withColumns({"seq": F.lit(-1).cast("bigint")})
    arriving = events.select(*[x for x in events.columns if x in queue.columns], "seq")
    tape = live.unionByName(arriving, allowMissingColumns=True).withColumn("_front", front)
    columns, schema = queue.columns, queue.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rows, head = None, {}, None
        for batch in batches:
            done = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                seq, start = row.pop("seq"), row.pop("_front")
                where = (row["platform"], row["source_id"])
                if where != current:
                    done.extend(rows.values())
                    current, rows, head = where, {}, None
                if seq < 0:
                    # Rows of the queue come by position, so the first is the head.
                    rows[row["key"]] = row
                    head = head or row
                else:
                    head = _apply(rows, head, row, int(start) - int(seq))
            if done:
                yield shaped(done)
        if rows:
            yield shaped(list(rows.values()))

    def _apply(rows: dict[str, dict], head: dict | None, event: dict, pos: int) -> dict:
        """Apply one event; returns the row now foremost. New rows come before all others."""
        key = ":".join((event["platform"], event["source_id"], event["revision_fingerprint"]))
        target = rows.get(key)
        if target is None and head and head["status"] != "completed" and not (
                head["source_updated_at"] and event["source_updated_at"]):
            target = head
        if target is None:
            rows[key] = {**dict.fromkeys(columns), **event, "key": key, "pos": pos, "kind": kind, "priority": priority,
                         "status": "pending", "attempts": 0, "discovered_at": now, "updated_at": now}
            return rows[key]
        if event["source_updated_at"] and not target["source_updated_at"]:
            rows.pop(target["key"])
            target.update(revision_fingerprint=event["revision_fingerprint"], key=key)
            rows[key] = target
        target.update({f: event[f] for f in EVENT if event[f] is not None}, kind=kind, updated_at=now)
        if target["status"] in RESETTABLE or (force and target["status"] != "processing"):
            target.update(priority=priority, status="pending", worker_id=None, last_error=None)
        return head

    def shaped(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{n: r.get(n) for n in columns} for r in rows], columns=columns, dtype=object)

    ordered = tape.repartition(*KEY).sortWithinPartitions(*KEY, "seq", "pos")
    return idle.unionByName(ordered.mapInPandas(run, schema))


def next_pending(queue: DataFrame) -> DataFrame:
    """One row per platform: the pending row to serve next."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    rest = [x for x in queue.columns if x != "platform"]
    order = F.struct(rank.alias("r"), epoch_ms(F.col("discovered_at")).alias("t"), F.col("pos"))
    best = queue.where(F.col("status") == "pending").groupBy("platform").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select("platform", "_row.*").select(*queue.columns)


def retry_failed(queue: DataFrame, now: str, key: str | None = None) -> DataFrame:
    hit = F.col("status") == "failed"
    if key is not None:
        hit = hit & (F.col("key") == key)
    return _edit(queue, hit, {"status": F.lit("pending"), "priority": F.lit("retry"), "last_error": _null()}, now)


def force_export(queue: DataFrame, key: str, now: str) -> DataFrame:
    empty = {n: _null() for n in ("last_error", "error_code", "skip_reason", "worker_id")}
    return _edit(queue, F.col("key") == key, {"status": F.lit("pending"), "priority": F.lit("retry"), **empty}, now)


def patch(queue: DataFrame, key: str, changes: dict[str, Column | str | int | None], now: str) -> DataFrame:
    made = {n: x if isinstance(x, Column) else F.lit(x) for n, x in changes.items()}
    return _edit(queue, F.col("key") == key, made, now)


def mark_status(queue: DataFrame, key: str, status: str, now: str, last_error: str | None = None) -> DataFrame:
    return patch(queue, key, {"status": status, "last_error": F.lit(last_error).cast("string")}, now)


def cancel(queue: DataFrame, key: str, now: str) -> DataFrame:
    return mark_status(queue, key, "cancelled", now, "Cancelled from dashboard.")


def remove(queue: DataFrame, key: str) -> DataFrame:
    return queue.where(F.col("key") != key)


def clear_history(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status").isin("pending", "processing"))


def clear_statuses(queue: DataFrame, statuses: Sequence[str], platform: str | None = None) -> DataFrame:
    drop = F.col("status").isin(*statuses)
    return queue.where(~(drop if platform is None else drop & (F.col("platform") == platform)))


def summarize_queue(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


#: Keys that the rows of one worker are dealt over where they meet its lease.
SALTS = 16


def recover_orphans(queue: DataFrame, leases: DataFrame, now: str) -> DataFrame:
    """Processing rows without a live lease on their platform, at least 30 s old, go back to pending."""
    # Only rows that a worker holds meet the leases; a busy worker's rows are dealt over `SALTS` keys.
    live = (leases.select("platform", "worker_id").distinct()
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_live", F.lit(True)))
    age = epoch_ms(F.lit(now)) - epoch_ms(F.col("updated_at"))
    held = F.coalesce(F.col("status") == "processing", F.lit(False)) & F.col("worker_id").isNotNull()
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    rows = (queue.where(held).withColumn("_salt", salt).join(live, ["platform", "worker_id", "_salt"], "left").drop("_salt")
            .unionByName(queue.where(~held).withColumn("_live", F.lit(None).cast("boolean"))))
    orphan = (F.col("status") == "processing") & F.col("_live").isNull() & F.coalesce(age >= ORPHAN_MS, F.lit(True))
    changes = {"status": F.lit("pending"), "priority": F.lit("retry"), "worker_id": _null(), "last_error": _null(),
               "error_code": _null()}
    return _edit(rows.withColumn("_orphan", orphan), F.col("_orphan"), changes, now).select(*queue.columns)


def stale_leases(leases: DataFrame, now: str) -> DataFrame:
    """Leases with `stale` (busy and 90 s idle) and `ghost` (busy, no tab, 30 s idle)."""
    idle = F.greatest(F.lit(0), epoch_ms(F.lit(now)) - epoch_ms(F.col("last_active_at")))
    known = F.coalesce(idle, F.lit(0))
    return leases.withColumns({
        "stale": F.col("busy") & F.coalesce(idle >= STALE_MS, F.lit(False)),
        "ghost": F.col("busy") & F.col("tab_id").isNull() & (known >= GHOST_MS)})


def _owned(queue: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Queue rows with the ``columns`` of the target that owns them (`_hit`): by key, else by KEY and worker.

    The two ways are two equi joins; a target's own key wins. Of several targets of one key or worker the one with the
    least fields, in the order of ``columns``, counts.
    """
    by_key = targets.groupBy("key").agg(F.min(F.struct(*columns)).alias("_a"))
    by_worker = targets.groupBy(*KEY, "worker_id").agg(F.min(F.struct(*columns)).alias("_b"))
    rows = queue.join(by_key, "key", "left").join(by_worker, [*KEY, "worker_id"], "left")
    owned = F.coalesce("_a", F.when(F.col("status") == "processing", F.col("_b")))
    return rows.withColumn("_p", owned).drop("_a", "_b")


def settle_items(queue: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """``results``: key, KEY, worker_id, skipped, revision. Settled rows are completed, or skipped as `latest_exists`."""
    p = F.col("_p")
    rows = _owned(queue, results, ["skipped", "revision"])
    changes = {
        "status": F.when(p["skipped"], "skipped").otherwise("completed"), "worker_id": _null(), "error_code": _null(),
        "skip_reason": F.when(p["skipped"], "latest_exists"), "result_revision": p["revision"]}
    return _edit(rows, p.isNotNull(), changes, now).select(*queue.columns)


def classify_failures(failures: DataFrame, now: str, retry_limit: int = 1) -> DataFrame:
    """Failures (key, KEY, attempts, priority, error, error_code) with what becomes of them.

    Adds status, next_priority, last_error, kept_code, index_state and the cool-down's end.
    """
    c = F.col
    low = F.lower("error")
    # Texts that tell the two retryable failures and the timeout apart.
    receiver_text = (c("error").contains("Receiving end does not exist") | c("error").contains("No tab with id")
                     | c("error").contains("Cannot access contents of url"))
    code = F.coalesce("error_code", F.when(receiver_text, "worker.receiver_unavailable"),
                      F.when(low.contains("timed out"), "worker.navigation_timeout"))
    receiver = F.coalesce((code == "worker.receiver_unavailable") & (
        c("attempts") + 1 < max(3, retry_limit + 2)), F.lit(False))
    challenge = c("platform").isin("gemini", "aistudio") & (
        F.coalesce(code == "worker.challenge_detected", F.lit(False)) | low.contains("challenge page detected"))
    retry = receiver | challenge
    return failures.withColumns({
        "status": F.when(retry, "pending").otherwise("failed"),
        "next_priority": F.when(retry, "retry").otherwise(c("priority")),
        "last_error": F.when(~receiver, c("error")), "kept_code": F.when(~retry, code),
        "index_state": F.when(retry, "pending").otherwise("failed"),
        "cooldown_until": F.when(challenge, iso_from_ms(epoch_ms(F.lit(now)) + COOLDOWN_MS))})


def apply_failures(queue: DataFrame, classified: DataFrame, now: str) -> DataFrame:
    p = F.col("_p")
    names = {"status": "status", "priority": "next_priority", "last_error": "last_error", "error_code": "kept_code"}
    rows = _owned(queue, classified, list(names.values()))
    changes = {n: p[source] for n, source in names.items()}
    return _edit(rows, p.isNotNull(), {**changes, "worker_id": _null()}, now).select(*queue.columns)


def mark_failure_states(index: DataFrame, classified: DataFrame) -> DataFrame:
    """The index after failures: conversations with a retried row are pending, the others failed."""
    retried = F.bool_or(F.col("index_state") == "pending")
    states = classified.groupBy(*KEY).agg(F.when(retried, "pending").otherwise("failed").alias("_state"))
    return index.join(states, KEY, "left").withColumn("export_state", F.coalesce("_state", "export_state")).select(*index.columns)


def reset_in_flight(queue: DataFrame, now: str) -> DataFrame:
    return _edit(queue, F.col("status") == "processing", {"status": F.lit("pending"), "worker_id": _null()}, now)
