"""Discovery events: dedupe, merge into the index, change detection.

Events: KEY, url, title, source_updated_at, source_updated_label, revision_fingerprint, `seq`
(arrival order). Dedupe keeps one row per key with partial aggregates, so a key with a third of
all events shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions.times import epoch_ms, iso_from_ms
from parley.operators import KEY

EVENT_FIELDS = ["url", "title", "source_updated_at", "source_updated_label", "revision_fingerprint"]
STICKY = ("title", "source_updated_at", "source_updated_label")


def make_discovery_events(payloads: DataFrame, platform: str | None = None, version: str = ids.HASH_VERSION) -> DataFrame:
    rows = payloads if platform is None else payloads.withColumn("platform", F.lit(platform))
    return rows.withColumn("revision_fingerprint", ids.discovery_fingerprint(
        F.col("platform"), F.col("source_id"), F.col("source_updated_at"), version))


def dedupe_last(events: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """The last record of each key, whole; `first_seq` keeps the order of first sight."""
    rest = [x for x in events.columns if x not in keys]
    return (events.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row"), F.min(seq).alias("first_seq"))
            .select(*keys, "_row.*", "first_seq"))


def dedupe_coalesce(events: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Later records win field by field; title, time and label keep their last value that is not NULL."""
    rest = [x for x in events.columns if x not in keys and x != seq]
    plain = [x for x in rest if x not in STICKY]
    aggs = [F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(seq))).alias(x) for x in STICKY if x in rest]
    made = events.groupBy(*keys).agg(F.max_by(F.struct(*plain), seq).alias("_row"), *aggs,
                                     F.max(seq).alias(seq), F.min(seq).alias("first_seq"))
    return made.select(*keys, "_row.*", *[x for x in STICKY if x in rest], seq, "first_seq")


def union_by_priority(buffered: DataFrame, sidebar: DataFrame, api: DataFrame, buffered_only: bool = False) -> DataFrame:
    """Union where a later source replaces an earlier one whole; `source` names how the result came about.

    ``first_seq`` is a (rank, seq) pair to sort by. Which sources have rows at all is asked by scalar subqueries, so
    nothing runs while the plan is made.
    """
    ranked = [d.withColumn("rank", F.lit(i)) for i, d in enumerate((buffered, sidebar, api))]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    has = [F.coalesce(rows.agg(F.bool_or(F.col("rank") == i)).scalar(), F.lit(False)) for i in range(3)]
    b, s, a = has
    alone = b & (F.lit(buffered_only) | ~(a | s))
    label = F.when(alone, "buffered").when(a & s, "merged").when(a, "api").when(s, "sidebar").otherwise("empty")
    flagged = rows.withColumns({"_alone": alone, "source": label}).where(~F.col("_alone") | (F.col("rank") == 0))
    order = F.struct("rank", F.col("seq").cast("bigint").alias("seq"))
    rest = [x for x in buffered.columns if x not in KEY]
    # Buffered rows alone stay as they came; otherwise one row a key.
    own = F.when(F.col("_alone"), order)
    made = flagged.groupBy(*KEY, own.alias("_own")).agg(
        F.max_by(F.struct(*rest), order).alias("_row"), F.min(order).alias("first_seq"), F.first("source").alias("source"))
    return made.select(*KEY, "_row.*", "first_seq", "source")


def upserted(rows: DataFrame, columns: list[str], complete: bool, now: Column) -> DataFrame:
    """Rows of index FULL JOIN events (event columns prefixed `e_`, `e_hit` marks a match)."""
    c = F.col
    hit, old = c("e_hit").isNotNull(), c("export_state").isNotNull()
    state = (F.when(hit & ~old, "complete" if complete else "partial")
             .when(hit & F.lit(complete), "complete").otherwise(c("discovery_state")))
    made = {
        "title": F.coalesce("e_title", "title"),
        "url": F.coalesce("e_url", "url"),
        "last_seen_at": F.when(hit, now).otherwise(c("last_seen_at")),
        "latest_discovery_fingerprint": F.coalesce("e_revision_fingerprint", "latest_discovery_fingerprint"),
        "latest_source_updated_at": F.coalesce("e_source_updated_at", "latest_source_updated_at"),
        "latest_source_updated_label": F.coalesce("e_source_updated_label", "latest_source_updated_label"),
        "discovery_state": state,
        "export_state": F.coalesce("export_state", F.lit("never_exported")),
    }
    return rows.withColumns(made)


def _join(index: DataFrame, events: DataFrame) -> DataFrame:
    ev = events.select(*KEY, *[F.col(f).alias(f"e_{f}") for f in EVENT_FIELDS], F.lit(True).alias("e_hit"))
    return index.join(ev, KEY, "full")


def upsert_index(index: DataFrame, events: DataFrame, state: str, now: str | DataFrame) -> DataFrame:
    """Insert or update index entries from events, one event per KEY.

    ``now``: an ISO text, or (KEY, _now) when every key has its own.
    """
    rows = _join(index, events)
    if isinstance(now, DataFrame):
        rows = rows.join(now, KEY, "left")
        at = F.col("_now")
    else:
        at = F.lit(now)
    return upserted(rows, index.columns, state == "complete", at).select(*index.columns)


def changed_events(index: DataFrame, events: DataFrame, state: str, now: str,
                   version: str = ids.HASH_VERSION) -> dict[str, DataFrame]:
    """Which events to enqueue, and the index after them (one event per KEY: dedupe first).

    An event without a time never counts as a change of an entry that has one.
    """
    c = F.col
    new = c("export_state").isNull()
    changed = ~c("latest_discovery_fingerprint").eqNullSafe(c("e_revision_fingerprint"))
    degraded = c("latest_source_updated_at").isNotNull() & c("e_source_updated_at").isNull()
    enqueue = c("e_hit").isNotNull() & (new | (changed & ~degraded) | (c("export_state") != "exported")
                                        | ~c("latest_export_version").eqNullSafe(F.lit(version)))
    judged = _join(index, events).withColumn("enqueue", F.coalesce(enqueue, F.lit(False)))
    after = upserted(judged, index.columns, state == "complete", F.lit(now)).withColumn(
        "export_state", F.when(c("enqueue"), "pending").otherwise(c("export_state")))
    queueable = judged.where("enqueue").select(*KEY, *[c(f"e_{f}").alias(f) for f in EVENT_FIELDS])
    counts = judged.agg(F.count("e_hit").alias("total"), F.count_if("enqueue").alias("queued"))
    return {"queueable": queueable, "index": after.select(*index.columns), "counts": counts}


def dedupe_then_apply(index: DataFrame, events: DataFrame, now: str, sweep: bool = False,
                      version: str = ids.HASH_VERSION) -> dict[str, DataFrame]:
    """The passive path (realtime, partial) or the sweep path (backfill, complete)."""
    out = changed_events(index, dedupe_last(events), "complete" if sweep else "partial", now, version)
    out["queueable"] = out["queueable"].withColumn("priority", F.lit("backfill" if sweep else "realtime"))
    return out


def needs_full_sweep(index: DataFrame, visible: DataFrame) -> DataFrame:
    """One row: true when nothing is visible or any visible row is missing, not exported or changed."""
    known = index.select(*KEY, "export_state", "latest_discovery_fingerprint")
    fresh = (F.col("export_state").isNull() | (F.col("export_state") != "exported")
             | ~F.col("latest_discovery_fingerprint").eqNullSafe(F.col("revision_fingerprint")))
    return visible.select(*KEY, "revision_fingerprint").join(known, KEY, "left").agg(
        F.coalesce(F.bool_or(fresh), F.lit(True)).alias("needs_sweep"))


def rehydrate_pending(index: DataFrame, queue: DataFrame, version: str = ids.HASH_VERSION) -> DataFrame:
    """Backfill events for entries that are pending in the index but absent from the queue."""
    c = F.col
    lost = index.where(c("export_state") == "pending").join(queue.select(*KEY), KEY, "left_anti")
    made = ids.discovery_fingerprint(c("platform"), c("source_id"), c("latest_source_updated_at"), version)
    kept = F.nullif(F.trim("latest_discovery_fingerprint"), F.lit(""))
    return lost.select(*KEY, "url", "title", c("latest_source_updated_at").alias("source_updated_at"),
                       c("latest_source_updated_label").alias("source_updated_label"),
                       F.coalesce(kept, made).alias("revision_fingerprint"), F.lit("backfill").alias("priority"))


def mark_version_reexports(index: DataFrame, platform: str, version: str = ids.HASH_VERSION) -> tuple[DataFrame, DataFrame]:
    """(index, one-row count): entries of the platform exported under another version become pending."""
    stale = ((F.col("platform") == platform) & (F.col("export_state") == "exported")
             & ~F.col("latest_export_version").eqNullSafe(F.lit(version)))
    after = index.withColumn("export_state", F.when(stale, "pending").otherwise(F.col("export_state")))
    return after, index.agg(F.count_if(stale).alias("marked"))


def discovery_quality(sweeps: DataFrame, bucket: str = "hour") -> DataFrame:
    """Sweeps (platform, ts, n) with `quality` and the running `highest`.

    The running maximum is taken within (platform, bucket of time) and completed with the maximum
    of the earlier buckets, so no task reads a platform's whole history.
    """
    c = F.col
    rows = sweeps.withColumn("_b", F.date_trunc(bucket, c("ts").try_cast("timestamp")))
    per = rows.groupBy("platform", "_b").agg(F.max("n").alias("_m"))
    before = W.partitionBy("platform").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    earlier = per.select("platform", "_b", F.max("_m").over(before).alias("_earlier"))
    within = W.partitionBy("platform", "_b").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.max("n").over(within)).join(earlier, ["platform", "_b"])
    seen = F.greatest(F.coalesce("_earlier", F.lit(0)), F.coalesce("_within", F.lit(0)))
    return rows.select("platform", "ts", "n",
                       F.when((c("n") > 0) & (c("n") >= seen), "full").otherwise("partial").alias("quality"),
                       F.greatest(seen, c("n")).alias("highest"))


def history_gap(services: DataFrame) -> DataFrame:
    """Services with `behind`: the last sweep was partial and misses 15 % (at least 25) of the highest count."""
    c = F.col
    gap = c("highest") - c("discovered")
    behind = (c("highest") > 0) & (c("quality") == "partial") & (
        gap >= F.greatest(F.lit(25), F.ceil(c("highest") * F.lit(0.15))))
    return services.withColumn("behind", F.coalesce(behind, F.lit(False)))


def discovery_due(services: DataFrame, now: str, interval_ms: int = 21_600_000) -> DataFrame:
    """Services with `due_at`, `due` and `stale` (twice the interval); no anchor means due and stale."""
    anchor = F.coalesce(epoch_ms(F.col("last_discovery_at")),
                        F.when(F.col("discovered") > 0, epoch_ms(F.col("last_export_at"))))
    due_at = anchor + max(0, interval_ms)
    at = epoch_ms(F.lit(now))
    return services.withColumns({
        "due_at": iso_from_ms(F.coalesce(due_at, F.lit(0))),
        "due": F.coalesce(at >= due_at, F.lit(True)),
        "stale": F.coalesce(at - anchor >= 2 * interval_ms, F.lit(True))})


def normalize_legacy(index: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill what older tables lack: the version from its older column, the platform from the event."""
    if "latest_exporter_version" in index.columns:
        index = index.withColumn("latest_export_version", F.coalesce("latest_export_version", "latest_exporter_version")) \
            .drop("latest_exporter_version")
    if "event_platform" in queue.columns:
        queue = queue.withColumn("platform", F.coalesce("platform", "event_platform")).drop("event_platform")
    defaults = {"kind": F.lit("export"), "priority": F.lit("realtime"), "attempts": F.lit(0)}
    return index, queue.withColumns({n: F.coalesce(F.col(n), v) for n, v in defaults.items() if n in queue.columns})
