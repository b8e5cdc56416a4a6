"""Discovery, queue, archive, artifact and log tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import KEY, analytics, archive, artifacts, branches, discovery, queue, search
from parley.plans import duck as d
from parley.plans.catalog import query
from parley.plans.views import NOW
from parley.sources.changes import last_of
from parley.streaming import tables as streams

c = F.col
_EV = "platform, source_id, url, title, source_updated_at, source_updated_label, revision_fingerprint"
_IX = ("title, url, last_seen_at, latest_discovery_fingerprint, latest_source_updated_at, latest_source_updated_label, "
       "discovery_state, export_state, latest_export_revision, latest_export_version")

# ---------------------------------------------------------------- discovery

LAST = {"last_v": f"""
    SELECT {_EV}, first_seq, seq FROM (SELECT *, min(seq) OVER w AS first_seq,
      row_number() OVER (PARTITION BY platform, source_id ORDER BY seq DESC) AS r
      FROM {{discovery_v}} WINDOW w AS (PARTITION BY platform, source_id)) AS x WHERE r = 1"""}
JUDGED = {**LAST, "judged_v": f"""
    SELECT coalesce(e.platform, i.platform) AS platform, coalesce(e.source_id, i.source_id) AS source_id,
           e.url AS e_url, e.title AS e_title, e.source_updated_at AS e_at, e.source_updated_label AS e_label,
           e.revision_fingerprint AS e_fp, e.seq IS NOT NULL AS hit, i.url IS NOT NULL AS old,
           {", ".join("i." + x.strip() for x in _IX.split(","))},
           e.seq IS NOT NULL AND (i.url IS NULL
             OR (i.latest_discovery_fingerprint <> e.revision_fingerprint
                 AND NOT (i.latest_source_updated_at IS NOT NULL AND e.source_updated_at IS NULL))
             OR i.export_state <> 'exported'
             OR i.latest_export_version IS DISTINCT FROM '2026-04-15.2') AS enqueue
    FROM {{last_v}} AS e FULL JOIN {{index_v}} AS i ON e.platform = i.platform AND e.source_id = i.source_id"""}


def _after(state: str, export: str) -> str:
    return f"""
    SELECT platform, source_id, coalesce(e_title, title) AS title, coalesce(e_url, url) AS url,
           CASE WHEN hit THEN '{NOW}' ELSE last_seen_at END AS last_seen_at,
           coalesce(e_fp, latest_discovery_fingerprint) AS latest_discovery_fingerprint,
           coalesce(e_at, latest_source_updated_at) AS latest_source_updated_at,
           coalesce(e_label, latest_source_updated_label) AS latest_source_updated_label,
           CASE WHEN hit AND (NOT old OR '{state}' = 'complete') THEN '{state}' ELSE discovery_state END AS discovery_state,
           {export} AS export_state, latest_export_revision, latest_export_version
    FROM {{judged_v}}"""


@query("make_discovery_events", f"SELECT seq, platform, source_id, url, title, {d.FINGERPRINT} AS revision_fingerprint FROM {{discovery_v}}")
def make_discovery_events(v):
    made = discovery.make_discovery_events(v.discovery_v.drop("revision_fingerprint"))
    return made.select("seq", *KEY, "url", "title", "revision_fingerprint")


@query("dedupe_last", f"SELECT {_EV}, seq, first_seq FROM {{last_v}}", LAST)
def dedupe_last(v):
    return discovery.dedupe_last(v.discovery_v)


@query("dedupe_coalesce", """
    SELECT platform, source_id, arg_max(url, seq) AS url, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
           arg_max(source_updated_at, seq) FILTER (WHERE source_updated_at IS NOT NULL) AS source_updated_at,
           arg_max(source_updated_label, seq) FILTER (WHERE source_updated_label IS NOT NULL) AS source_updated_label,
           arg_max(revision_fingerprint, seq) AS revision_fingerprint, max(seq) AS seq, min(seq) AS first_seq
    FROM {discovery_v} GROUP BY 1, 2""")
def dedupe_coalesce(v):
    return discovery.dedupe_coalesce(v.discovery_v)


@query("union_by_priority", """
    SELECT platform, source_id, url, title, source FROM (
      SELECT *, 'merged' AS source, row_number() OVER (PARTITION BY platform, source_id ORDER BY
        CASE WHEN title IS NULL THEN 0 WHEN contains(title, 'click') THEN 2 ELSE 1 END DESC, seq DESC) AS r
      FROM {discovery_v}) AS x WHERE r = 1""")
def union_by_priority(v):
    kind = F.when(c("title").isNull(), 0).when(c("title").contains("click"), 2).otherwise(1)
    rows = v.discovery_v.withColumn("kind", kind)
    buffered, sidebar, api = [rows.where(c("kind") == k).drop("kind") for k in range(3)]
    return discovery.union_by_priority(buffered, sidebar, api).select(*KEY, "url", "title", "source")


@query("upsert_index", _after("complete", "coalesce(export_state, 'never_exported')"), JUDGED)
def upsert_index(v):
    return discovery.upsert_index(v.index_v, discovery.dedupe_last(v.discovery_v), "complete", NOW)


@query("changed_events", "SELECT platform, source_id, e_url AS url, e_title AS title, e_fp AS revision_fingerprint FROM {judged_v} WHERE enqueue", JUDGED)
def changed_events(v):
    out = discovery.changed_events(v.index_v, discovery.dedupe_last(v.discovery_v), "partial", NOW)
    return out["queueable"].select(*KEY, "url", "title", "revision_fingerprint")


@query("changed_counts", "SELECT count(*) FILTER (WHERE hit) AS total, count(*) FILTER (WHERE enqueue) AS queued FROM {judged_v}", JUDGED)
def changed_counts(v):
    return discovery.changed_events(v.index_v, discovery.dedupe_last(v.discovery_v), "partial", NOW)["counts"]


@query("dedupe_then_apply", _after("partial", "CASE WHEN enqueue THEN 'pending' ELSE export_state END"), JUDGED)
def dedupe_then_apply(v):
    return discovery.dedupe_then_apply(v.index_v, v.discovery_v, NOW)["index"]


@query("logged_index", _after("partial", "CASE WHEN enqueue THEN 'pending' ELSE export_state END"), JUDGED)
def logged_index(v):
    """The index after a micro-batch, by the changes that the stream logs of it."""
    changed, _ = streams.index_changes(v.discovery_v, v.index_v, NOW)
    both = v.index_v.withColumn("n", F.lit(-1)).unionByName(changed.withColumn("n", F.lit(0)))
    return last_of(both, KEY, "n").drop("n").select(*v.index_v.columns)


@query("sweep_apply", _after("complete", "CASE WHEN enqueue THEN 'pending' ELSE export_state END"), JUDGED)
def sweep_apply(v):
    return discovery.dedupe_then_apply(v.index_v, v.discovery_v, NOW, sweep=True)["index"]


@query("degraded_events", """
    SELECT platform, source_id FROM {judged_v} WHERE hit AND old AND latest_discovery_fingerprint <> e_fp
      AND latest_source_updated_at IS NOT NULL AND e_at IS NULL AND export_state = 'exported'
      AND latest_export_version = '2026-04-15.2'""", JUDGED)
def degraded_events(v):
    """Events without a time that would have counted as changes: the exported rows the rule leaves alone."""
    events = discovery.dedupe_last(v.discovery_v)
    queued = discovery.changed_events(v.index_v, events, "partial", NOW)["queueable"]
    old = v.index_v.where("export_state = 'exported' AND latest_source_updated_at IS NOT NULL")
    return (events.where("source_updated_at IS NULL").join(old.select(*KEY, "latest_discovery_fingerprint"), KEY)
            .where("latest_discovery_fingerprint <> revision_fingerprint").select(*KEY).join(queued, KEY, "left_anti"))


@query("needs_full_sweep", """
    SELECT coalesce(bool_or(i.export_state IS NULL OR i.export_state <> 'exported'
             OR i.latest_discovery_fingerprint <> e.revision_fingerprint), true) AS needs_sweep
    FROM {last_v} AS e LEFT JOIN {index_v} AS i ON e.platform = i.platform AND e.source_id = i.source_id""", LAST)
def needs_full_sweep(v):
    return discovery.needs_full_sweep(v.index_v, discovery.dedupe_last(v.discovery_v))


_FP_IX = d.FINGERPRINT.replace("source_updated_at", "latest_source_updated_at")


@query("rehydrate_pending", f"""
    SELECT platform, source_id, title, {_FP_IX} AS revision_fingerprint FROM {{index_v}} AS i
    WHERE export_state = 'pending' AND NOT EXISTS (SELECT 1 FROM {{queue_v}} AS q
      WHERE q.platform = i.platform AND q.source_id = i.source_id AND q.status = 'completed')""")
def rehydrate_pending(v):
    blanked = v.index_v.withColumn("latest_discovery_fingerprint", F.lit(" "))
    return discovery.rehydrate_pending(blanked, v.queue_v.where("status = 'completed'")).select(
        *KEY, "title", "revision_fingerprint")


@query("mark_version_reexports", """
    SELECT platform, source_id, CASE WHEN platform = 'gemini' AND export_state = 'exported'
      AND latest_export_version IS DISTINCT FROM '2026-04-15.2' THEN 'pending' ELSE export_state END AS export_state
    FROM {index_v}""")
def mark_version_reexports(v):
    return discovery.mark_version_reexports(v.index_v, "gemini")[0].select(*KEY, "export_state")


@query("discovery_quality", """
    SELECT platform, ts, n, CASE WHEN n > 0 AND n >= seen THEN 'full' ELSE 'partial' END AS quality,
           greatest(seen, n) AS highest
    FROM (SELECT *, coalesce(max(n) OVER (PARTITION BY platform ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS seen FROM {sweeps_v}) AS s""")
def discovery_quality(v):
    return discovery.discovery_quality(v.sweeps_v, "week")


@query("history_gap", """
    SELECT platform, quality = 'partial' AND highest - discovered >= greatest(25, CAST(ceil(highest * 0.15) AS INT)) AS behind
    FROM {services_v}""")
def history_gap(v):
    return discovery.history_gap(v.services_v).select("platform", "behind")


@query("discovery_due", f"""
    SELECT platform, strftime(a + INTERVAL 6 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ') AS due_at,
           TIMESTAMP '2024-01-31 05:00:00' >= a + INTERVAL 6 HOUR AS due, TIMESTAMP '2024-01-31 05:00:00' >= a + INTERVAL 12 HOUR AS stale
    FROM (SELECT *, coalesce(last_discovery_at, last_export_at)::TIMESTAMP AS a FROM {{services_v}}) AS s""")
def discovery_due(v):
    return discovery.discovery_due(v.services_v, "2024-01-31T05:00:00.000Z").select("platform", "due_at", "due", "stale")


@query("normalize_legacy", """
    SELECT platform, source_id, coalesce(latest_export_version, 'old-' || source_id) AS version FROM {index_v}
    UNION ALL SELECT platform, source_id, priority FROM {queue_v}""")
def normalize_legacy(v):
    old_index = v.index_v.withColumn("latest_exporter_version", F.concat(F.lit("old-"), "source_id"))
    old_queue = v.queue_v.withColumnsRenamed({"platform": "event_platform"}).withColumn(
        "platform", F.when(c("attempts") > 2, c("event_platform")))
    index, items = discovery.normalize_legacy(old_index, old_queue)
    return index.select(*KEY, c("latest_export_version").alias("version")).unionByName(
        items.select(*KEY, c("priority").alias("version")))


# ---------------------------------------------------------------- queue

_Q = ("pos, key, platform, source_id, url, title, source_updated_at, source_updated_label, revision_fingerprint, kind, "
      "priority, worker_id, status, attempts, last_error, error_code, skip_reason, result_revision, discovered_at, updated_at")
MERGE = {**LAST, "plan_v": """
    SELECT e.*, e.platform || ':' || e.source_id || ':' || e.revision_fingerprint AS e_key,
           CASE WHEN f.exact THEN e.platform || ':' || e.source_id || ':' || e.revision_fingerprint
                WHEN f.first.status <> 'completed' AND (f.first.source_updated_at IS NULL OR e.source_updated_at IS NULL)
                THEN f.first.key END AS target
    FROM {last_v} AS e LEFT JOIN (
      SELECT q.platform, q.source_id,
             bool_or(q.revision_fingerprint = e.revision_fingerprint) AS exact,
             arg_min({{'key': q.key, 'status': q.status, 'source_updated_at': q.source_updated_at}}, q.pos) AS first
      FROM {queue_v} AS q JOIN {last_v} AS e ON q.platform = e.platform AND q.source_id = e.source_id GROUP BY 1, 2) AS f
    ON e.platform = f.platform AND e.source_id = f.source_id"""}


@query("merge_queue", f"""
    SELECT CASE WHEN dated THEN q.platform || ':' || q.source_id || ':' || e_fp ELSE key END AS key, platform, source_id,
           coalesce(e_url, url) AS url, coalesce(e_title, title) AS title,
           coalesce(e_at, source_updated_at) AS source_updated_at, coalesce(e_label, source_updated_label) AS source_updated_label,
           CASE WHEN dated THEN e_fp ELSE revision_fingerprint END AS revision_fingerprint,
           CASE WHEN reset THEN 'retry' ELSE priority END AS priority, CASE WHEN reset THEN NULL ELSE worker_id END AS worker_id,
           CASE WHEN reset THEN 'pending' ELSE status END AS status, attempts,
           CASE WHEN reset THEN NULL ELSE last_error END AS last_error, discovered_at,
           CASE WHEN hit THEN '{NOW}' ELSE updated_at END AS updated_at
    FROM (SELECT q.*, p.url AS e_url, p.title AS e_title, p.source_updated_at AS e_at, p.source_updated_label AS e_label,
                 p.revision_fingerprint AS e_fp, p.seq IS NOT NULL AS hit,
                 p.seq IS NOT NULL AND q.status <> 'processing' AS reset,
                 p.source_updated_at IS NOT NULL AND q.source_updated_at IS NULL AND p.seq IS NOT NULL AS dated
          FROM {{queue_v}} AS q LEFT JOIN {{plan_v}} AS p ON q.key = p.target) AS q
    UNION ALL
    SELECT e_key, platform, source_id, url, title, source_updated_at, source_updated_label, revision_fingerprint, 'retry', NULL,
           'pending', 0, NULL, '{NOW}', '{NOW}' FROM {{plan_v}} WHERE target IS NULL""", MERGE, heavy=True)
def merge_queue(v):
    events = discovery.dedupe_last(v.discovery_v)
    out = queue.merge_queue(v.queue_v, events, NOW, priority="retry", force=True)
    return out.select(*[x.strip() for x in _Q.split(",") if x.strip() not in (
        "pos", "kind", "error_code", "skip_reason", "result_revision")])


_COLUMNS = [x.strip() for x in _Q.split(",")]


def _row(**values: str) -> str:
    """A queue row as a struct; what is not given is the row ``x``'s own."""
    return "struct_pack(" + ", ".join(f"{n} := {values.get(n, 'x.' + n)}" for n in _COLUMNS) + ")"


# The state of a conversation is its rows, the foremost first; each step applies its next event to that list.
_FOLD_RESET = "x.status <> 'processing'"
_FOLD_DATED = "(e.source_updated_at IS NOT NULL AND x.source_updated_at IS NULL)"
_FOLD_HIT = _row(
    key=f"CASE WHEN {_FOLD_DATED} THEN e.ekey ELSE x.key END",
    revision_fingerprint=f"CASE WHEN {_FOLD_DATED} THEN e.revision_fingerprint ELSE x.revision_fingerprint END",
    **{n: f"coalesce(e.{n}, x.{n})" for n in ("url", "title", "source_updated_at", "source_updated_label")},
    kind="'export'", updated_at=f"'{NOW}'", priority=f"CASE WHEN {_FOLD_RESET} THEN 'backfill' ELSE x.priority END",
    status=f"CASE WHEN {_FOLD_RESET} THEN 'pending' ELSE x.status END",
    worker_id=f"CASE WHEN {_FOLD_RESET} THEN NULL ELSE x.worker_id END",
    last_error=f"CASE WHEN {_FOLD_RESET} THEN NULL ELSE x.last_error END")
_FOLD_NEW = _row(
    pos="e.front - e.seq", key="e.ekey", kind="'export'", priority="'backfill'", status="'pending'", attempts="CAST(0 AS INT)",
    discovered_at=f"'{NOW}'", updated_at=f"'{NOW}'",
    **{n: f"e.{n}" for n in ("platform", "source_id", "url", "title", "source_updated_at", "source_updated_label", "revision_fingerprint")},
    **{n: "CAST(NULL AS VARCHAR)" for n in ("worker_id", "last_error", "error_code", "skip_reason", "result_revision")})


@query("fold_queue", f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY platform, source_id ORDER BY seq) AS n,
      platform || ':' || source_id || ':' || revision_fingerprint AS ekey, (SELECT coalesce(min(pos), 0) - 1 FROM {{queue_v}}) AS front FROM {{discovery_v}}),
    live AS MATERIALIZED (SELECT q.*, q.key IN (SELECT ekey FROM ev) OR q.pos = min(q.pos) OVER (PARTITION BY q.platform, q.source_id) AS involved
      FROM {{queue_v}} AS q WHERE (q.platform, q.source_id) IN (SELECT (platform, source_id) FROM ev)),
    st AS (SELECT k.platform, k.source_id, CAST(0 AS BIGINT) AS n, coalesce((SELECT list({_row()} ORDER BY x.pos) FROM live AS x
        WHERE involved AND x.platform = k.platform AND x.source_id = k.source_id), []) AS state
      FROM (SELECT DISTINCT platform, source_id FROM ev) AS k
      UNION ALL
      SELECT s.platform, s.source_id, s.n + 1, CASE WHEN t IS NULL THEN list_prepend({_FOLD_NEW}, state)
          ELSE list_transform(state, lambda x, i: CASE WHEN i = t THEN {_FOLD_HIT} ELSE x END) END
      FROM (SELECT st.*, coalesce(nullif(list_position(list_transform(state, lambda x: x.key), ev.ekey), 0),
              CASE WHEN len(state) > 0 AND state[1].status <> 'completed' AND (state[1].source_updated_at IS NULL OR ev.source_updated_at IS NULL)
                THEN 1 END) AS t
            FROM st JOIN ev ON ev.platform = st.platform AND ev.source_id = st.source_id AND ev.n = st.n + 1) AS s
      JOIN ev AS e ON e.platform = s.platform AND e.source_id = s.source_id AND e.n = s.n + 1),
    done AS (SELECT unnest(state) AS x FROM st JOIN (SELECT platform, source_id, max(n) AS n FROM ev GROUP BY 1, 2) AS last USING (platform, source_id, n))
    SELECT {", ".join("x." + n for n in _COLUMNS)} FROM done
    UNION ALL SELECT {_Q} FROM live WHERE NOT involved
    UNION ALL SELECT {_Q} FROM {{queue_v}} WHERE (platform, source_id) NOT IN (SELECT (platform, source_id) FROM ev)""", heavy=True)
def fold_queue(v):
    return queue.fold_queue(v.queue_v, v.discovery_v, NOW, priority="backfill", force=True)


_RANK = "CASE priority WHEN 'realtime' THEN 0 WHEN 'retry' THEN 1 ELSE 2 END"


@query("next_pending", f"""
    SELECT platform, key, priority, discovered_at FROM (SELECT *, row_number() OVER (PARTITION BY platform
      ORDER BY {_RANK}, discovered_at, pos) AS r FROM {{queue_v}} WHERE status = 'pending') AS x WHERE r = 1""")
def next_pending(v):
    return queue.next_pending(v.queue_v).select("platform", "key", "priority", "discovered_at")


def _changed(hit: str, **sets: str) -> str:
    cols = [x.strip() for x in _Q.split(",")]
    sets = {"updated_at": f"'{NOW}'", **sets}
    return "SELECT " + ", ".join(
        f"CASE WHEN {hit} THEN {sets[x]} ELSE {x} END AS {x}" if x in sets else x for x in cols) + " FROM {queue_v}"


@query("retry_failed", _changed("status = 'failed'", status="'pending'", priority="'retry'", last_error="NULL"))
def retry_failed(v):
    return queue.retry_failed(v.queue_v, NOW)


_KEY = "chatgpt:user-8:fp0"


@query("edit_queue_rows", f"""
    SELECT pos, key, CASE WHEN key = '{_KEY}' THEN 'cancelled' ELSE status END AS status,
           CASE WHEN key = '{_KEY}' THEN 'Cancelled from dashboard.' ELSE last_error END AS last_error, 'cancel' AS edit
    FROM {{queue_v}}
    UNION ALL SELECT pos, key, CASE WHEN key = '{_KEY}' THEN 'pending' ELSE status END,
           CASE WHEN key = '{_KEY}' THEN NULL ELSE last_error END, 'force' FROM {{queue_v}}
    UNION ALL SELECT pos, key, CASE WHEN key = '{_KEY}' THEN 'failed' ELSE status END,
           CASE WHEN key = '{_KEY}' THEN 'x' ELSE last_error END, 'mark' FROM {{queue_v}}
    UNION ALL SELECT pos, key, status, last_error, 'remove' FROM {{queue_v}} WHERE key <> '{_KEY}'""")
def edit_queue_rows(v):
    q = v.queue_v
    edits = {"cancel": queue.cancel(q, _KEY, NOW), "force": queue.force_export(q, _KEY, NOW),
             "mark": queue.mark_status(q, _KEY, "failed", NOW, "x"), "remove": queue.remove(q, _KEY)}
    out = None
    for name, rows in edits.items():
        part = rows.select("pos", "key", "status", "last_error", F.lit(name).alias("edit"))
        out = part if out is None else out.unionByName(part)
    return out


@query("clear_history", """
    SELECT pos, key, 'history' AS kind FROM {queue_v} WHERE status IN ('pending', 'processing')
    UNION ALL SELECT pos, key, 'statuses' FROM {queue_v} WHERE NOT (platform = 'gemini' AND status IN ('completed', 'skipped'))""")
def clear_history(v):
    history = queue.clear_history(v.queue_v).select("pos", "key", F.lit("history").alias("kind"))
    some = queue.clear_statuses(v.queue_v, ["completed", "skipped"], "gemini")
    return history.unionByName(some.select("pos", "key", F.lit("statuses").alias("kind")))


@query("summarize_queue", "SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in queue.STATUSES) + " FROM {queue_v}")
def summarize_queue(v):
    return queue.summarize_queue(v.queue_v)


_ORPHAN = ("status = 'processing' AND NOT EXISTS (SELECT 1 FROM {leases_v} AS l WHERE l.platform = queue_v.platform "
           "AND l.worker_id = queue_v.worker_id) AND updated_at <= '2024-01-20T11:59:30.000Z'")


@query("recover_orphans", _changed(_ORPHAN, status="'pending'", priority="'retry'", worker_id="NULL", last_error="NULL",
                                   error_code="NULL", updated_at="'2024-01-20T12:00:00.000Z'"))
def recover_orphans(v):
    return queue.recover_orphans(v.queue_v, v.leases_v, "2024-01-20T12:00:00.000Z")


@query("stale_leases", """
    SELECT platform, worker_id, busy AND age >= 90000 AS stale, busy AND tab_id IS NULL AND age >= 30000 AS ghost
    FROM (SELECT *, greatest(0, epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(last_active_at::TIMESTAMP)) AS age FROM {leases_v}) AS l""")
def stale_leases(v):
    return queue.stale_leases(v.leases_v, "2024-01-30T12:00:00.000Z").select("platform", "worker_id", "stale", "ghost")


_RESULTS = """
    SELECT key, platform, source_id, worker_id, skipped, revision FROM (SELECT *, pos % 2 = 0 AS skipped, 'done-' || pos AS revision,
      row_number() OVER (PARTITION BY platform, source_id, worker_id ORDER BY pos) AS r FROM {queue_v} WHERE status = 'processing') AS x
    WHERE r = 1"""


@query("settle_items", f"""
    SELECT q.pos, q.key, CASE WHEN r.key IS NULL THEN q.status WHEN r.skipped THEN 'skipped' ELSE 'completed' END AS status,
           CASE WHEN r.key IS NULL THEN q.worker_id END AS worker_id,
           CASE WHEN r.key IS NULL THEN q.skip_reason WHEN r.skipped THEN 'latest_exists' END AS skip_reason,
           CASE WHEN r.key IS NULL THEN q.result_revision ELSE r.revision END AS result_revision
    FROM {{queue_v}} AS q LEFT JOIN {{results_v}} AS r ON q.key = r.key OR (q.status = 'processing' AND q.platform = r.platform
      AND q.source_id = r.source_id AND q.worker_id = r.worker_id)""", {"results_v": _RESULTS})
def settle_items(v):
    running = v.queue_v.where("status = 'processing'").select(
        "key", *KEY, "worker_id", "pos", (c("pos") % 2 == 0).alias("skipped"),
        F.concat(F.lit("done-"), c("pos").cast("string")).alias("revision"))
    results = running.groupBy(*KEY, "worker_id").agg(
        F.min_by(F.struct("key", "skipped", "revision"), "pos").alias("r")).select(*KEY, "worker_id", "r.*")
    return queue.settle_items(v.queue_v, results, NOW).select("pos", "key", "status", "worker_id", "skip_reason", "result_revision")


_CODE = ("coalesce(error_code, CASE WHEN contains(last_error, 'Receiving end does not exist') THEN 'worker.receiver_unavailable' END,"
         " CASE WHEN contains(lower(last_error), 'timed out') THEN 'worker.navigation_timeout' END)")


@query("classify_failures", f"""
    SELECT pos, CASE WHEN receiver OR challenge THEN 'pending' ELSE 'failed' END AS status,
           CASE WHEN receiver OR challenge THEN 'retry' ELSE priority END AS next_priority,
           CASE WHEN NOT receiver THEN last_error END AS last_error,
           CASE WHEN NOT (receiver OR challenge) THEN code END AS kept_code,
           CASE WHEN challenge THEN '2024-02-01T00:30:00.000Z' END AS cooldown_until
    FROM (SELECT *, coalesce(code = 'worker.receiver_unavailable' AND attempts + 1 < 4, false) AS receiver,
                 platform IN ('gemini', 'aistudio') AND contains(lower(last_error), 'challenge page detected') AS challenge
          FROM (SELECT *, {_CODE} AS code FROM {{queue_v}} WHERE status = 'failed') AS f) AS g""")
def classify_failures(v):
    failed = v.queue_v.where("status = 'failed'").withColumnRenamed("last_error", "error")
    return queue.classify_failures(failed, NOW, retry_limit=2).select(
        "pos", "status", "next_priority", "last_error", "kept_code", "cooldown_until")


_RUNNING = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, source_id, worker_id ORDER BY pos) AS r FROM {queue_v}
      WHERE status = 'processing') AS x WHERE r = 1"""


@query("apply_failures", """
    SELECT q.pos, q.key, CASE WHEN r.key IS NULL THEN q.status WHEN r.attempts + 1 < 4 THEN 'pending' ELSE 'failed' END AS status,
           CASE WHEN r.key IS NULL THEN q.priority WHEN r.attempts + 1 < 4 THEN 'retry' ELSE r.priority END AS priority,
           CASE WHEN r.key IS NULL THEN q.worker_id END AS worker_id,
           CASE WHEN r.key IS NULL THEN q.last_error WHEN r.attempts + 1 >= 4 THEN 'No tab with id 7' END AS last_error,
           CASE WHEN r.key IS NULL THEN q.error_code WHEN r.attempts + 1 >= 4 THEN 'worker.receiver_unavailable' END AS error_code
    FROM {queue_v} AS q LEFT JOIN {running_v} AS r ON q.key = r.key OR (q.status = 'processing' AND q.platform = r.platform
      AND q.source_id = r.source_id AND q.worker_id = r.worker_id)""", {"running_v": _RUNNING})
def apply_failures(v):
    fields = ["key", "attempts", "priority"]
    running = v.queue_v.where("status = 'processing'").groupBy(*KEY, "worker_id").agg(
        F.min_by(F.struct(*fields), "pos").alias("r")).select(*KEY, "worker_id", "r.*")
    failures = running.withColumns({"error": F.lit("No tab with id 7"), "error_code": F.lit(None).cast("string")})
    out = queue.apply_failures(v.queue_v, queue.classify_failures(failures, NOW, retry_limit=2), NOW)
    return out.select("pos", "key", "status", "priority", "worker_id", "last_error", "error_code")


@query("mark_failure_states", """
    SELECT i.platform, i.source_id, CASE WHEN f.source_id IS NOT NULL THEN 'failed' ELSE i.export_state END AS export_state
    FROM {index_v} AS i LEFT JOIN (SELECT DISTINCT platform, source_id FROM {queue_v} WHERE status = 'failed' AND error_code IS NOT NULL) AS f
      ON i.platform = f.platform AND i.source_id = f.source_id""")
def mark_failure_states(v):
    failed = v.queue_v.where("status = 'failed' AND error_code IS NOT NULL").withColumn("error", F.lit("parse failure"))
    return queue.mark_failure_states(v.index_v, queue.classify_failures(failed, NOW)).select(*KEY, "export_state")


@query("reset_in_flight", _changed("status = 'processing'", status="'pending'", worker_id="NULL"))
def reset_in_flight(v):
    return queue.reset_in_flight(v.queue_v, NOW)


# ---------------------------------------------------------------- archive

INGEST = {"ingested_v": """
    SELECT i.*, CASE WHEN r.revision IS NOT NULL OR nth > 1 THEN 'duplicate'
                     WHEN a.source_id IS NOT NULL OR prior > 0 THEN 'updated' ELSE 'created' END AS status
    FROM (SELECT *, sum(CASE WHEN nth = 1 AND NOT stored THEN 1 ELSE 0 END) OVER (PARTITION BY platform, source_id ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
          FROM (SELECT x.*, row_number() OVER (PARTITION BY x.platform, x.source_id, x.revision ORDER BY seq) AS nth,
                       s.revision IS NOT NULL AS stored
                FROM {ingest_v} AS x LEFT JOIN {revisions_v} AS s
                  ON x.platform = s.platform AND x.source_id = s.source_id AND x.revision = s.revision) AS y) AS i
    LEFT JOIN {revisions_v} AS r ON i.platform = r.platform AND i.source_id = r.source_id AND i.revision = r.revision
    LEFT JOIN {held_v} AS a ON i.platform = a.platform AND i.source_id = a.source_id""",
          "held_v": """
    SELECT platform, CASE WHEN message_count % 3 = 1 THEN 'other-' || source_id ELSE source_id END AS source_id, title, url,
           latest_revision, latest_source_updated_at, created_at, updated_at, message_count, file_bundle_json, file_markdown,
           file_raw_capture FROM {archive_v}"""}
_PATH = "platform || '/' || source_id || '/' || revision"


def _held(v):
    return v.archive_v.withColumn("source_id", F.when(c("message_count") % 3 == 1, F.concat(F.lit("other-"), "source_id"))
                                  .otherwise(c("source_id")))


def _ingested(v):
    return archive.ingest(v.ingest_v, _held(v), v.revisions_v)


@query("archive_paths", rf"""
    SELECT seq, p || '/bundle.json' AS bundle_json, p || '/conversation.md' AS markdown,
           CASE WHEN has_raw THEN p || '/raw-capture.json' END AS raw_capture
    FROM (SELECT *, platform || '/' || regexp_replace(source_id || ' ' || coalesce(title, ''), '[^a-zA-Z0-9._-]', '_', 'g')
            || '/' || revision AS p FROM {{ingest_v}}) AS i""")
def archive_paths(v):
    sid = F.concat("source_id", F.lit(" "), F.coalesce("title", F.lit("")))
    paths = archive.archive_paths(c("platform"), sid, c("revision"), c("has_raw"))
    return v.ingest_v.select("seq", paths.alias("p")).select("seq", "p.*")


@query("ingest", f"""
    SELECT seq, platform, source_id, revision, status, platform || ':' || source_id AS conversation_key,
           {_PATH} || '/bundle.json' AS bundle_json FROM {{ingested_v}}""", INGEST)
def ingest(v):
    return _ingested(v).select("seq", *KEY, "revision", "status", "conversation_key", c("files.bundle_json").alias("bundle_json"))


_REVISIONS_AFTER = f"""
    SELECT platform, source_id, revision, extracted_at, source_updated_at, created_at FROM {{revisions_v}}
    UNION ALL SELECT platform, source_id, revision, extracted_at, source_updated_at, '{NOW}' FROM {{ingested_v}}
    WHERE status <> 'duplicate'"""


@query("append_revisions", _REVISIONS_AFTER, INGEST)
def append_revisions(v):
    return archive.append_revisions(v.revisions_v, v.ingest_v, NOW)


_CONVERSATIONS_AFTER = f"""
    SELECT coalesce(n.platform, a.platform) AS platform, coalesce(n.source_id, a.source_id) AS source_id,
           CASE WHEN n.seq IS NULL THEN a.title ELSE n.title END AS title, coalesce(n.url, a.url) AS url,
           coalesce(n.revision, a.latest_revision) AS latest_revision,
           CASE WHEN n.seq IS NULL THEN a.latest_source_updated_at ELSE n.source_updated_at END AS latest_source_updated_at,
           coalesce(a.created_at, '{NOW}') AS created_at, CASE WHEN n.seq IS NULL THEN a.updated_at ELSE '{NOW}' END AS updated_at,
           coalesce(n.message_count, a.message_count) AS message_count,
           coalesce(n.p || '/bundle.json', a.file_bundle_json) AS file_bundle_json,
           coalesce(n.p || '/conversation.md', a.file_markdown) AS file_markdown,
           CASE WHEN n.seq IS NULL THEN a.file_raw_capture WHEN n.has_raw THEN n.p || '/raw-capture.json' END AS file_raw_capture
    FROM {{held_v}} AS a FULL JOIN (SELECT *, {_PATH} AS p FROM (SELECT *, row_number() OVER (PARTITION BY platform, source_id
        ORDER BY seq DESC) AS r FROM {{ingested_v}} WHERE status <> 'duplicate') AS x WHERE r = 1) AS n
    ON a.platform = n.platform AND a.source_id = n.source_id"""


@query("upsert_conversations", _CONVERSATIONS_AFTER, INGEST)
def upsert_conversations(v):
    return archive.upsert_conversations(_held(v), _ingested(v), NOW)


def _logged(v, name: str):
    """A table of the archive after two micro-batches of the captures, by the changes that the stream logs of them."""
    parts = {"conversations": _held(v).withColumn("n", F.lit(-1).cast("bigint")),
             "revisions": v.revisions_v.withColumn("n", F.lit(-1).cast("bigint"))}
    keys = {"conversations": KEY, "revisions": archive.REV}
    middle = v.ingest_v.agg(F.expr("percentile_approx(seq, 0.5)")).scalar()
    for n, batch in enumerate((v.ingest_v.where(c("seq") <= middle), v.ingest_v.where(c("seq") > middle))):
        known = {k: last_of(rows, keys[k], "n").drop("n") for k, rows in parts.items()}
        _, conversations, revisions = streams.ingest_changes(batch, known["conversations"], known["revisions"], NOW)
        for k, rows in (("conversations", conversations), ("revisions", revisions)):
            parts[k] = parts[k].unionByName(rows.withColumn("n", F.lit(n).cast("bigint")))
    return last_of(parts[name], keys[name], "n").drop("n")


@query("logged_conversations", _CONVERSATIONS_AFTER, INGEST)
def logged_conversations(v):
    return _logged(v, "conversations")


@query("logged_revisions", _REVISIONS_AFTER, INGEST)
def logged_revisions(v):
    return _logged(v, "revisions").select("platform", "source_id", "revision", "extracted_at", "source_updated_at", "created_at")


@query("get_conversation", "SELECT platform, source_id, title, latest_revision FROM {archive_v} WHERE platform = 'chatgpt' AND source_id = 'user-8'")
def get_conversation(v):
    return archive.get_conversation(v.archive_v, "chatgpt", "user-8").select(*KEY, "title", "latest_revision")


@query("has_revision", """
    SELECT seq, platform, source_id, revision FROM {ingest_v} AS i WHERE EXISTS (SELECT 1 FROM {revisions_v} AS r
      WHERE r.platform = i.platform AND r.source_id = i.source_id AND r.revision = i.revision)""")
def has_revision(v):
    return archive.has_revision(v.ingest_v, v.revisions_v).select("seq", *KEY, "revision")


_AFTER = "{archive_v} WHERE (lower(source_id) LIKE '%1_%' OR lower(title) LIKE '%1_%')"
_ORDER = "ORDER BY updated_at DESC, platform, source_id"


@query("list_conversations", f"SELECT platform, source_id, title, updated_at FROM {_AFTER} {_ORDER} LIMIT 10")
def list_conversations(v):
    return archive.list_conversations(v.archive_v, q="1_", limit=10).select(*KEY, "title", "updated_at")


@query("search_indexed", f"""
    SELECT q, platform, source_id, title FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY updated_at DESC, platform, source_id) AS rk
      FROM {{archive_v}}, (VALUES ('ITLE 1%4'), ('user-2'), ('r-9'), ('1_'), ('no such title')) AS s(q)
      WHERE lower(source_id) LIKE '%' || lower(q) || '%' OR lower(title) LIKE '%' || lower(q) || '%') AS x WHERE rk <= 20""")
def search_indexed(v):
    """Searches by the trigram index: with a wildcard, with several grams, with one, without any, and without a match."""
    table, found = v.archive_v, None
    index = search.postings(table)
    for q in ("ITLE 1%4", "user-2", "r-9", "1_", "no such title"):
        part = archive.list_conversations(table, q=q, postings=index).select(F.lit(q).alias("q"), *KEY, "title")
        found = part if found is None else found.unionByName(part)
    return found


@query("list_second_page", f"SELECT platform, source_id, title, updated_at FROM {{archive_v}} {_ORDER} LIMIT 10 OFFSET 10")
def list_second_page(v):
    first = archive.list_conversations(v.archive_v, limit=10)
    cursor = archive.next_cursor(first, 10).first()["next_cursor"]
    return archive.list_conversations(v.archive_v, cursor=cursor, limit=10).select(*KEY, "title", "updated_at")


@query("next_cursor", f"""
    SELECT rtrim(replace(replace(to_base64(encode('{{{{"updatedAt":"' || updated_at || '","platform":"' || platform
            || '","sourceId":"' || source_id || '"}}}}')), '+', '-'), '/', '_'), '=') AS next_cursor
    FROM (SELECT * FROM {{archive_v}} {_ORDER} LIMIT 1 OFFSET 11) AS a""")
def next_cursor(v):
    return archive.next_cursor(archive.list_conversations(v.archive_v, limit=12), 12)


@query("conversation_details", """
    SELECT a.platform, a.source_id, a.title, a.file_markdown AS markdown, r.revision
    FROM {archive_v} AS a JOIN {revisions_v} AS r ON a.platform = r.platform AND a.source_id = r.source_id
    WHERE a.platform = 'gemini' AND a.source_id = 'user-13'""")
def conversation_details(v):
    return archive.conversation_details(v.archive_v, v.revisions_v, "gemini", "user-13").select(
        *KEY, "title", c("files.markdown").alias("markdown"), "revision")


@query("to_record", "SELECT platform, source_id, file_bundle_json AS b, file_markdown AS m, file_raw_capture AS r FROM {archive_v}")
def to_record(v):
    return archive.to_record(v.archive_v).select(
        *KEY, c("files.bundle_json").alias("b"), c("files.markdown").alias("m"), c("files.raw_capture").alias("r"))


# ---------------------------------------------------------------- artifacts

_LIVE = "coalesce(local_status, '') NOT IN ('deleted', 'archived')"
_NEW_ART = "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS local_status, true AS is_latest, '2025-01-01T00:00:00.000Z' AS exported_at) FROM {artifacts_v}"


def _top(where: str, order: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, source_id ORDER BY {order}) AS rk "
            f"FROM {{artifacts_v}} WHERE {where}) AS x WHERE rk = 1")


ART = {
    "latest_v": _top(_LIVE, "is_latest DESC, CASE WHEN is_latest THEN NULL ELSE exported_at END DESC, pos"),
    "open_v": _top(f"{_LIVE} AND coalesce(local_status, '') <> 'missing' AND markdown_filename IS NOT NULL",
                   "is_latest DESC, exported_at DESC, pos"),
    "rank_v": "SELECT *, row_number() OVER (PARTITION BY platform, source_id ORDER BY exported_at DESC, pos) AS rk FROM {artifacts_v}",
    "present_v": """
        SELECT a.*, coalesce(a.local_status, '') NOT IN ('deleted', 'archived') AS live,
          (markdown_filename IS NULL OR m.p IS NOT NULL) AND (bundle_filename IS NULL OR b.p IS NOT NULL) AS here
        FROM {artifacts_v} AS a LEFT JOIN {paths_v} AS m ON lower(a.markdown_filename) = m.p
        LEFT JOIN {paths_v} AS b ON lower(a.bundle_filename) = b.p""",
    "paths_v": r"SELECT DISTINCT lower(replace(path, '/', '\')) AS p FROM {files_v}",
}


@query("upsert_artifacts", """
    SELECT platform, source_id, revision, exported_at FROM {artifacts_v} WHERE o_odd = 0
    UNION ALL SELECT platform, source_id, revision, '2025-01-01T00:00:00.000Z' FROM {artifacts_v} WHERE o_odd = 1
    UNION ALL SELECT platform, source_id, 'new-' || revision, '2025-01-01T00:00:00.000Z' FROM {artifacts_v} WHERE o_odd = 0"""
       .replace("{artifacts_v}", "(SELECT *, pos % 2 AS o_odd FROM {artifacts_v}) AS a"))
def upsert_artifacts(v):
    new = v.artifacts_v.withColumns({
        "revision": F.when(c("pos") % 2 == 0, F.concat(F.lit("new-"), "revision")).otherwise(c("revision")),
        "exported_at": F.lit("2025-01-01T00:00:00.000Z")})
    return artifacts.upsert_artifacts(v.artifacts_v, new).select(*KEY, "revision", "exported_at")


@query("latest_artifact", "SELECT platform, source_id, revision, exported_at FROM {latest_v}", ART)
def latest_artifact(v):
    return artifacts.latest_artifact(v.artifacts_v).select(*KEY, "revision", "exported_at")


@query("latest_openable", "SELECT platform, source_id, revision FROM {open_v}", ART)
def latest_openable(v):
    return artifacts.latest_openable(v.artifacts_v).select(*KEY, "revision")


@query("exact_artifact", f"""
    SELECT platform, source_id, revision, local_status FROM {{artifacts_v}} AS a WHERE {_LIVE} AND EXISTS (
      SELECT 1 FROM {{artifact_index_v}} AS i WHERE i.platform = a.platform AND i.source_id = a.source_id
        AND i.latest_export_revision = a.revision)""")
def exact_artifact(v):
    keys = v.artifact_index_v.select(*KEY, c("latest_export_revision").alias("revision"))
    return artifacts.exact_artifact(v.artifacts_v, keys).select(*KEY, "revision", "local_status")


@query("skip_persist", """
    SELECT a.platform, a.source_id, a.revision, coalesce(l.revision = a.revision AND i.latest_export_version = '2026-04-15.2', false) AS skip
    FROM {artifacts_v} AS a LEFT JOIN {latest_v} AS l ON a.platform = l.platform AND a.source_id = l.source_id
    LEFT JOIN {artifact_index_v} AS i ON a.platform = i.platform AND a.source_id = i.source_id""", ART)
def skip_persist(v):
    candidates = v.artifacts_v.select(*KEY, "revision")
    return artifacts.skip_persist(candidates, artifacts.latest_artifact(v.artifacts_v), v.artifact_index_v)


@query("mark_latest", """
    SELECT platform, source_id, revision, rk = 1 AS is_latest, CASE WHEN local_status = 'deleted' THEN 'deleted'
      WHEN rk <= 2 THEN coalesce(local_status, 'present') ELSE 'deleted' END AS local_status FROM {rank_v}""", ART)
def mark_latest(v):
    return artifacts.mark_latest(v.artifacts_v, 2).select(*KEY, "revision", "is_latest", "local_status")


@query("prune_revisions", """
    SELECT platform, source_id, revision, coalesce(rk = 1, false) AS is_latest,
           CASE WHEN rk <= 2 THEN coalesce(local_status, 'present') ELSE 'deleted' END AS local_status, coalesce(rk > 2, false) AS pruned
    FROM (SELECT *, CASE WHEN coalesce(local_status, '') <> 'deleted' THEN row_number() OVER (PARTITION BY platform, source_id,
      coalesce(local_status, '') = 'deleted' ORDER BY exported_at DESC, pos) END AS rk FROM {artifacts_v}) AS x""")
def prune_revisions(v):
    after, pruned = artifacts.prune_revisions(v.artifacts_v, 2)
    gone = pruned.select(*KEY, "revision", F.lit(True).alias("pruned"))
    return after.join(gone, [*KEY, "revision"], "left").select(
        *KEY, "revision", "is_latest", "local_status", F.coalesce("pruned", F.lit(False)).alias("pruned"))


def _exports(v):
    """One new export per conversation: its last order again, or a new revision."""
    last = v.artifacts_v.groupBy(*KEY).agg(F.max("pos").alias("last"))
    c_rev = F.when(c("last") % 2 == 0, F.concat(F.lit("rev-"), c("last").cast("string"))).otherwise(
        F.concat(F.lit("new-"), c("last").cast("string")))
    return last.select(*KEY, c_rev.alias("revision"), c("last").alias("pos"),
                       F.lit(None).cast("bigint").alias("markdown_download_id"), F.lit(None).cast("bigint").alias("bundle_download_id"),
                       F.lit("D:\\n.md").alias("markdown_filename"), F.lit("D:\\n.bundle.json").alias("bundle_filename"),
                       F.lit("2025-01-01T00:00:00.000Z").alias("exported_at"), F.lit("present").alias("local_status"),
                       F.lit(True).alias("is_latest"))


_EXPORTS = """
    SELECT platform, source_id, CASE WHEN max(pos) % 2 = 0 THEN 'rev-' ELSE 'new-' END || max(pos) AS revision FROM {artifacts_v} GROUP BY 1, 2"""


@query("apply_persist", """
    SELECT a.platform, a.source_id, a.revision, false AS is_latest,
           CASE WHEN a.local_status = 'archived' THEN 'archived' ELSE 'deleted' END AS local_status
    FROM {artifacts_v} AS a JOIN {exports_v} AS e ON a.platform = e.platform AND a.source_id = e.source_id AND a.revision <> e.revision
    UNION ALL SELECT platform, source_id, revision, true, 'present' FROM {exports_v}""", {"exports_v": _EXPORTS})
def apply_persist(v):
    out = artifacts.apply_persist(v.artifacts_v, _exports(v), "archive_then_recycle")
    return out.select(*KEY, "revision", "is_latest", "local_status")


@query("retire_previous", rf"""
    SELECT l.platform, l.source_id, l.revision, 'move' AS action, 'archived' AS local_status,
           'D:\out\' || l.source_id AS from_path,
           'E:\arch\export\Archive\' || l.platform || '\' || replace({d.folder("'Doc ' || l.source_id", 'l.source_id')}, '/', '\')
             || '\' || {d.short('l.revision', 12)} AS to_path
    FROM {{latest_v}} AS l JOIN {{exports_v}} AS e ON l.platform = e.platform AND l.source_id = e.source_id AND l.revision <> e.revision""",
       {**ART, "exports_v": _EXPORTS})
def retire_previous(v):
    bundles = _exports(v).select(*KEY, "revision", F.concat(F.lit("Doc "), "source_id").alias("title"))
    out = artifacts.retire_previous(artifacts.latest_artifact(v.artifacts_v), bundles, "archive_then_recycle", NOW, "E:\\arch\\")
    return out.select(*KEY, "revision", "action", "local_status", "from_path", "to_path")


@query("prune_archive", "SELECT path, mtime FROM {files_v} WHERE mtime <= '1995-01-01T00:00:00.000Z'")
def prune_archive(v):
    return artifacts.prune_archive(v.files_v, 7, "1995-01-08T00:00:00.000Z")


@query("verify_presence", """
    SELECT platform, source_id, revision, CASE WHEN live THEN here END AS present,
           CASE WHEN NOT live THEN local_status WHEN NOT here THEN 'missing' WHEN local_status = 'skipped_existing' THEN 'skipped_existing'
             ELSE 'present' END AS local_status, is_latest AND (NOT live OR here) AS is_latest FROM {present_v}""", ART, heavy=True)
def verify_presence(v):
    return artifacts.verify_presence(v.artifacts_v, v.files_v).select(*KEY, "revision", "present", "local_status", "is_latest")


@query("verify_targets", """
    SELECT a.pos, m.p IS NOT NULL AND b.p IS NOT NULL AS present FROM {artifacts_v} AS a
    LEFT JOIN {paths_v} AS m ON m.p = 'd:\\out\\' || a.source_id || '\\' || a.pos || '.md'
    LEFT JOIN {paths_v} AS b ON b.p = 'd:\\out\\' || a.source_id || '\\' || a.pos || '.bundle.json'""".replace("\\\\", "\\"), ART)
def verify_targets(v):
    path = F.concat("source_id", F.lit("/"), c("pos").cast("string"))
    rows = v.artifacts_v.select(*KEY, "revision", "pos", F.concat(path, F.lit(".md")).alias("markdown_path"),
                                F.concat(path, F.lit(".bundle.json")).alias("bundle_path"))
    return artifacts.verify_targets(rows, v.files_v, "D:\\out\\").select("pos", "present")


_MISSING = """
    SELECT DISTINCT p.platform, p.source_id FROM {present_v} AS p JOIN {artifact_index_v} AS i
      ON p.platform = i.platform AND p.source_id = i.source_id
    WHERE p.live AND NOT p.here AND (p.is_latest OR i.latest_export_revision = p.revision)"""


@query("missing_latest", """
    SELECT i.platform, i.source_id, CASE WHEN m.source_id IS NOT NULL THEN 'pending' ELSE i.export_state END AS export_state,
           CASE WHEN m.source_id IS NOT NULL THEN i.latest_discovery_fingerprint END AS requeued
    FROM {artifact_index_v} AS i LEFT JOIN {missing_v} AS m ON i.platform = m.platform AND i.source_id = m.source_id""",
       {**ART, "missing_v": _MISSING}, heavy=True)
def missing_latest(v):
    index, events = artifacts.missing_latest(artifacts.verify_presence(v.artifacts_v, v.files_v), v.artifact_index_v)
    requeued = events.select(*KEY, c("revision_fingerprint").alias("requeued"))
    return index.join(requeued, KEY, "left").select(*KEY, "export_state", "requeued")


DISK = {**ART,
        "disk_seen_v": r"""
    SELECT d.*, p.p IS NOT NULL AS md FROM {disk_v} AS d LEFT JOIN {paths_v} AS p
      ON lower(regexp_replace(file_path, '\.bundle\.json$', '.md')) = p.p""",
        "merged_v": r"""
    SELECT platform, source_id, revision, bool_or(fresh) AS fresh, arg_max(exported_at, fresh) AS exported_at,
           arg_max(local_status, fresh) AS local_status, bool_and(fresh) AS imported, arg_min(apos, fresh) AS apos
    FROM (SELECT platform, source_id, revision, false AS fresh, exported_at, CASE WHEN NOT live THEN local_status WHEN NOT here
            THEN 'missing' WHEN local_status = 'skipped_existing' THEN 'skipped_existing' ELSE 'present' END AS local_status, pos AS apos
          FROM {present_v}
          UNION ALL SELECT platform, source_id, revision, true, extracted_at, CASE WHEN md THEN 'present' ELSE 'missing' END, -1
          FROM {disk_seen_v}) AS u GROUP BY 1, 2, 3"""}


@query("import_bundles", """
    SELECT platform, source_id, revision, exported_at,
           coalesce(local_status, 'present') AS local_status, imported FROM {merged_v}""", DISK, heavy=True)
def import_bundles(v):
    checked = artifacts.verify_presence(v.artifacts_v, v.files_v).select(*v.artifacts_v.columns)
    made = artifacts.import_bundles(v.disk_v, checked, v.artifact_index_v, v.files_v)
    return made["artifacts"].select(*KEY, "revision", "exported_at", "local_status", "imported")


_LAST_ON_DISK = """
    SELECT platform, source_id, arg_max(md, file_path) AS md, arg_max(revision, file_path) AS rev FROM {disk_seen_v} GROUP BY 1, 2"""


def _imported(v):
    checked = artifacts.verify_presence(v.artifacts_v, v.files_v).select(*v.artifacts_v.columns)
    return artifacts.import_bundles(v.disk_v, checked, v.artifact_index_v, v.files_v)


# A conversation's files in path order: the last row, and of title, time and label the last value that is not NULL. Every
# second bundle's own title is a generic one and gives way to the prompt, then to the id.
_FILE_TITLE = "CASE WHEN title <> 'ChatGPT' THEN title ELSE coalesce(prompt, source_id) END"
_KEY_ON_DISK = f"""
    SELECT platform, source_id, arg_max(md, file_path) AS md, arg_max(revision, file_path) AS rev, arg_max(url, file_path) AS url,
      arg_max(CASE WHEN title <> 'ChatGPT' THEN title END, file_path) AS last_titled, arg_max(title, file_path) AS own,
      arg_max({_FILE_TITLE}, file_path) AS event_title, first(prompt ORDER BY file_path DESC) AS prompt,
      first(source_updated_at ORDER BY file_path DESC) AS own_at, arg_max(source_updated_at, file_path) AS last_at,
      arg_max(source_updated_label, file_path) AS label, arg_max(extracted_at, file_path) AS seen
    FROM {{disk_seen_v}} GROUP BY 1, 2"""
_INDEX_AFTER = """
    SELECT coalesce(i.platform, l.platform) AS platform, coalesce(i.source_id, l.source_id) AS source_id,
           CASE WHEN l.md IS NULL THEN i.title WHEN l.own <> 'ChatGPT' THEN l.own ELSE event_title END AS title,
           coalesce(l.url, i.url) AS url, coalesce(l.seen, i.last_seen_at) AS last_seen_at,
           CASE WHEN l.md IS NULL THEN i.latest_discovery_fingerprint
             ELSE sha256('2026-04-15.2::' || l.platform || '::' || l.source_id || '::' || coalesce(l.own_at, '')) END AS latest_discovery_fingerprint,
           coalesce(l.own_at, l.last_at, i.latest_source_updated_at) AS latest_source_updated_at,
           coalesce(l.label, i.latest_source_updated_label) AS latest_source_updated_label,
           CASE WHEN l.md IS NULL THEN i.discovery_state ELSE 'complete' END AS discovery_state,
           CASE WHEN l.md IS NULL THEN {0} WHEN l.md THEN 'exported' ELSE 'pending' END AS export_state,
           CASE WHEN l.md THEN l.rev ELSE i.latest_export_revision END AS latest_export_revision,
           CASE WHEN l.md THEN '2026-04-15.2' ELSE i.latest_export_version END AS latest_export_version
    FROM {{artifact_index_v}} AS i FULL JOIN {{key_disk_v}} AS l ON i.platform = l.platform AND i.source_id = l.source_id"""


@query("import_index", _INDEX_AFTER.format("i.export_state"), {**DISK, "key_disk_v": _KEY_ON_DISK}, heavy=True)
def import_index(v):
    return _imported(v)["index"]


@query("import_requeue", "SELECT platform, source_id FROM {last_disk_v} WHERE NOT md", {**DISK, "last_disk_v": _LAST_ON_DISK}, heavy=True)
def import_requeue(v):
    return _imported(v)["requeue"].select(*KEY)


@query("recompute_latest", f"""
    SELECT a.platform, a.source_id, a.revision, coalesce(b.revision = a.revision, false) AS is_latest FROM {{artifacts_v}} AS a
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, source_id ORDER BY exported_at DESC, pos) AS rk
      FROM {{artifacts_v}} WHERE {_LIVE}) AS x WHERE rk = 1) AS b ON a.platform = b.platform AND a.source_id = b.source_id""")
def recompute_latest(v):
    return artifacts.recompute_latest(v.artifacts_v).select(*KEY, "revision", "is_latest")


@query("final_requeue", """
    SELECT platform, source_id FROM {artifact_index_v} AS i WHERE NOT EXISTS (SELECT 1 FROM {artifacts_v} AS a
      WHERE a.platform = i.platform AND a.source_id = i.source_id AND a.is_latest AND coalesce(a.local_status, '') <> 'missing')""")
def final_requeue(v):
    return artifacts.final_requeue(v.artifact_index_v.select(*KEY), v.artifacts_v)


@query("reconcile_summary", """
    SELECT (SELECT count(*) FROM {present_v} WHERE live) AS verified,
           (SELECT count(*) FROM (SELECT platform, source_id, revision FROM {present_v} WHERE live AND NOT here
              UNION SELECT platform, source_id, revision FROM {disk_seen_v} WHERE NOT md) AS m) AS missing,
           (SELECT count(*) FROM {merged_v} WHERE imported) AS imported""", DISK, heavy=True)
def reconcile_summary(v):
    return artifacts.reconcile(v.artifacts_v, v.artifact_index_v, v.disk_v, v.files_v)["summary"]


@query("reconcile", """
    SELECT a.platform, a.source_id, a.revision, a.local_status, coalesce(b.revision = a.revision, false) AS is_latest
    FROM {merged_v} AS a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, source_id
        ORDER BY exported_at DESC, imported, apos, revision) AS rk FROM {merged_v} WHERE coalesce(local_status, '') NOT IN ('deleted', 'archived'))
      AS x WHERE rk = 1) AS b ON a.platform = b.platform AND a.source_id = b.source_id""", DISK, heavy=True)
def reconcile(v):
    out = artifacts.reconcile(v.artifacts_v, v.artifact_index_v, v.disk_v, v.files_v)
    return out["artifacts"].select(*KEY, "revision", "local_status", "is_latest")


_RECONCILED = {**DISK, "key_disk_v": _KEY_ON_DISK, "missing_v": _MISSING}


@query("reconcile_index", _INDEX_AFTER.format("CASE WHEN m.source_id IS NOT NULL THEN 'pending' ELSE i.export_state END")
       + " LEFT JOIN {missing_v} AS m ON i.platform = m.platform AND i.source_id = m.source_id", _RECONCILED, heavy=True)
def reconcile_index(v):
    return artifacts.reconcile(v.artifacts_v, v.artifact_index_v, v.disk_v, v.files_v)["index"]


@query("reconcile_requeue", """
    SELECT platform, source_id, url, title, source_updated_at, source_updated_label, revision_fingerprint
    FROM (SELECT i.platform, i.source_id, i.url, i.title, i.latest_source_updated_at AS source_updated_at,
            i.latest_source_updated_label AS source_updated_label, i.latest_discovery_fingerprint AS revision_fingerprint
          FROM {artifact_index_v} AS i JOIN {missing_v} AS m ON i.platform = m.platform AND i.source_id = m.source_id
          WHERE NOT EXISTS (SELECT 1 FROM {key_disk_v} AS l WHERE l.platform = i.platform AND l.source_id = i.source_id)
          UNION ALL SELECT platform, source_id, url, event_title, last_at, label,
            sha256('2026-04-15.2::' || platform || '::' || source_id || '::' || coalesce(own_at, '')) FROM {key_disk_v} WHERE NOT md) AS e
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY platform, source_id
        ORDER BY exported_at DESC, imported, apos, revision) AS rk FROM {merged_v} WHERE coalesce(local_status, '') NOT IN ('deleted', 'archived')) AS b
      WHERE rk = 1 AND b.platform = e.platform AND b.source_id = e.source_id AND coalesce(local_status, '') <> 'missing')""", _RECONCILED, heavy=True)
def reconcile_requeue(v):
    return artifacts.reconcile(v.artifacts_v, v.artifact_index_v, v.disk_v, v.files_v)["requeue"]


def _results(v):
    return v.disk_v.withColumn("export_state", F.when(c("title") == "ChatGPT", "pending").otherwise("exported")).groupBy(*KEY).agg(
        F.max_by(F.struct("title", "prompt", "url", "source_updated_at", "revision", "export_state", "export_version"), "file_path")
        .alias("r")).select(*KEY, "r.*")


RESULTS = {"res_v": """
    SELECT * FROM (SELECT *, CASE WHEN title = 'ChatGPT' THEN 'pending' ELSE 'exported' END AS export_state,
      row_number() OVER (PARTITION BY platform, source_id ORDER BY file_path DESC) AS rk FROM {disk_v}) AS x WHERE rk = 1"""}
_RES_TITLE = ("CASE WHEN r.title <> 'ChatGPT' THEN r.title WHEN i.title IS NOT NULL THEN i.title ELSE coalesce(r.prompt, r.source_id) END")


@query("mark_export_result", f"""
    SELECT i.platform, i.source_id, CASE WHEN r.url IS NULL THEN i.title ELSE {_RES_TITLE} END AS title, coalesce(r.url, i.url) AS url,
           coalesce(r.source_updated_at, i.latest_source_updated_at) AS latest_source_updated_at,
           CASE WHEN r.export_state = 'exported' THEN r.revision ELSE i.latest_export_revision END AS latest_export_revision,
           coalesce(r.export_state, i.export_state) AS export_state,
           CASE WHEN r.url IS NULL THEN i.last_seen_at ELSE '{NOW}' END AS last_seen_at
    FROM {{artifact_index_v}} AS i LEFT JOIN {{res_v}} AS r ON i.platform = r.platform AND i.source_id = r.source_id""", RESULTS, heavy=True)
def mark_export_result(v):
    out = artifacts.mark_export_result(v.artifact_index_v, _results(v), NOW)
    return out.select(*KEY, "title", "url", "latest_source_updated_at", "latest_export_revision", "export_state", "last_seen_at")


@query("record_manual_export", """
    SELECT coalesce(i.platform, r.platform) AS platform, coalesce(i.source_id, r.source_id) AS source_id,
           coalesce(r.revision, i.latest_discovery_fingerprint) AS latest_discovery_fingerprint,
           coalesce(r.export_state, i.export_state) AS export_state
    FROM {artifact_index_v} AS i FULL JOIN {res_v} AS r ON i.platform = r.platform AND i.source_id = r.source_id""", RESULTS)
def record_manual_export(v):
    out = artifacts.record_manual_export(v.artifact_index_v, _results(v), NOW)
    return out.select(*KEY, "latest_discovery_fingerprint", "export_state")


@query("mark_export_pending", """
    SELECT i.platform, i.source_id, CASE WHEN EXISTS (SELECT 1 FROM {artifacts_v} AS a WHERE a.platform = i.platform
      AND a.source_id = i.source_id AND a.local_status = 'missing') THEN 'pending' ELSE i.export_state END AS export_state
    FROM {artifact_index_v} AS i""")
def mark_export_pending(v):
    return artifacts.mark_export_pending(v.artifact_index_v, v.artifacts_v.where("local_status = 'missing'")).select(*KEY, "export_state")


@query("clear_platform", """
    SELECT 'queue' AS name, platform, count(*) AS n FROM {queue_v} WHERE platform <> 'gemini' GROUP BY 1, 2
    UNION ALL SELECT 'index', platform, count(*) FROM {index_v} WHERE platform <> 'gemini' GROUP BY 1, 2
    UNION ALL SELECT 'services:' || CASE WHEN platform = 'gemini' THEN 'starting' ELSE status END, platform,
      count(CASE WHEN platform <> 'gemini' THEN last_export_at END) FROM {services_v} GROUP BY 1, 2""")
def clear_platform(v):
    out = artifacts.clear_platform({"queue": v.queue_v, "index": v.index_v, "services": v.services_v}, "gemini", True)
    counted = [out[n].groupBy(F.lit(n).alias("name"), "platform").agg(F.count(F.lit(1)).alias("n")) for n in ("queue", "index")]
    services = out["services"].groupBy(F.concat(F.lit("services:"), "status").alias("name"), "platform").agg(
        F.count("last_export_at").alias("n"))
    return counted[0].unionByName(counted[1]).unionByName(services)


@query("sync_due", """
    SELECT true AS interval_due, count(*) FILTER (WHERE status IN ('pending', 'processing')) = 0 AS idle,
           count(*) FILTER (WHERE status IN ('pending', 'processing')) = 0 AS due FROM {queue_v}""")
def sync_due(v):
    return artifacts.sync_due("2024-01-25T00:00:00.000Z", v.queue_v, NOW)


# ---------------------------------------------------------------- analytics

STATS = {"stats_v": """
    SELECT p.platform, greatest(coalesce(i.n, 0), coalesce(q.ids, 0)) AS discovered, coalesce(i.exported, 0) AS exported,
           coalesce(q.pending, 0) AS pending, coalesce(q.processing, 0) AS processing, coalesce(q.completed, 0) AS completed,
           coalesce(q.failed, 0) AS failed
    FROM (VALUES ('chatgpt'), ('gemini'), ('aistudio'), ('deepseek')) AS p(platform)
    LEFT JOIN (SELECT platform, count(*) AS n, count(*) FILTER (WHERE export_state = 'exported') AS exported FROM {index_v} GROUP BY 1) AS i
      ON i.platform = p.platform
    LEFT JOIN (SELECT platform, count(DISTINCT source_id) AS ids, count(*) FILTER (WHERE status = 'pending') AS pending,
        count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'completed') AS completed,
        count(*) FILTER (WHERE status = 'failed') AS failed FROM {queue_v} GROUP BY 1) AS q ON q.platform = p.platform"""}


@query("platform_stats", "SELECT * FROM {stats_v}", STATS)
def platform_stats(v):
    return analytics.platform_stats(v.queue_v, v.index_v)


@query("service_status", """
    SELECT s.platform, CASE WHEN NOT desired_running THEN 'paused' WHEN t.pending > 0 THEN 'starting' ELSE 'idle' END AS status
    FROM {services_v} AS s JOIN {stats_v} AS t ON s.platform = t.platform""", STATS)
def service_status(v):
    return analytics.service_status(v.services_v, analytics.platform_stats(v.queue_v, v.index_v)).select("platform", "status")


@query("filter_queue", """
    SELECT q.pos, q.key FROM {queue_v} AS q LEFT JOIN {index_v} AS i ON q.platform = i.platform AND q.source_id = i.source_id
    WHERE q.platform = 'gemini' AND status = 'failed' AND contains(lower(concat_ws(' ', nullif(q.title, ''), q.source_id, last_error,
      q.url, error_code, skip_reason, latest_source_updated_label, latest_source_updated_at)), 'timed')""")
def filter_queue(v):
    return analytics.filter_queue(v.queue_v, v.index_v, "gemini", "failed", "Timed").select("pos", "key")


_WEB = ("coalesce(epoch_ms(latest_source_updated_at::TIMESTAMP), CASE WHEN latest_source_updated_label = '2 days ago' "
        "THEN epoch_ms(TIMESTAMP '2024-01-30 00:00:00') ELSE 0 END, 0)")


@query("sort_queue", f"""
    SELECT pos, key FROM (SELECT q.*, {_WEB} AS w FROM {{queue_v}} AS q LEFT JOIN {{index_v}} AS i ON q.platform = i.platform
      AND q.source_id = i.source_id) AS s ORDER BY w DESC, updated_at DESC, pos""", heavy=True)
def sort_queue(v):
    return analytics.sort_queue(v.queue_v, v.index_v, v.artifacts_v, "website_time", "desc", F.lit(NOW)).select("pos", "key")


@query("page", "SELECT pos, key FROM {queue_v} ORDER BY pos DESC LIMIT 100 OFFSET 100")
def page(v):
    return analytics.page(v.queue_v, [("pos", False)], 2).select("pos", "key")


@query("page_deep", """
    SELECT pos, key FROM (SELECT *, row_number() OVER (ORDER BY worker_id NULLS FIRST, updated_at DESC, pos) - 1 AS place,
      count(*) OVER () AS n FROM {queue_v}) AS q WHERE place // 100 = (n - 1) // 100""")
def page_deep(v):
    """The last page, asked for by a number beyond it; equal and missing workers."""
    order = [("worker_id", True), ("updated_at", False), ("pos", True)]
    return analytics.page(v.queue_v, order, 1_000_000_000).select("pos", "key")


@query("filter_logs", """
    SELECT id FROM {logs_v} WHERE level IN ('info', 'error') AND coalesce(platform, json_extract_string(details, '$.platform')) = 'gemini'
      AND contains(lower(concat_ws(' ', scope, code, message, details)), 'error')""")
def filter_logs(v):
    return analytics.filter_logs(v.logs_v, ["info", "error"], platform="gemini", search="ERROR").select("id")


@query("log_facets", """
    SELECT 'scope' AS facet, 'all' AS value UNION ALL SELECT 'code', 'all'
    UNION ALL SELECT DISTINCT 'scope', scope FROM {logs_v}
    UNION ALL SELECT DISTINCT 'code', code FROM {logs_v} WHERE code IS NOT NULL""")
def log_facets(v):
    return analytics.log_facets(v.logs_v)


@query("related_logs", """
    SELECT id, timestamp FROM {logs_v} WHERE coalesce(source_id, json_extract_string(details, '$.sourceId')) =
      (SELECT coalesce(source_id, json_extract_string(details, '$.sourceId')) FROM {logs_v} WHERE id = 'log-7')""")
def related_logs(v):
    return analytics.related_logs(v.logs_v, v.logs_v.where("id = 'log-7'")).select("id", "timestamp")


@query("index_map", """
    SELECT platform, source_id, 'index' AS kind FROM {index_v} WHERE platform = 'gemini'
    UNION ALL SELECT platform, source_id, 'openable' FROM {open_v} WHERE platform = 'gemini'""", ART)
def index_map(v):
    index = analytics.index_map(v.index_v, "gemini").select(*KEY, F.lit("index").alias("kind"))
    return index.unionByName(analytics.openable_artifacts(v.artifacts_v, "gemini").select(*KEY, F.lit("openable").alias("kind")))


@query("missing_local", """
    SELECT pos, key FROM {queue_v} AS q WHERE status <> 'processing' AND NOT EXISTS (SELECT 1 FROM {index_v} AS i
      WHERE i.platform = q.platform AND i.source_id = q.source_id AND i.export_state = 'exported')""")
def missing_local(v):
    return analytics.missing_local(v.queue_v, v.index_v.where("export_state = 'exported'")).select("pos", "key")


@query("retain_logs", "SELECT id, timestamp FROM {logs_v} ORDER BY timestamp DESC, id DESC LIMIT 400")
def retain_logs(v):
    return analytics.retain_logs(v.logs_v).select("id", "timestamp")


@query("active_branch", """
    WITH RECURSIVE walk AS (
      SELECT conv, max(node) AS node, CAST(0 AS BIGINT) AS depth FROM {tree_v} GROUP BY conv
      UNION ALL SELECT w.conv, t.parent, w.depth + 1 FROM walk AS w JOIN {tree_v} AS t ON t.conv = w.conv AND t.node = w.node
      WHERE t.parent IS NOT NULL)
    SELECT conv, node, depth, max(depth) OVER (PARTITION BY conv) - depth AS pos FROM walk""")
def active_branch(v):
    heads = v.tree_v.groupBy("conv").agg(F.max("node").alias("node"))
    return branches.active_branch(v.tree_v, heads)


@query("logged_tail", """
    SELECT id, timestamp FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS rk FROM {logs_v}) AS x WHERE rk <= 300""")
def logged_tail(v):
    """The tail of the logs after three micro-batches, each logged cut to its newest rows."""
    parts = [analytics.retain_logs(v.logs_v.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i), 300).withColumn("n", F.lit(i)) for i in range(3)]
    log = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return analytics.retain_logs(last_of(log, ["id"], "n"), 300).select("id", "timestamp")
