"""Derived views.

The driver's tables hold no captures, queues or artifacts, so these views derive them row by row
with SQL that both Spark and the oracle read. `{name}` stands for a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

NOW = "2024-02-01T00:00:00.000Z"

_PLATFORM = ("CASE CAST({0} % 4 AS INT) WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'gemini' "
             "WHEN 2 THEN 'aistudio' ELSE 'deepseek' END")
_ISO = "iso({0})"

VIEWS: dict[str, str] = {
    # One row per message. The four kinds of body: plain, fenced code, thinking, links and files.
    "messages_v": f"""
        SELECT {_PLATFORM.format("conv_id")} AS platform, 'conv-' || conv_id AS source_id,
               turn AS pos, 'm' || turn AS id, role,
               CASE CAST(turn % 4 AS INT)
                 WHEN 0 THEN text
                 WHEN 1 THEN text || chr(10) || chr(10) || '```python' || chr(10) || '# turn ' || turn || chr(10)
                      || chr(10) || 'x = ' || conv_id || chr(10) || '```' || chr(10) || 'done'
                 WHEN 2 THEN '> [thinking]' || chr(10) || '> step ' || turn || chr(10) || '> more' || chr(10)
                      || chr(10) || text
                 ELSE text || chr(10) || chr(10) || '![chart](https://img.example.com/' || (conv_id % 5) || '/'
                      || turn || '.png)' || chr(10) || '> [attachment] [report](https://files.example.com/report-'
                      || conv_id || '.pdf)' || chr(10) || 'See https://example.com/doc-' || turn || '.txt for more'
               END AS markdown,
               iso(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id * 60 + turn AS INT))
                 AS created_at
        FROM {{conversations}}""",
    "bundles_v": f"""
        SELECT {_PLATFORM.format("conv_id")} AS platform, 'conv-' || conv_id AS source_id,
               'https://chat.example.com/c/conv-' || conv_id AS url,
               CASE CAST(conv_id % 5 AS INT) WHEN 0 THEN 'Gemini' WHEN 1 THEN NULL
                 WHEN 2 THEN 'Topic ' || conv_id WHEN 3 THEN 'conv-' || conv_id
                 ELSE 'Plan: "a\\b" ' || conv_id || '?' END AS title,
               iso(TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id AS INT)) AS extracted_at,
               CASE WHEN conv_id % 3 <> 0 THEN
                 iso(TIMESTAMP '2024-01-09 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id AS INT)) END
                 AS source_updated_at,
               CASE WHEN conv_id % 2 = 0 THEN 'model-' || (conv_id % 3) END AS model
        FROM (SELECT conv_id FROM {{conversations}} GROUP BY conv_id) AS c""",
    # One row per discovery event; the fingerprint follows the (often missing) update time.
    "discovery_v": f"""
        SELECT seq, platform, source_id, url, title, source_updated_at, source_updated_label,
               sha2('2026-04-15.2::' || platform || '::' || source_id || '::' || coalesce(source_updated_at, ''), 256)
                 AS revision_fingerprint
        FROM (SELECT event_id AS seq, {_PLATFORM.format("user_id")} AS platform, 'user-' || user_id AS source_id,
                     'https://chat.example.com/c/user-' || user_id || '?v=' || (event_id % 3) AS url,
                     CASE WHEN event_type = 'view' THEN NULL ELSE event_type || ' ' || user_id END AS title,
                     CASE WHEN event_type <> 'error' THEN iso(date_trunc('day', ts)) END AS source_updated_at,
                     CASE WHEN event_id % 4 = 0 THEN (user_id % 9 + 1) || ' days ago' END AS source_updated_label
              FROM {{events}}) AS e""",
    # The state before the events above arrive: most of the conversations are already indexed.
    "index_v": f"""
        SELECT platform, source_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'Indexed ' || user_id END AS title,
               'https://chat.example.com/c/user-' || user_id AS url, iso(first_ts) AS last_seen_at,
               sha2('2026-04-15.2::' || platform || '::' || source_id || '::' || coalesce(updated, ''), 256)
                 AS latest_discovery_fingerprint,
               updated AS latest_source_updated_at,
               CASE WHEN user_id % 3 = 0 THEN '2 days ago' END AS latest_source_updated_label,
               CASE WHEN user_id % 2 = 0 THEN 'complete' ELSE 'partial' END AS discovery_state,
               CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'never_exported' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending'
                 ELSE 'exported' END AS export_state,
               CASE WHEN user_id % 7 > 2 THEN 'rev-' || user_id END AS latest_export_revision,
               CASE WHEN user_id % 7 > 2 THEN CASE WHEN user_id % 4 = 1 THEN '2026-01-01.1' ELSE '2026-04-15.2' END END
                 AS latest_export_version
        FROM (SELECT user_id, {_PLATFORM.format("user_id")} AS platform, CASE WHEN user_id % 6 = 3 THEN 'gone-'
                       ELSE 'user-' END || user_id AS source_id, min(ts) AS first_ts,
                     CASE WHEN user_id % 4 <> 2 THEN iso(max(date_trunc('day', ts))) END AS updated
              FROM {{events}} GROUP BY user_id) AS u""",
    "queue_v": f"""
        SELECT event_id AS pos, platform || ':' || source_id || ':' || fingerprint AS key, platform, source_id, url,
               title, source_updated_at, source_updated_label, fingerprint AS revision_fingerprint, 'export' AS kind,
               CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'realtime' WHEN 1 THEN 'backfill' ELSE 'retry' END
                 AS priority,
               CASE WHEN event_type = 'view' THEN 'worker-' || (user_id % 11) END AS worker_id,
               CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
                 WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 0 THEN 'skipped' ELSE 'cancelled' END END
                 AS status,
               k % 5 AS attempts,
               CASE WHEN event_type = 'error' THEN CASE CAST(k % 4 AS INT) WHEN 0 THEN 'Request timed out'
                 WHEN 1 THEN 'Challenge page detected' WHEN 2 THEN 'Receiving end does not exist'
                 ELSE 'Parse failure ' || k END END AS last_error,
               CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'worker.extract_failed' END AS error_code,
               CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'error') AND event_id % 2 = 0
                 THEN 'latest_exists' END AS skip_reason,
               CASE WHEN event_type = 'purchase' THEN 'rev-' || k END AS result_revision,
               iso(ts) AS discovered_at, iso(ts + INTERVAL '5' MINUTE) AS updated_at
        FROM (SELECT event_id, user_id, event_type, ts, {_PLATFORM.format("user_id")} AS platform,
                     'user-' || user_id AS source_id, 'https://chat.example.com/c/user-' || user_id AS url,
                     CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Queued ' || event_id END AS title,
                     CASE WHEN event_id % 2 = 0 THEN iso(date_trunc('day', ts)) END AS source_updated_at,
                     CASE WHEN event_id % 6 = 1 THEN '3 hours ago' END AS source_updated_label,
                     'fp' || event_id AS fingerprint, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
              FROM {{events}}) AS e""",
    "leases_v": f"""
        SELECT worker_id, platform, CASE WHEN n % 3 <> 0 THEN n END AS tab_id, n % 2 = 0 AS busy, last_active_at
        FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'worker-' ELSE 'spare-' END || (user_id % 11) AS worker_id,
                     {_PLATFORM.format("user_id")} AS platform, count(*) AS n, iso(max(ts)) AS last_active_at
              FROM {{events}} GROUP BY 1, 2) AS w""",
    # One discovery sweep per (platform, day).
    "sweeps_v": f"""
        SELECT platform, iso(day) AS ts, n
        FROM (SELECT {_PLATFORM.format("user_id")} AS platform, date_trunc('day', ts) AS day,
                     count(DISTINCT user_id) AS n
              FROM {{events}} GROUP BY 1, 2) AS s""",
    "services_v": f"""
        SELECT platform, 'running' AS status, platform <> 'aistudio' AS desired_running,
               CAST(0 AS INT) AS active_workers, CAST(0 AS INT) AS active_discovery_tabs,
               CASE WHEN platform <> 'gemini' THEN iso(max_ts) END AS last_discovery_at,
               iso(max_ts) AS last_export_at, n AS discovered,
               CAST(n + floor(n / 4) AS INT) AS highest,
               CASE WHEN platform = 'chatgpt' THEN 'full' ELSE 'partial' END AS quality
        FROM (SELECT {_PLATFORM.format("user_id")} AS platform, max(ts) AS max_ts,
                     CAST(count(DISTINCT user_id) AS INT) AS n
              FROM {{events}} GROUP BY 1) AS p""",
    # Captures arriving at the archive: five possible revisions per conversation.
    "ingest_v": f"""
        SELECT event_id AS seq, {_PLATFORM.format("user_id")} AS platform, 'user-' || user_id AS source_id,
               'rev-' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5) AS revision,
               'https://chat.example.com/c/user-' || user_id AS url,
               CASE WHEN event_type = 'error' THEN NULL ELSE event_type || ' 100%_' || user_id END AS title,
               iso(ts) AS extracted_at,
               CASE WHEN event_type <> 'view' THEN iso(date_trunc('day', ts)) END AS source_updated_at,
               CAST(user_id % 9 AS INT) AS message_count, event_type = 'click' AS has_raw
        FROM {{events}}""",
    # What the archive already held.
    "revisions_v": f"""
        SELECT {_PLATFORM.format("user_id")} AS platform,
               CASE WHEN user_id % 3 = 1 THEN 'user-' ELSE 'gone-' END || user_id AS source_id, 'rev-0' AS revision,
               iso(min(ts)) AS extracted_at, CAST(NULL AS STRING) AS source_updated_at, iso(min(ts)) AS created_at
        FROM {{events}} GROUP BY user_id""",
    "archive_v": f"""
        SELECT {_PLATFORM.format("user_id")} AS platform, 'user-' || user_id AS source_id,
               'Title ' || user_id AS title, 'https://chat.example.com/c/user-' || user_id AS url,
               'rev-' || (user_id % 5) AS latest_revision, CAST(NULL AS STRING) AS latest_source_updated_at,
               iso(min(ts)) AS created_at, iso(date_trunc('hour', max(ts))) AS updated_at,
               CAST(user_id % 9 AS INT) AS message_count, 'p/user-' || user_id || '/bundle.json' AS file_bundle_json,
               'p/user-' || user_id || '/conversation.md' AS file_markdown,
               CASE WHEN user_id % 2 = 0 THEN 'p/user-' || user_id || '/raw-capture.json' END AS file_raw_capture
        FROM {{events}} GROUP BY user_id""",
    # One exported artifact per order; every seventh file is gone from the disk listing.
    "artifacts_v": f"""
        SELECT {_PLATFORM.format("o_custkey")} AS platform, 'cust-' || o_custkey AS source_id,
               'rev-' || o_orderkey AS revision, o_orderkey AS pos,
               CAST(NULL AS BIGINT) AS markdown_download_id, CAST(NULL AS BIGINT) AS bundle_download_id,
               CASE WHEN o_orderkey % 10 <> 3 THEN 'D:\\out\\cust-' || o_custkey || '\\' || o_orderkey || '.md' END
                 AS markdown_filename,
               CASE WHEN o_orderkey % 10 <> 4 THEN 'D:\\out\\cust-' || o_custkey || '\\' || o_orderkey || '.bundle.json'
                 END AS bundle_filename,
               iso(o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 50000 AS INT)) AS exported_at,
               CASE o_orderstatus WHEN 'F' THEN 'present' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0
                 THEN 'skipped_existing' ELSE NULL END ELSE CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'deleted'
                 WHEN 1 THEN 'archived' ELSE 'missing' END END AS local_status,
               o_orderkey % 11 = 0 AS is_latest
        FROM {{orders}}""",
    "files_v": r"""
        SELECT 'd:/OUT/cust-' || o_custkey || '/' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.bak' ELSE '.MD' END
               AS path, iso(o_orderdate) AS mtime FROM {orders}
        UNION ALL
        SELECT 'd:/OUT/cust-' || o_custkey || '/' || o_orderkey || '.bundle.json' AS path, iso(o_orderdate) AS mtime
        FROM {orders}""",
    # Bundle files found on disk: half of them are captures the artifact table does not know.
    "disk_v": f"""
        SELECT {_PLATFORM.format("o_custkey")} AS platform, 'cust-' || o_custkey AS source_id,
               'D:\\out\\cust-' || o_custkey || '\\' || o_orderkey || '.bundle.json' AS file_path,
               CASE WHEN o_orderkey % 2 = 0 THEN 'rev-' ELSE 'disk-' END || o_orderkey AS revision,
               'https://chat.example.com/c/cust-' || o_custkey || '?o=' || o_orderkey AS url,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || o_orderkey ELSE 'ChatGPT' END AS title,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Please ship ' || o_orderkey END AS prompt,
               iso(o_orderdate) AS extracted_at, CASE WHEN o_orderkey % 4 <> 0 THEN iso(o_orderdate) END
                 AS source_updated_at,
               CASE WHEN o_orderkey % 6 = 0 THEN '1 day ago' END AS source_updated_label,
               '2026-04-15.2' AS export_version
        FROM {{orders}}""",
    "artifact_index_v": f"""
        SELECT {_PLATFORM.format("c_custkey")} AS platform,
               CASE WHEN c_custkey % 10 = 9 THEN 'gone-' ELSE 'cust-' END || c_custkey AS source_id,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'About ' || c_name END AS title,
               'https://chat.example.com/c/cust-' || c_custkey AS url, '2024-01-01T00:00:00.000Z' AS last_seen_at,
               'fp-' || c_custkey AS latest_discovery_fingerprint,
               CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01T00:00:00.000Z' END AS latest_source_updated_at,
               CAST(NULL AS STRING) AS latest_source_updated_label, 'complete' AS discovery_state,
               'exported' AS export_state, 'rev-' || (c_custkey * 7) AS latest_export_revision,
               '2026-04-15.2' AS latest_export_version
        FROM {{customer}}""",
    "logs_v": f"""
        SELECT 'log-' || event_id AS id, iso(ts) AS timestamp,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug'
                 ELSE 'info' END AS level,
               CASE WHEN user_id % 5 = 0 THEN 'content.deepseek.' ELSE 'background.' END || event_type AS scope,
               'Handled ' || event_type || ' of user ' || user_id AS message,
               CASE WHEN event_type <> 'view' THEN 'code.' || event_type END AS code,
               CASE WHEN event_id % 3 = 0 THEN 'trace-' || (event_id % 97) END AS trace_id,
               CASE WHEN user_id % 3 = 0 THEN {_PLATFORM.format("user_id")} END AS platform,
               CASE WHEN event_id % 2 = 0 THEN 'user-' || user_id END AS source_id,
               CASE WHEN user_id % 2 = 0 THEN 'worker-' || (user_id % 11) END AS worker_id,
               '{{{{"platform":"' || {_PLATFORM.format("user_id % 7")} || '","sourceId":"user-' || user_id
                 || '","k":' || regexp_extract(props, '([0-9]+)', 1) || '}}}}' AS details
        FROM {{events}}""",
    # Reply trees of 64 events: each event answers the one before it; every fifth skips one, which leaves a side branch.
    "tree_v": """
        SELECT CAST(floor(event_id / 64) AS BIGINT) AS conv, event_id AS node,
               CASE WHEN event_id % 64 = 0 THEN NULL WHEN event_id % 5 = 0 AND event_id % 64 > 1 THEN event_id - 2
                 ELSE event_id - 1 END AS parent
        FROM {events}""",
    # Addresses of every kind the URL helpers tell apart.
    "urls_v": """
        SELECT event_id AS id, CASE CAST(event_id % 9 AS INT)
                 WHEN 0 THEN 'https://chatgpt.com/c/u' || user_id || '?model=' || (user_id % 4)
                 WHEN 1 THEN 'https://chat.deepseek.com/a/chat/s/u-' || user_id
                 WHEN 2 THEN 'https://gemini.google.com/app/g' || user_id || '#top'
                 WHEN 3 THEN 'https://gemini.google.com/app/MyStuff'
                 WHEN 4 THEN 'https://aistudio.google.com/prompts/p' || user_id
                 WHEN 5 THEN 'https://aistudio.google.com/prompts/new_chat'
                 WHEN 6 THEN 'https://Example.com?q=' || user_id || '&archive_worker=1&x'
                 WHEN 7 THEN 'http://10.0.' || (user_id % 200) || '.7:80/a/b.png?archive_discovery=1#frag'
                 ELSE 'http://172.' || (user_id % 40) || '.0.1/files/r-' || user_id || '.pdf?a=1&archive_worker=2&b=2'
               END AS url
        FROM {events}""",
    # Times as payloads carry them: epoch seconds, milliseconds, pairs, dates, labels.
    "times_v": """
        SELECT event_id AS id, '' || (1700000000 + event_id * 997) || '.' || (event_id % 10) || '25' AS seconds,
               '' || (1700000000000 + event_id * 997001) AS millis, '' || (1700000000 + event_id) AS pair_s,
               '' || (event_id * 1234567 % 1000000000) AS pair_n, iso(ts) AS dated,
               CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'today' WHEN 1 THEN ' Yesterday '
                 WHEN 2 THEN (user_id % 50) || ' minutes ago' WHEN 3 THEN '1 week ago'
                 WHEN 4 THEN (user_id % 12) || ' months ago' WHEN 5 THEN 'a while ago' ELSE (user_id % 5) || ' year ago'
               END AS label,
               CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Chat ' || user_id || '  updated 3 Days ago today'
                 WHEN 1 THEN 'Report of Mar ' || (user_id % 28 + 1) || ', 2024 done' WHEN 2 THEN '讨论 ' || user_id || ' 小时前'
                 WHEN 3 THEN 'no label here' ELSE 'saw it just now' END AS text
        FROM {events}""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", sql)))


def _calls(sql: str, name: str, rewrite) -> str:
    """Rewrite every call ``name(arg)`` with balanced parentheses."""
    out, at = "", 0
    for m in re.finditer(rf"\b{name}\(", sql):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        out += sql[at:m.start()] + rewrite(sql[m.end():i - 1])
        at = i
    return out + sql[at:]


def spark_sql(sql: str) -> str:
    """Spark's spelling; raw string literals keep backslashes as they are."""
    sql = _calls(sql, "iso", lambda x: f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")")
    return re.sub(r"'([^'\n]*\\[^'\n]*)'", r"r'\1'", sql)


def duck_sql(sql: str) -> str:
    sql = _calls(sql, "iso", lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')")
    sql = _calls(sql, "sha2", lambda x: "sha256(" + x.rsplit(",", 1)[0] + ")")
    return sql


class Views:
    """The base tables and derived views of one scale directory, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, heavy: bool = False, shares: int = 1):
        # The texts are compared with a UTC oracle.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir, self.heavy, self.shares = spark, sf_dir, heavy, shares
        self._made: dict[str, DataFrame] = {}

    def _spread(self, table: DataFrame) -> DataFrame:
        """For heavy work per row: a table that is read in fewer tasks than there are cores is dealt over them. What the read
        splits spread already is not shuffled, unless a read split is to be dealt into several ``shares``."""
        cores = self.spark.sparkContext.defaultParallelism
        if self.heavy and self.shares > 1:
            return table.repartition(max(cores, self.shares * table.rdd.getNumPartitions()))
        return table.repartition(cores) if self.heavy and table.rdd.getNumPartitions() < cores else table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                made = self._spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
            else:
                sql = VIEWS[name]
                made = self.spark.sql(spark_sql(sql), **{n: getattr(self, n) for n in _names(sql)})
            self._made[name] = made
        return self._made[name]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the views ``body`` names (as `{name}`) become common table expressions before it."""
    defs = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in _names(sql):
            if n in defs and n not in order:
                visit(defs[n])
                order.append(n)

    visit(body)

    def plain(sql: str) -> str:
        return duck_sql(re.sub(r"(?<!\{)\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}"))

    ctes = ",\n".join(f"{n} AS ({plain(defs[n])})" for n in order)
    text = plain(body).strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
