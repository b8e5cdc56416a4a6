"""Scalar helpers applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import identity as ids
from parley.functions import markdown as md
from parley.functions import text as tx
from parley.functions import times as tm
from parley.functions import urls as ur
from parley.operators import KEY, analytics, conversations
from parley.plans import duck as d
from parley.plans.catalog import query
from parley.plans.views import NOW

c = F.col


@query("bundle_revision", """
    SELECT b.platform, b.source_id,
           sha256('2026-04-15.2::' || b.platform || '::' || b.source_id || '::' || url || '::' || coalesce(title, '')
             || '::' || coalesce(source_updated_at, '') || '::' || coalesce(lines, '')) AS revision
    FROM {bundles_v} AS b LEFT JOIN (
      SELECT platform, source_id, string_agg(id || ':' || role || ':' || markdown, chr(10) ORDER BY pos) AS lines
      FROM {messages_v} GROUP BY 1, 2) AS m ON b.platform = m.platform AND b.source_id = m.source_id""", heavy=True)
def bundle_revision(v):
    return conversations.revise(v.bundles_v, v.messages_v)


@query("discovery_fingerprint", f"SELECT seq, {d.FINGERPRINT} AS fingerprint FROM {{discovery_v}}")
def discovery_fingerprint(v):
    return v.discovery_v.select("seq", ids.discovery_fingerprint(
        c("platform"), c("source_id"), c("source_updated_at")).alias("fingerprint"))


@query("table_keys", """
    SELECT pos, platform || ':' || source_id || ':' || revision_fingerprint AS queue_key,
           platform || ':' || source_id AS conversation_key,
           '["' || platform || '","' || source_id || '","' || revision_fingerprint || '"]' AS artifact_key
    FROM {queue_v}""")
def table_keys(v):
    key = (c("platform"), c("source_id"), c("revision_fingerprint"))
    return v.queue_v.select("pos", ids.queue_key(*key).alias("queue_key"),
                            ids.conversation_key(*key[:2]).alias("conversation_key"),
                            ids.artifact_key(*key).alias("artifact_key"))


@query("normalize_title", f"""
    SELECT platform, source_id, {d.norm_title('title', 'source_id')} AS title FROM {{bundles_v}}""")
def normalize_title(v):
    return v.bundles_v.select(*KEY, tx.normalize_title(c("title"), c("source_id")).alias("title"))


@query("generic_titles", f"""
    SELECT seq, {d.generic('title', 'source_id')} AS is_generic,
           regexp_matches(left(revision_fingerprint, 12), '^[0-9a-f]{{{{8,}}}}$') AS is_opaque,
           regexp_matches(source_id, '^[0-9a-f]{{{{8,}}}}$') AS is_opaque_source
    FROM {{discovery_v}}""")
def generic_titles(v):
    return v.discovery_v.select(
        "seq", tx.is_generic_title(c("title"), c("source_id")).alias("is_generic"),
        tx.is_opaque_id(F.substring("revision_fingerprint", 1, 12)).alias("is_opaque"),
        tx.is_opaque_id(c("source_id")).alias("is_opaque_source"))


@query("strip_markdown", f"SELECT platform, source_id, pos, {d.strip_md('markdown')} AS flat FROM {{messages_v}}", heavy=True)
def strip_markdown(v):
    return v.messages_v.select(*KEY, "pos", tx.strip_markdown(c("markdown")).alias("flat"))


@query("canonical_url", r"""
    SELECT id, regexp_replace(lower(origin), '^(http://.*):80$', '\1') || CASE WHEN path = '' THEN '/' ELSE path END
           || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END || fragment AS url
    FROM (SELECT id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS origin,
                 regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
                 list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^archive_(worker|discovery)(=|$)')),
                   lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS kept,
                 regexp_extract(url, '#.+$') AS fragment
          FROM {urls_v}) AS u""")
def canonical_url(v):
    return v.urls_v.select("id", ur.canonical_url(c("url")).alias("url"))


@query("source_id_from_url", r"""
    SELECT id, nullif(regexp_extract(url, '/c/([^/?#]+)', 1), '') AS chatgpt,
           nullif(regexp_extract(url, '(?i)^https?://chat\.deepseek\.com/a/chat/(?:s/)?([a-zA-Z0-9-]+)', 1), '') AS deepseek,
           CASE WHEN lower(g) NOT IN ('', 'mystuff') THEN g END AS gemini,
           CASE WHEN a NOT IN ('', 'new_chat') THEN a END AS aistudio
    FROM (SELECT *, regexp_extract(url, '(?i)/app/([^/?#]+)', 1) AS g,
                 regexp_extract(url, '(?i)/prompts/([^/?#]+)', 1) AS a FROM {urls_v}) AS u""")
def source_id_from_url(v):
    return v.urls_v.select("id", *[ur.source_id_from_url(c("url"), p).alias(p) for p in ur.SOURCE_ID_PATTERNS])


@query("platform_from_url", r"""
    SELECT id, CASE WHEN regexp_matches(url, '(?i)^https://chatgpt\.com/c/') THEN 'chatgpt'
           WHEN regexp_matches(url, '(?i)^https://chat\.deepseek\.com/a/chat/') THEN 'deepseek'
           WHEN regexp_matches(url, '(?i)^https://gemini\.google\.com/app/') THEN 'gemini'
           WHEN regexp_matches(url, '(?i)^https://aistudio\.google\.com/prompts/')
             AND NOT regexp_matches(url, '(?i)/prompts/new_chat') THEN 'aistudio' END AS platform
    FROM {urls_v}""")
def platform_from_url(v):
    return v.urls_v.select("id", ur.platform_from_url(c("url")).alias("platform"))


@query("normalize_timestamp", f"""
    SELECT id, {d.iso_ms('floor(seconds::DECIMAL(18,3) * 1000)')} AS number_seconds,
           {d.iso_ms('millis::DECIMAL(38,3)')} AS number_millis,
           {d.iso_ms('floor(seconds::DECIMAL(18,3) * 1000)')} AS text_seconds,
           {d.iso_ms('millis::DECIMAL(38,3)')} AS text_millis, dated AS text_date,
           CAST(NULL AS VARCHAR) AS list_numeric_text, label AS kept_text,
           {d.iso_ms('pair_s::BIGINT * 1000 + pair_n::BIGINT // 1000000')} AS pair
    FROM {{times_v}}""")
def normalize_timestamp(v):
    n = tm.normalize_timestamp
    return v.times_v.select(
        "id", n(c("seconds"), "chatgpt_payload", True).alias("number_seconds"),
        n(c("millis"), "chatgpt_list", True).alias("number_millis"),
        n(c("seconds"), "deepseek_list", False).alias("text_seconds"),
        n(c("millis"), "deepseek_message", False).alias("text_millis"),
        n(c("dated"), "chatgpt_payload", False).alias("text_date"),
        n(c("millis"), "chatgpt_list", False).alias("list_numeric_text"),
        n(c("label"), "deepseek_message", False).alias("kept_text"),
        tm.iso_from_pair(c("pair_s"), c("pair_n")).alias("pair"))


@query("extract_time_label", rf"""
    SELECT id, coalesce(
      nullif(regexp_extract(t, '(?i)\b((?:today|yesterday|just now|last week|last month|a few seconds ago|a minute ago|an hour ago)|\d+\s+(?:minute|hour|day|week|month|year)s?\s+ago)\b', 1), ''),
      nullif(regexp_extract(t, '(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{{{{1,2}}}}(?:,\s+\d{{{{4}}}})?)\b', 1), ''),
      nullif(regexp_extract(t, '(\d+\s*(?:分钟|小时|天|周|月|年)前|刚刚|今天|昨天|前天)', 1), '')) AS label
    FROM (SELECT id, {d.collapse('text')} AS t FROM {{times_v}}) AS x""")
def extract_time_label(v):
    return v.times_v.select("id", tm.extract_time_label(c("text")).alias("label"))


@query("relative_label_to_ts", rf"""
    SELECT id, CASE WHEN l = 'today' THEN '{NOW}'
      WHEN l = 'yesterday' THEN strftime(TIMESTAMP '2024-01-31 00:00:00', '%Y-%m-%dT%H:%M:%S.%gZ')
      ELSE strftime(TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1 SECOND * (try_cast(regexp_extract(l, '^(\d+) ', 1) AS INT)
        * CASE regexp_extract(l, '^\d+ (minute|week|month|year)s? ago$', 1) WHEN 'minute' THEN 60 WHEN 'week' THEN 604800
          WHEN 'month' THEN 2592000 WHEN 'year' THEN 31536000 END), '%Y-%m-%dT%H:%M:%S.%gZ') END AS at
    FROM (SELECT id, lower(trim(label)) AS l FROM {{times_v}}) AS x""")
def relative_label_to_ts(v):
    return v.times_v.select("id", tm.relative_label_to_ts(c("label"), F.lit(NOW)).alias("at"))


@query("format_message_timestamp", """
    SELECT id, strftime(dated::TIMESTAMP + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || ' (UTC+05:30)' AS shown,
           label AS kept
    FROM {times_v}""")
def show_timestamp(v):
    return v.times_v.select("id", tm.format_message_timestamp(c("dated"), "Asia/Kolkata").alias("shown"),
                            tm.format_message_timestamp(c("label")).alias("kept"))


@query("estimate_tokens", f"""
    SELECT doc_id, n AS tokens, {d.token_label('n')} AS label
    FROM (SELECT doc_id, {d.tokens('text')} AS n FROM {{documents}}) AS x""", heavy=True)
def estimate_tokens(v):
    n = tx.estimate_tokens(c("text"))
    return v.documents.select("doc_id", n.alias("tokens"), tx.format_token_count(n).alias("label"))


@query("format_file_size", """
    SELECT o_orderkey, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576
             THEN printf('%.2fKB', ((b * 200 + 1024) // 2048) / 100.0::DOUBLE)
             ELSE printf('%.2fMB', ((b * 200 + 1048576) // 2097152) / 100.0::DOUBLE) END AS size
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice / 997) AS BIGINT) AS b FROM {orders}) AS o""")
def format_file_size(v):
    b = F.floor(c("o_totalprice") * c("o_totalprice") / 997).cast("bigint")
    return v.orders.select("o_orderkey", tx.format_file_size(b).alias("size"))


@query("path_segment", f"""
    SELECT platform, source_id, pos, {d.segment('left(markdown, 90)')} AS segment FROM {{messages_v}}""", heavy=True)
def path_segment(v):
    return v.messages_v.select(*KEY, "pos", tx.path_segment(F.substring("markdown", 1, 90)).alias("segment"))


@query("folder_names", f"""
    SELECT platform, source_id, {d.folder('title', 'source_id')} AS folder,
      coalesce(nullif({d.segment(f'''left({d.gsub("coalesce(nullif(trim(title), ''), source_id)", d.WS + '+', "' '")}, 80)''')}, ''),
        {d.segment('source_id')}) AS base_name,
      'export/' || {d.segment('platform')} || '/' || {d.folder('title', 'source_id')} AS prefix,
      'export/Archive/' || {d.segment('platform')} || '/' || {d.folder('title', 'source_id')} || '/'
        || {d.short("'r-' || url", 12)} AS archived_prefix
    FROM {{bundles_v}}""")
def folder_names(v):
    p, s, t = c("platform"), c("source_id"), c("title")
    return v.bundles_v.select(
        *KEY, tx.folder_name(t, s).alias("folder"), tx.artifact_base_name(t, s).alias("base_name"),
        tx.archive_prefix(p, t, s).alias("prefix"),
        tx.archived_revision_prefix(p, t, s, F.concat(F.lit("r-"), c("url"))).alias("archived_prefix"))


@query("cursor_codec", """
    SELECT platform, source_id, cursor, platform AS back_platform, source_id AS back_id, updated_at AS back_at,
           true AS malformed_is_null
    FROM (SELECT *, rtrim(replace(replace(to_base64(encode('{{"updatedAt":"' || updated_at || '","platform":"' || platform
            || '","sourceId":"' || source_id || '"}}')), '+', '-'), '/', '_'), '=') AS cursor FROM {archive_v}) AS a""")
def cursor_codec(v):
    cur = ids.encode_cursor(c("updated_at"), c("platform"), c("source_id"))
    rows = v.archive_v.withColumn("cursor", cur).withColumn("back", ids.decode_cursor(c("cursor")))
    return rows.select(*KEY, "cursor", c("back.platform").alias("back_platform"),
                       c("back.sourceId").alias("back_id"), c("back.updatedAt").alias("back_at"),
                       ids.decode_cursor(F.concat(F.lit("%"), "source_id")).isNull().alias("malformed_is_null"))


@query("yaml_quote", f"""
    SELECT platform, source_id, pos, {d.yaml('markdown')} AS quoted, CAST(pos AS VARCHAR) AS number,
           {d.yaml('title')} AS title
    FROM {{messages_v}} JOIN {{bundles_v}} USING (platform, source_id)""")
def yaml_quote(v):
    rows = v.messages_v.join(v.bundles_v.select(*KEY, "title"), KEY)
    return rows.select(*KEY, "pos", tx.yaml_quote(c("markdown")).alias("quoted"),
                       tx.yaml_quote(c("pos"), numeric=True).alias("number"), tx.yaml_quote(c("title")).alias("title"))


@query("normalize_role", """
    SELECT platform, source_id, pos, CASE WHEN role IN ('user', 'assistant', 'system') THEN role END AS chatgpt,
           CASE WHEN role IN ('user', 'assistant') THEN role END AS deepseek,
           CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS label,
           CASE WHEN role = 'user' THEN 'Tool bot' ELSE 'Other' || role END AS other_label
    FROM {messages_v}""")
def normalize_role(v):
    names = F.create_map(F.lit("xuser"), F.lit("Tool bot"))
    other = F.when(c("role") == "user", "xUser").otherwise(F.concat(F.lit("other"), c("role")))
    return v.messages_v.select(
        *KEY, "pos", tx.normalize_role(c("role"), "chatgpt").alias("chatgpt"),
        tx.normalize_role(F.upper("role"), "deepseek").alias("deepseek"),
        tx.role_label(F.upper("role")).alias("label"), tx.role_label(other, names).alias("other_label"))


@query("mime_types", r"""
    SELECT id, CASE regexp_extract(lower(url), '\.(png|pdf)\z', 1) WHEN 'png' THEN 'image/png' ELSE 'image/png' END AS mime,
           CASE WHEN ext = 'jpg' OR ext = 'jpeg' THEN 'image/jpeg' WHEN ext = 'svg' THEN 'image/svg+xml'
             ELSE 'image/' || ext END AS named_mime,
           CASE WHEN ext = 'jpeg' THEN 'jpg' ELSE ext END AS extension, 'bin' AS no_extension
    FROM (SELECT *, ['jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp', 'svg'][CAST(id % 7 AS INT) + 1] AS ext FROM {urls_v}) AS u""")
def mime_types(v):
    ext = F.get(F.array(*[F.lit(x) for x in ("jpg", "jpeg", "png", "webp", "gif", "bmp", "svg")]), (c("id") % 7).cast("int"))
    named = tx.mime_from_filename(F.concat(F.lit(" Photo."), F.upper(ext)))
    by_mime = tx.extension_from_mime(F.when(ext == "svg", "image/svg+xml").otherwise(F.concat(F.lit("Image/"), ext)))
    return v.urls_v.select("id", tx.mime_from_filename(c("url")).alias("mime"), named.alias("named_mime"),
                           by_mime.alias("extension"), tx.extension_from_mime(F.lit("image")).alias("no_extension"))


@query("is_private_host", r"""
    SELECT id, h AS host, regexp_matches(h, '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.)') AS is_private,
           false AS named_is_private
    FROM (SELECT id, regexp_extract(url, '://([^:/?#]*)', 1) AS h FROM {urls_v}) AS u""")
def is_private_host(v):
    host = ur.host_of(c("url"))
    return v.urls_v.select("id", host.alias("host"), ur.is_private_host(host).alias("is_private"),
                           ur.is_private_host(F.lit("fc-name.example")).alias("named_is_private"))


_URLS = r"regexp_extract_all(markdown, 'https?://[^\s)]+')"
_IMG = r"'(?i)\.(png|jpe?g|webp|gif|bmp|svg)(\?|#|$)'"
_DOC = r"'(?i)\.(pdf|docx?|xlsx?|pptx?|txt|csv|tsv|md)(\?|#|$)'"


@query("classify_urls", f"""
    SELECT platform, source_id, pos,
           array_to_string(list_filter({_URLS}, lambda u: regexp_matches(u, {_IMG})), ' ') AS images,
           array_to_string(list_filter({_URLS}, lambda u: NOT regexp_matches(u, {_IMG}) AND regexp_matches(u, {_DOC})), ' ')
             AS documents
    FROM {{messages_v}}""")
def classify_urls(v):
    found = ur.classify_urls(c("markdown"))
    return v.messages_v.select(*KEY, "pos", F.array_join(found["images"], " ").alias("images"),
                               F.array_join(found["documents"], " ").alias("documents"))


@query("append_url_attachments", rf"""
    SELECT platform, source_id, pos, CASE WHEN len(blocks) = 0 THEN markdown ELSE
           {d.jtrim("markdown || chr(10) || chr(10) || array_to_string(blocks, chr(10) || chr(10))")} END AS markdown
    FROM (SELECT *, list_concat(
        list_transform(list_filter({_URLS}, lambda u: regexp_matches(u, {_IMG})),
          lambda u: '![' || regexp_extract(u, '([^/?]*)(\?.*)?$', 1) || '](' || u || ')'),
        list_transform(list_filter({_URLS}, lambda u: NOT regexp_matches(u, {_IMG}) AND regexp_matches(u, {_DOC})),
          lambda u: '> [attachment] [' || regexp_extract(u, '([^/?]*)(\?.*)?$', 1) || '](' || u || ')')) AS blocks
      FROM {{messages_v}}) AS m""", heavy=True)
def append_url_attachments(v):
    return v.messages_v.select(*KEY, "pos", ur.append_url_attachments(c("markdown")).alias("markdown"))


@query("meta_fields", """
    SELECT pos, trim(worker_id) AS model, CAST(NULL AS VARCHAR) AS count, concat_ws(', ', 'search', title) AS tools FROM {queue_v}""")
def meta_fields(v):
    meta = F.to_json(F.struct(F.concat(F.lit(" "), "model").alias("model"), c("pos").alias("count"),
                              F.array(F.lit("search"), F.lit(" "), c("title")).alias("tools")))
    rows = v.queue_v.withColumn("model", c("worker_id")).withColumn("meta", meta)
    return rows.select("pos", tx.meta_string(c("meta"), "model").alias("model"),
                       tx.meta_string(c("meta"), "count").alias("count"),
                       F.array_join(tx.meta_strings(c("meta"), "tools"), ", ").alias("tools"))


@query("safe_fence", """
    SELECT platform, source_id, pos, f || 'text' || chr(10) || body || chr(10) || f AS fenced
    FROM (SELECT *, repeat('~', greatest(3, CAST(pos AS INT) + 1)) AS f,
                 markdown || chr(10) || repeat('~', CAST(pos AS INT)) AS body FROM {messages_v}) AS m""")
def safe_fence(v):
    body = F.concat("markdown", F.lit("\n"), F.repeat(F.lit("~"), c("pos").cast("int")))
    return v.messages_v.select(*KEY, "pos", md.safe_fence(body, "text").alias("fenced"))


_API = d.jtrim(d.gsub(d.gsub(d.gsub("markdown", r"(?m)[ \t]+$", "''"), r"(?m)^[ \t]+", "''"), r"\n{3,}", "chr(10) || chr(10)"))


@query("normalize_prompt_text", f"""
    SELECT platform, source_id, pos, {_API} AS api_text, {d.gsub(_API, "[ " + chr(92) + "t]{2,}", "' '")} AS page_text
    FROM {{messages_v}}""", heavy=True)
def normalize_prompt_text(v):
    return v.messages_v.select(*KEY, "pos", md.normalize_prompt_text(c("markdown")).alias("api_text"),
                               md.normalize_prompt_text(c("markdown"), dom=True).alias("page_text"))


@query("format_thinking", f"""
    SELECT platform, source_id, pos,
           '> [thinking]' || chr(10) || '> ' || replace(markdown, chr(10), chr(10) || '> ') AS quoted,
           '> [thinking]' || chr(10) || array_to_string(list_transform(string_split(markdown, chr(10)),
             lambda x: CASE WHEN {d.jtrim('x')} = '' THEN '>' ELSE '> ' || x END), chr(10)) AS bare_quoted
    FROM {{messages_v}}""")
def format_thinking(v):
    return v.messages_v.select(*KEY, "pos", md.format_thinking(c("markdown")).alias("quoted"),
                               md.format_thinking(c("markdown"), "aistudio").alias("bare_quoted"))


@query("replace_interactive_blocks", r"""
    SELECT platform, source_id, pos, regexp_replace(markdown || chr(10) || '```json' || chr(10) || '{{"miniApp": 1, "id": "im_'
             || replace(source_id, '-', '') || '"}}' || chr(10) || '```', '(?is)```(json)?\s*.*?"id"\s*:\s*"(im_[a-z0-9]+)".*?```',
             '> [interactive] [Open Gemini visualization demo (\2)](https://gemini.google.com/app/x)', 'g') AS markdown
    FROM {messages_v}""")
def replace_interactive_blocks(v):
    demo = F.concat("markdown", F.lit('\n```json\n{"miniApp": 1, "id": "im_'), F.regexp_replace("source_id", "-", ""),
                    F.lit('"}\n```'))
    return v.messages_v.select(*KEY, "pos", md.replace_interactive_blocks(
        demo, F.lit("https://gemini.google.com/app/x")).alias("markdown"))


@query("log_context", r"""
    SELECT id, coalesce(platform, json_extract_string(details, '$.platform'),
             CASE WHEN contains(scope, 'deepseek') THEN 'deepseek' END) AS platform,
           coalesce(source_id, json_extract_string(details, '$.sourceId')) AS source_id,
           trace_id, worker_id, code
    FROM {logs_v}""")
def log_context(v):
    return analytics.log_context(v.logs_v).select("id", "platform", "source_id", "trace_id", "worker_id", "code")


@query("decode_inline_text", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '> [attachment] text/plain' ELSE
             '> [attachment] text/plain' || chr(10) || chr(10) || '~~~text' || chr(10) || 'note ' || doc_id || ' ' || lang
             || chr(10) || '~~~' END AS markdown
    FROM {documents}""")
def decode_inline_text(v):
    note = F.concat(F.lit("  note "), c("doc_id").cast("string"), F.lit(" "), "lang", F.lit(" \n"))
    payload = F.when(c("doc_id") % 3 == 0, F.lit("%%no base64%%")).otherwise(F.base64(F.encode(note, "UTF-8")))
    return v.documents.select("doc_id", md.decode_inline_text(F.lit("text/plain"), payload).alias("markdown"))
