"""Rendering and whole-conversation facts over the messages view."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import markdown as md
from parley.functions import text as tx
from parley.operators import KEY, conversations, rendering
from parley.plans import duck as d
from parley.plans.catalog import query

c = F.col
NL = "chr(10)"
_THINK = r"(?m)^> \[thinking\]$((\n>[^\n]*)|(\n[ \t]*$))*"
_DETAILS = (f"regexp_replace(markdown, {d.rx(r'^> \[thinking\]\n> ([^\n]*)\n> ([^\n]*)\n\n')}, "
            f"'<details>' || {NL} || '<summary>Thinking</summary>' || {NL} || {NL} || '\\1' || {NL} || '\\2' || {NL} || {NL}"
            f" || '</details>' || {NL} || {NL})")
_BODY = d.jtrim(f"regexp_replace({_DETAILS}, {d.rx(chr(92) + 'n{4,}')}, repeat({NL}, 3), 'g')")
_LABEL = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END"
_TIME = "strftime(created_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || ' (UTC+00:00)'"
_NAMES = ("CASE platform WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'deepseek' THEN 'DeepSeek' WHEN 'gemini' THEN 'Gemini' "
          "ELSE 'Google AI Studio' END")
_RESOLVED = f"""
    SELECT b.*, CASE WHEN own IS NOT NULL THEN own WHEN fallback IS NOT NULL THEN fallback ELSE source_id END AS final_title,
           own IS NULL AND fallback IS NOT NULL AS used_fallback, own IS NULL AND fallback IS NULL AS unresolved
    FROM (SELECT b.*, {d.norm_title('title', 'b.source_id')} AS own, {d.prompt_title('prompt', 'b.source_id')} AS fallback
          FROM {{bundles_v}} AS b LEFT JOIN (SELECT platform, source_id, arg_min(markdown, pos) AS prompt
            FROM {{messages_v}} WHERE role = 'user' GROUP BY 1, 2) AS p
          ON b.platform = p.platform AND b.source_id = p.source_id) AS b"""
_SECTIONS = f"""
    SELECT platform, source_id, pos, '## ' || {_LABEL} || {NL} || {NL} || '> ' || {_TIME} || {NL} || {NL} || {_BODY} AS section
    FROM {{messages_v}} WHERE {d.jtrim('markdown')} <> ''"""
_PARTS = f"""
    SELECT b.platform, b.source_id, CASE WHEN len(roles) = 0 OR roles IS NULL THEN ['assistant'] ELSE roles END AS roles
    FROM {{bundles_v}} AS b LEFT JOIN (SELECT platform, source_id, list(role ORDER BY first_at) AS roles FROM (
      SELECT platform, source_id, role, min(pos) AS first_at FROM {{messages_v}} GROUP BY 1, 2, 3) AS r GROUP BY 1, 2) AS m
      ON b.platform = m.platform AND b.source_id = m.source_id"""
EXTRA = {"resolved_v": _RESOLVED, "sections_v": _SECTIONS, "roles_v": _PARTS}


@query("strip_attachments", rf"""
    SELECT platform, source_id, pos, regexp_replace(markdown, '(?im)^>\s*\[attachment\].*$', '', 'g') AS markdown
    FROM {{messages_v}}""")
def strip_attachments(v):
    return v.messages_v.select(*KEY, "pos", md.strip_attachments(c("markdown")).alias("markdown"))


@query("strip_images", f"SELECT platform, source_id, pos, {d.gsub('markdown', d.IMAGE, repr(''))} AS markdown FROM {{messages_v}}")
def strip_images(v):
    return v.messages_v.select(*KEY, "pos", md.strip_images(c("markdown")).alias("markdown"))


_STANDARD = f"regexp_replace(markdown, {d.rx(r'^> \[thinking\]\n(>[^\n]*\n|\s*\n)*')}, '')"


@query("apply_preset", rf"""
    SELECT platform, source_id, pos, markdown AS complete, {_STANDARD} AS standard,
           {d.gsub(f"regexp_replace({_STANDARD}, '(?im)^>{chr(92)}s*{chr(92)}[attachment{chr(92)}].*$', '', 'g')", d.IMAGE, "''")} AS share,
           {d.gsub('markdown', d.IMAGE, "''")} AS no_images
    FROM {{messages_v}}""", heavy=True)
def apply_preset(v):
    m = c("markdown")
    return v.messages_v.select(
        *KEY, "pos", md.apply_preset(m).alias("complete"), md.apply_preset(m, "standard").alias("standard"),
        md.apply_preset(m, "share").alias("share"), md.apply_preset(m, "complete", images=False).alias("no_images"))


@query("strip_thinking", f"SELECT platform, source_id, pos, {_STANDARD} AS markdown FROM {{messages_v}}")
def strip_thinking(v):
    return v.messages_v.select(*KEY, "pos", md.strip_thinking(c("markdown")).alias("markdown"))


@query("thinking_to_details", f"""
    SELECT platform, source_id, pos, {_BODY} AS markdown FROM {{messages_v}}""", heavy=True)
def thinking_to_details(v):
    return v.messages_v.select(*KEY, "pos", md.normalize_spacing(md.thinking_to_details(c("markdown"))).alias("markdown"))


@query("wrap_bare_urls", r"""
    SELECT platform, source_id, pos, replace(regexp_replace(markdown, 'See (https://[^\s]+) for', '见<\1>好', 'g'), chr(1), '')
             AS markdown
    FROM {messages_v}""", heavy=True)
def wrap_bare_urls(v):
    cjk = F.regexp_replace("markdown", r"See (https://\S+) for", "见$1好")
    return v.messages_v.select(*KEY, "pos", md.wrap_bare_urls(cjk).alias("markdown"))


@query("code_blocks", r"""
    SELECT platform, source_id, pos, CAST(i - 1 AS INT) AS block_no, blocks[i] AS block
    FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i
          FROM (SELECT *, regexp_extract_all(markdown, '(?s)```.*?```') AS blocks FROM {messages_v}) AS m) AS x""")
def code_blocks(v):
    return rendering.code_blocks(v.messages_v)


@query("compact_code", rf"""
    SELECT platform, source_id, pos,
           {d.jtrim(r"regexp_replace(regexp_replace(regexp_replace(markdown, '```python\n# turn \d+\n\nx', '```python' || chr(10) || 'x', 'g'), '[ \t]+\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')")} AS markdown
    FROM {{messages_v}}""", heavy=True)
def compact_code(v):
    return v.messages_v.select(*KEY, "pos", md.compact_code(c("markdown")).alias("markdown"))


@query("render_messages", "SELECT platform, source_id, pos, section FROM {sections_v}", EXTRA, heavy=True)
def render_messages(v):
    return rendering.render_messages(v.messages_v)


@query("render_code_only", rf"""
    SELECT platform, source_id, pos, '## ' || {_LABEL} || {NL} || {NL} || array_to_string(blocks, {NL} || {NL}) AS section
    FROM (SELECT *, regexp_extract_all(markdown, '(?s)```.*?```') AS blocks FROM {{messages_v}}) AS m WHERE len(blocks) > 0""")
def render_code_only(v):
    return rendering.render_messages(v.messages_v, "code-only", timestamps=False)


_HEAD_FIELDS = f"""
    SELECT r.platform, r.source_id, r.title, r.url, r.extracted_at, r.source_updated_at, r.model,
           CASE WHEN list_contains(p.roles, 'assistant') THEN {_NAMES.replace('platform', 'r.platform')} END AS assistant,
           array_to_string(list_transform(p.roles, lambda x: CASE x WHEN 'assistant' THEN
             {_NAMES.replace('platform', 'r.platform')} WHEN 'user' THEN 'User' ELSE 'System' END), ', ') AS names,
           coalesce(n, 0) AS n, coalesce(body, '_(empty conversation)_') AS body, 'rev-' || r.source_id AS revision
    FROM {{bundles_v}} AS r JOIN {{roles_v}} AS p ON r.platform = p.platform AND r.source_id = p.source_id
    LEFT JOIN (SELECT platform, source_id, count(*) AS n, string_agg(section, {NL} || {NL} ORDER BY pos) AS body
               FROM {{sections_v}} GROUP BY 1, 2) AS s ON r.platform = s.platform AND r.source_id = s.source_id"""
_FRONT = f""" '---' || {NL} || 'archive: v2' || {NL} || 'export_compatibility_version: "2026-04-18.1"' || {NL}
  || 'exporter_version: ""' || {NL} || 'platform: ' || platform || {NL} || 'source_host: ""' || {NL}
  || 'conversation_id: ' || source_id || {NL} || 'title: ' || {d.yaml('title')} || {NL}
  || 'assistant: ' || {d.yaml('assistant')} || {NL} || 'model: ' || {d.yaml('model')} || {NL}
  || 'participants: ' || {d.yaml('names')} || {NL} || 'tools: "search, code"' || {NL}
  || 'source_url: ' || {d.yaml('url')} || {NL} || 'source_updated_at: ' || {d.yaml('source_updated_at')} || {NL}
  || 'source_updated_label: ""' || {NL} || 'exported_at: ' || {d.yaml('extracted_at')} || {NL}
  || 'message_count: ' || n || {NL} || 'revision: ' || revision || {NL} || 'format: full' || {NL} || '---' """
_HEADER = f""" '# ' || coalesce(nullif(trim(title), ''), source_id) || {NL} || {NL}
  || '> Source: ' || platform || ' | Conversation ID: ' || source_id || coalesce(' | Assistant: ' || assistant, '')
  || {NL} || {NL} || '> Messages: ' || n || ' | Tokens: ' || {d.token_label(d.tokens('body'))}
  || coalesce(' | Model: ' || model, '') || ' | URL: ' || url || {NL} || {NL}
  || '> Exported: ' || extracted_at || coalesce(' | Updated: ' || source_updated_at, '') || ' | Revision: ' || revision
  || ' | Compatibility: 2026-04-18.1' """
DOCS = {**EXTRA, "head_v": _HEAD_FIELDS,
        "docs_v": f"SELECT *, {_FRONT} AS front, {_HEADER} AS header FROM {{head_v}}"}


def _prepared(v):
    """Bundles with revision, participants and meta, as the serializer takes them."""
    meta = F.to_json(F.struct("model", F.array(F.lit("search"), F.lit("code")).alias("tools")))
    people = conversations.participants(v.bundles_v, v.messages_v)
    return (v.bundles_v.withColumn("meta", meta).withColumn("revision", F.concat(F.lit("rev-"), "source_id"))
            .join(people, KEY))


@query("frontmatter", "SELECT platform, source_id, front FROM {docs_v}", DOCS)
def frontmatter(v):
    counts = v.messages_v.where(tx.js_trim(c("markdown")) != "").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = _prepared(v).join(counts, KEY, "left")
    return rows.select(*KEY, rendering.frontmatter(F.coalesce("n", F.lit(0)), "full", "2026-04-18.1", "archive").alias("front"))


@query("conversation_header", "SELECT platform, source_id, header FROM {docs_v}", DOCS, heavy=True)
def conversation_header(v):
    docs = rendering.serialize_conversations(_prepared(v), v.messages_v, include_frontmatter=False)
    return docs.select(*KEY, F.regexp_extract("markdown", r"(?s)^(# .*? \| Compatibility: \S+)", 1).alias("header"))


@query("serialize_conversations", f"""
    SELECT platform, source_id, 0 AS part, 1 AS parts, doc AS markdown, n AS message_count, {d.tokens('doc')} AS estimated_tokens
    FROM (SELECT *, front || {NL} || {NL} || header || {NL} || {NL} || body || {NL} AS doc FROM {{docs_v}}) AS x""", DOCS, heavy=True)
def serialize_conversations(v):
    return rendering.serialize_conversations(_prepared(v), v.messages_v)


@query("participants", f"""
    SELECT platform, source_id, array_to_string(roles, ',') AS roles, array_to_string(list_transform(roles,
      lambda x: CASE x WHEN 'assistant' THEN {_NAMES} WHEN 'user' THEN 'User' ELSE 'System' END), ',') AS names
    FROM {{roles_v}}""", EXTRA)
def participants(v):
    rows = conversations.participants(v.bundles_v, v.messages_v)
    return rows.select(*KEY, F.array_join("participants.role", ",").alias("roles"),
                       F.array_join("participants.name", ",").alias("names"))


@query("last_activity", """
    SELECT platform, source_id, arg_max(created_at, pos) AS last_at,
           arg_max(created_at, pos) FILTER (WHERE role = 'assistant') AS assistant_at
    FROM {messages_v} GROUP BY 1, 2""")
def last_activity(v):
    spoken = conversations.last_activity(v.messages_v, "assistant").withColumnRenamed("last_at", "assistant_at")
    return conversations.last_activity(v.messages_v).join(spoken, KEY)


_LONG = "SELECT platform, source_id, pos, CASE WHEN pos % 2 = 0 THEN markdown ELSE '  ' END AS markdown FROM {messages_v} WHERE role = 'user'"


@query("reject_empty", """
    SELECT b.platform, b.source_id, CASE WHEN count(m.pos) = 0 THEN 'no usable messages' END AS reason
    FROM {bundles_v} AS b LEFT JOIN {messages_v} AS m ON b.platform = m.platform AND b.source_id = m.source_id
      AND m.role = 'system' GROUP BY 1, 2""")
def reject_empty(v):
    spoken = v.messages_v.withColumn("markdown", F.when(c("role") == "system", c("markdown")).otherwise(F.lit("  ")))
    kept, rejects = conversations.reject_empty(v.bundles_v, spoken)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects).select(*KEY, "reason")


@query("resolve_titles", "SELECT platform, source_id, final_title AS title, used_fallback, unresolved FROM {resolved_v}", EXTRA)
def resolve_titles(v):
    return conversations.resolve_titles(v.bundles_v, v.messages_v).select(*KEY, "title", "used_fallback", "unresolved")


_TITLE_QUEUE = """
    SELECT platform, source_id, pos, id || ' of ' || source_id AS title, created_at AS updated_at FROM {messages_v}
    WHERE role = 'assistant'
    UNION ALL SELECT platform, source_id, pos, 'New chat' AS title, created_at AS updated_at FROM {messages_v}
    WHERE role <> 'assistant'"""


@query("preferred_titles", """
    SELECT b.platform, b.source_id, coalesce(q.title, 'Index of ' || b.source_id) AS preferred_title
    FROM {bundles_v} AS b LEFT JOIN (SELECT platform, source_id, arg_max(title, updated_at) AS title FROM {tq_v}
      WHERE title <> 'New chat' GROUP BY 1, 2) AS q ON b.platform = q.platform AND b.source_id = q.source_id""",
       {"tq_v": _TITLE_QUEUE})
def preferred_titles(v):
    title = F.when(c("role") == "assistant", F.concat("id", F.lit(" of "), "source_id")).otherwise("New chat")
    queue = v.messages_v.select(*KEY, "pos", title.alias("title"), c("created_at").alias("updated_at"))
    index = v.bundles_v.select(*KEY, F.concat(F.lit("Index of  "), "source_id").alias("title"))
    return conversations.preferred_titles(v.bundles_v, v.messages_v, index, queue)


_LONE = """
    SELECT platform, source_id, title FROM (SELECT platform, source_id, 'T ' || markdown AS title, 1 AS one FROM {messages_v}) AS x"""


@query("title_only", """
    SELECT b.platform, b.source_id FROM {bundles_v} AS b JOIN (
      SELECT platform, source_id FROM {messages_v} GROUP BY 1, 2 HAVING count(*) FILTER (WHERE role = 'user') = 1) AS m
      ON b.platform = m.platform AND b.source_id = m.source_id""")
def title_only(v):
    users = v.messages_v.where("role = 'user'")
    titled = v.bundles_v.drop("title").join(conversations.first_prompts(v.messages_v), KEY).withColumn(
        "title", F.concat(F.lit(" "), "prompt"))
    return conversations.title_only(titled, users).select(*KEY)


@query("prompt_title_backfill", """
    WITH asst AS (SELECT platform, source_id, pos, id, role, markdown FROM {messages_v} WHERE role = 'assistant')
    SELECT * FROM asst
    UNION ALL
    SELECT b.platform, b.source_id, coalesce(min(a.pos), 0) - 1, b.source_id || '-prompt-title', 'user', any_value(b.title)
    FROM {bundles_v} AS b LEFT JOIN asst AS a ON a.platform = b.platform AND a.source_id = b.source_id
    WHERE b.title IS NOT NULL GROUP BY b.platform, b.source_id
    UNION ALL
    SELECT b.platform, b.source_id, 0, b.source_id || '-fallback', 'assistant',
           'AI Studio conversation content was not fully accessible from the current DOM snapshot.' || chr(10) || chr(10)
           || 'Run settings metadata was exported for this prompt.'
    FROM {bundles_v} AS b LEFT JOIN asst AS a ON a.platform = b.platform AND a.source_id = b.source_id
    WHERE b.title IS NULL AND a.pos IS NULL""")
def prompt_title_backfill(v):
    return conversations.prompt_title_backfill(v.bundles_v, v.messages_v.where("role = 'assistant'")).drop("created_at")


_DOM = """
    SELECT platform, source_id, pos, id, role, markdown || ' ![page](https://img.example.com/p' || (pos % 2) || '.png)'
      || ' ![page](https://img.example.com/p0.png)' AS markdown, created_at FROM {messages_v}"""


def _dom(v):
    image = F.concat(F.lit(" ![page](https://img.example.com/p"), (c("pos") % 2).cast("string"), F.lit(".png)"),
                     F.lit(" ![page](https://img.example.com/p0.png)"))
    return v.messages_v.withColumn("markdown", F.concat("markdown", image))


@query("merge_images", """
    SELECT platform, source_id, pos, CASE WHEN pos % 2 = 0 THEN '![page](https://img.example.com/p0.png)'
             ELSE '![page](https://img.example.com/p1.png)' || chr(10) || chr(10) || '![page](https://img.example.com/p0.png)' END
             || chr(10) || chr(10) || trim(markdown, chr(10) || ' ') AS markdown, 1 + pos % 2 AS merged_images
    FROM {messages_v}""")
def merge_images(v):
    return conversations.merge_images(v.messages_v, _dom(v)).select(*KEY, "pos", "markdown", "merged_images")


@query("merge_timestamps_by_position", """
    SELECT m.platform, m.source_id, m.pos, created_at, CASE WHEN has THEN m.markdown ELSE
             m.markdown || ' ![page](https://img.example.com/p' || (m.pos % 2) || '.png) ![page](https://img.example.com/p0.png)' END
             AS markdown
    FROM {messages_v} AS m JOIN (SELECT platform, source_id, bool_or(contains(markdown, '![chart](')) AS has
      FROM {messages_v} GROUP BY 1, 2) AS h ON m.platform = h.platform AND m.source_id = h.source_id""")
def merge_timestamps_by_position(v):
    dom = _dom(v).withColumn("created_at", F.lit(None).cast("string"))
    return conversations.merge_timestamps_by_position(dom, v.messages_v).select(*KEY, "pos", "created_at", "markdown")


_CAPTURES = """
    SELECT platform, source_id, 'turn-' || (pos % 2) AS id, pos AS capture_seq, 7 - pos AS pos, markdown FROM {messages_v}"""


@query("longest_capture", """
    SELECT platform, source_id, id, pos, markdown FROM (
      SELECT *, row_number() OVER (PARTITION BY platform, source_id, id ORDER BY length(markdown) DESC, capture_seq) AS r
      FROM {captures_v}) AS x WHERE r = 1""", {"captures_v": _CAPTURES})
def longest_capture(v):
    captures = v.messages_v.select(
        *KEY, F.concat(F.lit("turn-"), (c("pos") % 2).cast("string")).alias("id"), c("pos").alias("capture_seq"),
        (F.lit(7) - c("pos")).alias("pos"), "markdown")
    return conversations.longest_capture(captures).select(*KEY, "id", "pos", "markdown")
