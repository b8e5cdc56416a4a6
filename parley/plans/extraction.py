"""Payload, page and asset jobs. Payloads are derived row by row from the tables, so their work grows with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.adapters import default_registry
from parley.functions import nested
from parley.functions import urls as ur
from parley.operators import KEY, assets, pages, payloads
from parley.plans import duck as d
from parley.plans.catalog import query
from parley.plans.views import NOW
from parley.sources import files
from parley.streaming import buffers
from parley.streaming import tables as streams

c = F.col
NL2 = "chr(10) || chr(10)"


def quoted(x: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]\z", "")


def _turns(v):
    return v.conversations.select(
        F.concat(F.lit("c"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("source_id"),
        "conv_id", "turn", "text", (F.lit(1700000000) + c("conv_id") * 60 + c("turn")).alias("at"))


def _payloads(rows, platform: str, body: Column):
    return rows.select(F.lit(platform).alias("platform"), "source_id", F.lit("https://chat.example.com/x").alias("url"),
                       F.concat(F.lit("Turn "), "source_id").alias("title"), body.alias("payload"), F.lit(NOW).alias("extracted_at"))


_SID = "'c' || conv_id || '-' || turn"
_AT = "strftime(make_timestamp((1700000000 + conv_id * 60 + turn) * 1000000 + {0}), '%Y-%m-%dT%H:%M:%S.%gZ')"


def chatgpt_payloads(v):
    def node(name, parent, role, at, *parts):
        return F.struct(F.lit(name).alias("id"), F.lit(parent).cast("string").alias("parent"), F.struct(
            F.struct(F.lit(role).alias("role")).alias("author"), at.alias("create_time"),
            F.struct(F.array(*parts).alias("parts")).alias("content")).alias("message"))

    at = c("at").cast("decimal(20,3)") + F.lit(0.25).cast("decimal(3,2)")
    nodes = {"n0": node("n0", None, "tool", at, F.lit("root")), "n1": node("n1", "n0", "user", at, F.lit(" Question "), F.lit(" ")),
             "nx": node("nx", "n1", "assistant", at, F.lit("other branch")), "n2": node("n2", "n1", "assistant", at, c("text"), F.lit("end"))}
    mapping = F.create_map(*[x for k, n in nodes.items() for x in (F.lit(k), n)])
    return _payloads(_turns(v), "chatgpt", F.to_json(F.struct(
        F.concat(F.lit("Turn "), "source_id").alias("title"), F.lit("n2").alias("current_node"), mapping.alias("mapping"))))


@query("parse_chatgpt", f"""
    SELECT {_SID} AS source_id, 0 AS pos, 'n1' AS id, 'user' AS role, 'Question' AS markdown, {_AT.format(250000)} AS created_at FROM {{conversations}}
    UNION ALL SELECT {_SID}, 1, 'n2', 'assistant', array_to_string(list_filter([{d.jtrim('text')}, 'end'], lambda x: x <> ''), {NL2}),
      {_AT.format(250000)} FROM {{conversations}}""", heavy=True)
def parse_chatgpt(v):
    return payloads.explode_messages(payloads.parse_chatgpt(chatgpt_payloads(v))).select(
        "source_id", "pos", "id", "role", "markdown", "created_at")


@query("flatten_parts", f"""
    SELECT {_SID} AS source_id, concat_ws({NL2}, nullif({d.jtrim('text')}, ''), 'linked', 'https://u/' || turn, '{{{{"k":' || turn || '}}}}') AS markdown
    FROM {{conversations}}""", heavy=True)
def flatten_parts(v):
    content = F.concat(F.lit('{"parts":['), quoted(c("text")), F.lit(',{"title":"linked","url":"x"},{"url":"https://u/'),
                       c("turn").cast("string"), F.lit('"}, "  ", 7, null, {"k":'), c("turn").cast("string"), F.lit("}]}"))
    return _turns(v).select("source_id", payloads.flatten_parts(content).alias("markdown"))


def deepseek_payloads(v):
    body = F.concat(
        F.lit('{"data":{"biz_data":{"chat_session":{"title":"S"},"chat_messages":[{"message_id":"10","role":"ASSISTANT","inserted_at":'),
        c("at").cast("string"), F.lit(',"fragments":[{"type":"THINK","content":"a\\nb"},{"type":"TEXT","content":'), quoted(c("text")),
        F.lit('}]},{"message_id":9,"role":"USER","inserted_at":"'), c("at").cast("string"), F.lit('.5","content":"see https://h/'),
        c("turn").cast("string"), F.lit('.pdf","files":[{"file_name":"f.txt","file_size":'), (c("turn") * 1000).cast("string"),
        F.lit('},{"file_name":"bad","status":"FAILED"}]},{"message_id":1,"role":"system","content":"x"}]}}}'))
    return _payloads(_turns(v), "deepseek", body)


@query("parse_deepseek", f"""
    SELECT {_SID} AS source_id, 0 AS pos, '9' AS id, 'user' AS role, '> [attachment] f.txt (' || CASE WHEN turn < 2 THEN turn * 1000 || 'B'
        ELSE printf('%.2fKB', ((turn * 1000 * 200 + 1024) // 2048) / 100.0::DOUBLE) END || ')' || {NL2} || 'see https://h/' || turn || '.pdf' || {NL2}
        || '> [attachment] [' || turn || '.pdf](https://h/' || turn || '.pdf)' AS markdown, {_AT.format(500000)} AS created_at FROM {{conversations}}
    UNION ALL SELECT {_SID}, 1, '10', 'assistant', concat_ws({NL2}, '> [thinking]' || chr(10) || '> a' || chr(10) || '> b', nullif({d.jtrim('text')}, '')),
      {_AT.format(0)} FROM {{conversations}}""", heavy=True)
def parse_deepseek(v):
    return payloads.explode_messages(payloads.parse_deepseek(deepseek_payloads(v))).select(
        "source_id", "pos", "id", "role", "markdown", "created_at")


@query("file_blocks", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '> [attachment] [d' || doc_id || '.txt](https://f/' || doc_id || ')'
      ELSE '> [attachment] d' || doc_id || '.txt (' || CASE WHEN n_chars < 1024 THEN n_chars || 'B'
        ELSE printf('%.2fKB', ((n_chars * 200 + 1024) // 2048) / 100.0::DOUBLE) END || ')' END AS blocks FROM {documents}""")
def file_blocks(v):
    good = F.struct(F.concat(F.lit("d"), c("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.lit("SUCCESS").alias("status"),
                    F.lit(None).cast("string").alias("error_code"), c("n_chars").alias("file_size"),
                    F.when(c("doc_id") % 3 == 0, F.concat(F.lit("https://f/"), c("doc_id").cast("string"))).alias("download_url"))
    failed = good.withField("error_code", F.lit("E1"))
    return v.documents.select("doc_id", F.array_join(payloads.file_blocks(F.array(failed, good)), "\n").alias("blocks"))


def gemini_payloads(v):
    photo = F.concat(F.lit('["p'), (c("turn") % 2).cast("string"), F.lit('.jpg","https://lh3.googleusercontent.com/gg/'),
                     c("turn").cast("string"), F.lit('",null,"image/jpeg"]'))

    def turn(asked: Column, answer: Column, rid: str, photos: Column, at: Column):
        return F.concat(F.lit("[null,null,[["), quoted(asked), F.lit(",["), photos, F.lit(']],2],[[["'), F.lit(rid), F.lit('",['),
                        quoted(answer), F.lit("]]]],["), at.cast("string"), F.lit(",7000000]]"))

    later = turn(F.lit("again"), F.lit("B"), "r2", F.concat(photo, F.lit(',["n.png","https://lh3.googleusercontent.com/gg/n"]')), c("at") + 10)
    first = turn(c("text"), F.lit(" A "), "r1", photo, c("at"))
    inner = F.concat(F.lit("[["), later, F.lit(","), first, F.lit("],null]"))
    return _payloads(_turns(v), "gemini", F.concat(F.lit(")]}'\n\n12\n[[\"wrb.fr\",\"hNvQHb\","), quoted(inner), F.lit(",null]]\n9\n[[\"x\"]]")))


_PHOTO = "'![p' || (turn % 2) || '.jpg](https://lh3.googleusercontent.com/gg/' || turn || ')'"


@query("parse_gemini", f"""
    SELECT {_SID} AS source_id, 0 AS pos, 'user-1' AS id, 'user' AS role, concat_ws({NL2}, {_PHOTO}, nullif({d.jtrim('text')}, '')) AS markdown,
      {_AT.format(7000)} AS created_at FROM {{conversations}}
    UNION ALL SELECT {_SID}, 1, 'r1', 'assistant', 'A', {_AT.format(7000)} FROM {{conversations}}
    UNION ALL SELECT {_SID}, 2, 'user-2', 'user', '![n.png](https://lh3.googleusercontent.com/gg/n)' || {NL2} || 'again', {_AT.format(10007000)} FROM {{conversations}}
    UNION ALL SELECT {_SID}, 3, 'r2', 'assistant', 'B', {_AT.format(10007000)} FROM {{conversations}}""", heavy=True)
def parse_gemini(v):
    return payloads.explode_messages(payloads.parse_gemini(gemini_payloads(v))).select(
        "source_id", "pos", "id", "role", "markdown", "created_at")


@query("decode_rpc_envelope", f"SELECT {_SID} AS source_id, 'again' AS asked FROM {{conversations}}")
def decode_rpc_envelope(v):
    inner = payloads.decode_rpc_envelope(c("payload"))
    return gemini_payloads(v).select("source_id", F.get_json_object(inner, "$[0][0][2][0][0]").alias("asked"))


@query("collect_nested", """
    SELECT id, 'photo-' || id || '.png' AS name, 'https://lh3.googleusercontent.com/gg/' || id AS url, 'image/png' AS mime, 'image' AS kind FROM {urls_v}
    UNION ALL SELECT id, 'deep.pdf', 'https://no', NULL, 'document' FROM {urls_v}
    UNION ALL SELECT id, 'r' || id || '.pdf', 'https://f/' || id, NULL, 'document' FROM {urls_v}""", heavy=True, shares=8)
def collect_nested(v):
    sid = c("id").cast("string")
    text = F.concat(F.lit('[["x",[1,[["photo-'), sid, F.lit('.png","https://lh3.googleusercontent.com/gg/'), sid, F.lit('","image/png",["deep.pdf","https://no"]]]],'
                    '["https://f/'), sid, F.lit('","r'), sid, F.lit('.pdf"],["https://f/'), sid, F.lit('","r'), sid, F.lit('.pdf"]]]'))
    rows = v.urls_v.withColumn("v", F.try_parse_json(text))
    out = None
    for kind in ("image", "document"):
        part = rows.select("id", F.explode(nested.collect_nested(c("v"), kind)).alias("a"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.select("id", "a.name", "a.url", "a.mime", "kind")


def aistudio_payloads(v):
    def turn(text: Column, role: str, tail: str = ""):
        return F.concat(F.lit("["), text, F.lit(f',null,null,["drive-1"],null,null,null,null,"{role}"{tail}]'))

    thought = ",null,null,null,null,null,null,null,null,null,null,null,null,null,null,null,null,-1"
    stamp = F.concat(F.lit(',[["'), c("at").cast("string"), F.lit('",5000000]]'))
    body = F.concat(F.lit('[["prompts/x",null,null,[1,null,"models/m"],["Title",null,null,null,[["'), c("at").cast("string"),
                    F.lit('",1000000]]],{"z":['), turn(quoted(c("text")), "user"), F.lit(","), turn(F.lit('"Plan\\n\\nmore"'), "model", thought),
                    F.lit(","), F.concat(F.lit('["Done",null,null,null,null,null,null,null,"model"'), stamp, F.lit("]")), F.lit("]}]]"))
    return _payloads(_turns(v), "aistudio", body)


_DRIVE = "'> [attachment] [Google Drive resource drive-1](https://drive.google.com/open?id=drive-1)'"
_TIDY = d.jtrim(d.gsub(d.gsub(d.gsub("text", r"(?m)[ \t]+$", "''"), r"(?m)^[ \t]+", "''"), r"\n{3,}", NL2))


@query("parse_aistudio", f"""
    SELECT {_SID} AS source_id, 0 AS pos, 'user-1' AS id, 'user' AS role, concat_ws({NL2}, {_DRIVE}, nullif({_TIDY}, '')) AS markdown,
      CAST(NULL AS VARCHAR) AS created_at FROM {{conversations}}
    UNION ALL SELECT {_SID}, 1, 'assistant-2', 'assistant', {_DRIVE} || {NL2} || '> [thinking]' || chr(10) || '> Plan' || chr(10) || '>' || chr(10)
      || '> more', NULL FROM {{conversations}}
    UNION ALL SELECT {_SID}, 2, 'assistant-3', 'assistant', 'Done', {_AT.format(5000)} FROM {{conversations}}""", heavy=True)
def parse_aistudio(v):
    return payloads.explode_messages(payloads.parse_aistudio(aistudio_payloads(v))).select(
        "source_id", "pos", "id", "role", "markdown", "created_at")


@query("turn_timestamp", """
    SELECT id, (1700000000 + id) * 1000 + 5 AS at FROM {times_v}""", heavy=True)
def turn_timestamp(v):
    text = F.concat(F.lit('["t",[[1600000000,1],["'), c("pair_s"), F.lit('",5000000],[99999999999,1]],{"x":[1900000000,0]}]'))
    return v.times_v.select("id", nested.turn_timestamp_ms(F.try_parse_json(text)).alias("at"))


@query("parse_with_adapters", """
    SELECT 'chatgpt' AS platform, count(*) * 2 AS messages FROM {conversations} UNION ALL SELECT 'deepseek', count(*) * 2 FROM {conversations}
    UNION ALL SELECT 'gemini', count(*) * 4 FROM {conversations} UNION ALL SELECT 'aistudio', count(*) * 3 FROM {conversations}""", heavy=True)
def parse_with_adapters(v):
    hosts = {"chatgpt": "https://chatgpt.com/c/1", "deepseek": "https://chat.deepseek.com/a/chat/s/1",
             "gemini": "https://gemini.google.com/app/1", "aistudio": "https://aistudio.google.com/prompts/1"}
    makers = {"chatgpt": chatgpt_payloads, "deepseek": deepseek_payloads, "gemini": gemini_payloads, "aistudio": aistudio_payloads}
    mixed = None
    for name, make in makers.items():
        part = make(v).withColumn("url", F.lit(hosts[name]))
        mixed = part if mixed is None else mixed.unionByName(part)
    parsed = default_registry().parse(mixed)
    return parsed.groupBy("platform").agg(F.sum(F.size("messages")).cast("bigint").alias("messages"))


@query("parse_discovery", """
    SELECT 'chatgpt' AS platform, seq AS page, source_id, 'https://chatgpt.com/c/' || source_id AS url, title, source_updated_at FROM {discovery_v}
    UNION ALL SELECT 'deepseek', seq, source_id, 'https://chat.deepseek.com/a/chat/s/' || source_id, title, source_updated_at FROM {discovery_v}
    UNION ALL SELECT 'aistudio', seq, source_id, 'https://aistudio.google.com/prompts/' || source_id, coalesce(title, 'untold'),
      '2023-11-14T22:13:20.005Z' FROM {discovery_v}
    UNION ALL SELECT 'gemini', seq, source_id, 'https://gemini.google.com/app/' || source_id, coalesce(title, 'untold'), '2023-11-14T22:13:20.005Z'
      FROM {discovery_v}""", heavy=True, shares=8)
def parse_discovery(v):
    named = F.coalesce("title", F.lit("untold"))
    item = F.to_json(F.struct(c("source_id").alias("id"), "title", c("source_updated_at").alias("updated_at")))
    bodies = {
        "chatgpt": F.concat(F.lit('{"items":[{"title":"no id"},'), item, F.lit("]}")),
        "deepseek": F.concat(F.lit('{"data":{"list":[{"id":"'), "source_id", F.lit('","title":"older"},'), item, F.lit("]}}")),
        "aistudio": F.concat(F.lit('[[["prompts/'), "source_id", F.lit('",null,null,null,['), quoted(named),
                             F.lit(',null,null,null,[["1700000000",5000000]]]]],"next"]')),
        "gemini": F.concat(F.lit('x[["c_'), "source_id", F.lit('",'), quoted(named), F.lit(",null,null,null,[1700000000,5000000],null]]")),
    }
    out = None
    for platform, body in bodies.items():
        part = payloads.parse_discovery(v.discovery_v.select(c("seq").alias("page"), body.alias("payload")), platform)
        part = part.select("platform", "page", "source_id", "url", "title", "source_updated_at")
        out = part if out is None else out.unionByName(part)
    return out


@query("read_history_pages", """
    SELECT seq AS page, true AS has_more, '17' || (100000000 + seq) AS next_cursor, false AS ends FROM {discovery_v}""")
def read_history_pages(v):
    body = F.concat(F.lit('{"data":{"biz_data":{"has_more":true,"chat_sessions":[{"id":"'), "source_id", F.lit('","updated_at":17'),
                    (c("seq") + 100000000).cast("string"), F.lit("}]}}}"))
    return files.history_pages(v.discovery_v.select(c("seq").alias("page"), body.alias("payload")), "deepseek")[1]


@query("read_history_stop", "SELECT seq AS page, platform, source_id FROM {discovery_v} WHERE seq <= 50")
def read_history_stop(v):
    """A walk whose cursors come round after fifty pages: the first page with a cursor seen before is the last one read."""
    body = F.concat(F.lit('{"data":{"biz_data":{"has_more":true,"chat_sessions":[{"id":"'), "source_id", F.lit('","updated_at":17'),
                    (c("seq") % 50 + 100000000).cast("string"), F.lit("}]}}}"))
    pages_ = v.discovery_v.select(c("seq").alias("page"), body.alias("payload"))
    found = files.history_pages(pages_, "deepseek")[0].select("page", "source_id")
    return found.join(v.discovery_v.select(c("seq").alias("page"), "platform"), "page").select("page", "platform", "source_id")


_BAD = "CASE CAST(seq % 6 AS INT) WHEN 1 THEN 'bundle.platform' WHEN 2 THEN 'bundle.participants' WHEN 3 THEN 'bundle.extractedAt' WHEN 4 THEN 'client' END"


@query("read_ingest", f"SELECT seq, {_BAD} AS reason FROM {{ingest_v}}", heavy=True)
def read_ingest(v):
    bad = c("seq") % 6
    people = F.when(bad == 2, F.array().cast("array<struct<id:string,role:string,name:string>>")).otherwise(
        F.array(F.struct(F.lit("u").alias("id"), F.lit("user").alias("role"), F.lit("User").alias("name"))))
    body = F.to_json(F.struct(
        F.struct(F.when(bad == 1, "icq").otherwise(c("platform")).alias("platform"), c("source_id").alias("sourceId"), "url", "title",
                 F.when(bad == 3, "yesterday").otherwise(c("extracted_at")).alias("extractedAt"), people.alias("participants"),
                 F.array(F.struct(F.lit("m").alias("id"), F.lit("user").alias("role"), F.lit("hi").alias("markdown"))).alias("messages"))
        .alias("bundle"),
        F.struct(F.when(bad == 4, "").otherwise("1.0").alias("extensionVersion"), F.lit("edge").alias("browser")).alias("client")))
    valid, rejects = files.read_ingest(v.ingest_v.select("seq", body.alias("body")))
    return valid.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("seq", "reason"))


@query("drop_inherited", """
    SELECT conv_id, turn, array_to_string(CASE WHEN before IS NOT NULL AND list_has_all(mine, before)
      THEN list_filter(mine, lambda x: NOT list_contains(before, x)) ELSE mine END, ',') AS kept
    FROM (SELECT *, lag(mine) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (
      SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ['a' || (turn + 7)]
        ELSE list_transform(range(0, turn + 1), lambda i: 'a' || i) END AS mine FROM {conversations}) AS x) AS y""")
def drop_inherited(v):
    def named(n: Column) -> Column:
        return F.struct(F.concat(F.lit("a"), n.cast("string")).alias("name"), F.lit("u").alias("url"))

    mine = F.when(c("turn") % 4 == 3, F.array(named(c("turn") + 7))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), c("turn")), named))
    turns = v.conversations.select(F.lit("p").alias("platform"), c("conv_id").cast("string").alias("source_id"), "conv_id",
                                   "turn", mine.alias("attachments"))
    return payloads.drop_inherited(turns).select("conv_id", "turn", F.array_join("attachments.name", ",").alias("kept"))


# ---------------------------------------------------------------- pages

_A = r"(?is)<a\b([^>]*)>(.*?)</a>"


def _unescape(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for name, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ", "&amp;": "&"}.items():
        out = f"replace({out}, '{name}', '{char}')"
    return out


_ENC = "replace(replace(replace(replace(replace(url_encode(h), '%2F', '/'), '%2C', ','), '%21', '!'), '%26', '&'), '%3F', '?')"


@query("page_links", f"""
    SELECT page_id, source_id, arg_max(link, n) AS url, arg_max(t, n) FILTER (WHERE t <> '') AS title, min(n) - 1 AS seq
    FROM (SELECT page_id, n, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_ENC} AS link, {d.collapse(_unescape('inner_html'))} AS t,
                 regexp_extract({_ENC}, '/([^/?#]+)$', 1) AS source_id
          FROM (SELECT page_id, url, n, regexp_extract(tags[n], 'href="([^"]*)"', 1) AS h, inners[n] AS inner_html
                FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS n FROM (SELECT page_id, url,
                  regexp_extract_all(html, {d.rx(_A)}, 1) AS tags, regexp_extract_all(html, {d.rx(_A)}, 2) AS inners FROM {{pages}}) AS p) AS q) AS r
          WHERE h <> '') AS s WHERE source_id <> '' GROUP BY page_id, source_id""", heavy=True)
def page_links(v):
    return pages.page_links(v.pages, r"/([^/?#]+)\z").select("page_id", "source_id", "url", "title", "seq")


_H1 = d.collapse(_unescape("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"))
_TITLE = d.collapse(_unescape("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)"))


@query("page_title", f"""
    SELECT page_id, coalesce(nullif({_H1}, ''), nullif({_TITLE}, '')) AS title, coalesce({d.norm_title(_TITLE, "''")}) AS named
    FROM {{pages}}""", heavy=True)
def page_title(v):
    named = pages.page_title(v.pages, "Google Gemini", heading=r"(?is)<h9>(.*?)</h9>").withColumnRenamed("title", "named")
    return pages.page_title(v.pages, "ChatGPT", strict=False).join(named, "page_id")


def _chrome(x: str) -> str:
    for tag in ("button", "svg", "script", "style", "textarea", "select"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({x}, '(?is)<input\\b[^>]*>', '', 'g')"


@query("strip_page_chrome", f"SELECT page_id, {_chrome('html')} AS html FROM {{pages}}", heavy=True)
def strip_page_chrome(v):
    return v.pages.select("page_id", pages.strip_page_chrome(c("html")).alias("html"))


_NESTED = ('<div aria-hidden="true">a<div>b<br></div>c<span aria-hidden="false">d</span></div>kept <button class="x">e<svg><g/></svg>'
           '<button>f</button>g</button><svg width="1"/>too <select><option>h</select><p aria-hidden=true>i</p><i aria-hidden="true">never closed')


@query("strip_nested_chrome", f"SELECT page_id, 'kept too ' || {_chrome('html')} || 'never closed' AS html FROM {{pages}}", heavy=True)
def strip_nested_chrome(v):
    """Controls within controls and hidden subtrees around each page's own."""
    front, back = _NESTED.rsplit("<i ", 1)
    return v.pages.select("page_id", pages.strip_page_chrome(F.concat(F.lit(front), c("html"), F.lit("<i " + back))).alias("html"))


@query("pages_to_blocks", heavy=True)
def pages_to_blocks(v):
    return pages.pages_to_blocks(v.pages)


@query("page_headings", f"""
    SELECT page_id, '# ' || {_H1} AS markdown FROM {{pages}}""", heavy=True)
def page_headings(v):
    return pages.pages_to_blocks(v.pages).where("kind = 'heading'").select("page_id", "markdown")


_FLAT = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"


@query("blocks_to_turns", f"""
    SELECT conv_id * 1000 + turn AS page_id, n AS turn, CASE n WHEN 0 THEN 'q' || turn ELSE 'assistant-2' END AS id,
           CASE n WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
           CASE n WHEN 0 THEN {_FLAT} ELSE '## Answer' || {NL2} || '-   **' || role || '**' || {NL2} || '```sql' || chr(10) || 'SELECT ' || turn
             || chr(10) || '```' END AS markdown
    FROM {{conversations}}, (VALUES (0), (1)) AS t(n) WHERE n = 1 OR {_FLAT} <> ''""", heavy=True)
def blocks_to_turns(v):
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turn = c("turn").cast("string")
    html = F.concat(F.lit('<main><div data-role="Human" id="q'), turn, F.lit('"><p>'), text,
                    F.lit('</p><button>Copy</button></div><div data-author-role="bot"><h2>Answer</h2><ul><li><b>'), "role",
                    F.lit('</b></ul><pre><code class="language-sql">SELECT '), turn, F.lit("\n</code></pre></div></main>"))
    rows = v.conversations.select((c("conv_id") * 1000 + c("turn")).alias("page_id"), html.alias("html"))
    return pages.blocks_to_turns(pages.pages_to_blocks(rows)).select("page_id", "turn", "id", "role", "markdown")


@query("attachment_cards", """
    SELECT user_id, name, meta, min(event_id) AS pos, '> [attachment] ' || name || coalesce(' (' || meta || ')', '') AS markdown
    FROM (SELECT event_id, user_id, event_type || CASE WHEN event_id % 3 = 0 THEN '.pdf' WHEN event_id % 3 = 1 THEN '.exe' ELSE '.Docx' END AS name,
                 CASE WHEN event_id % 2 = 0 THEN (user_id % 5) || ' KB' END AS meta FROM {events}) AS e
    WHERE NOT ends_with(name, '.exe') GROUP BY user_id, name, meta""")
def attachment_cards(v):
    suffix = F.when(c("event_id") % 3 == 0, ".pdf").when(c("event_id") % 3 == 1, ".exe").otherwise(".Docx")
    cards = v.events.select("user_id", c("event_id").alias("pos"), F.concat("event_type", suffix).alias("name"),
                            F.when(c("event_id") % 2 == 0, F.concat((c("user_id") % 5).cast("string"), F.lit(" KB"))).alias("meta"))
    return pages.attachment_cards(cards, ["user_id"])


def _line_blocks(v):
    return v.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "markdown"))


_LINES = "SELECT doc_id, i - 1 AS pos, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents}) AS a) AS b"
_NORM = d.jtrim(d.gsub(d.gsub("line", r"^[ \t]+|[ \t]+$", "''"), r"[ \t]{2,}", "' '"))


@query("drop_adjacent_duplicates", f"""
    SELECT doc_id, pos, t AS markdown FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS before
      FROM (SELECT doc_id, pos, {_NORM} AS t FROM {{lines_v}}) AS x WHERE t <> '') AS y WHERE before IS DISTINCT FROM t""", {"lines_v": _LINES}, heavy=True)
def drop_adjacent_duplicates(v):
    return pages.drop_adjacent_duplicates(_line_blocks(v), ["doc_id"])


@query("distinct_blocks", f"""
    SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS markdown FROM {{lines_v}} WHERE {d.jtrim('line')} <> ''
    GROUP BY doc_id, {d.jtrim('line')}""", {"lines_v": _LINES})
def distinct_blocks(v):
    return pages.distinct_blocks(_line_blocks(v), ["doc_id"])


@query("page_settings", f"""
    SELECT page_id, 'Temperature ' || {_H1} AS temperature, 'm' || page_id AS model, 'Search' AS tool FROM {{pages}}""", heavy=True)
def page_settings(v):
    panel = F.concat(F.lit('<div data-test-id="model-name"> m'), c("page_id").cast("string"),
                     F.lit('</div><div class="settings-item"><h3> Temperature </h3><b>'), F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1),
                     F.lit('</b></div><div class="field-group"><p class="group-title">Search</p></div>'))
    rows = pages.page_settings(v.pages.withColumn("html", F.concat("html", panel)))
    meta = c("meta")
    return rows.select("page_id", F.get_json_object(meta, "$.temperature").alias("temperature"),
                       F.get_json_object(meta, "$.model").alias("model"), F.get_json_object(meta, "$.tools[0]").alias("tool"))


# ---------------------------------------------------------------- assets

ASSETS = {"links_v": """
    SELECT platform, source_id, pos, 0 AS phase, regexp_extract(markdown, '!\\[chart\\]\\(([^)]+)\\)', 1) AS target FROM {messages_v}
    UNION ALL SELECT platform, source_id, pos, 1, regexp_extract(markdown, '\\[attachment\\] \\[report\\]\\(([^)]+)\\)', 1) FROM {messages_v}""",
          "assets_v": """
    SELECT *, row_number() OVER (PARTITION BY platform, source_id ORDER BY pos, phase) AS asset_no FROM (
      SELECT platform, source_id, target, min(pos) AS pos, any_value(phase) AS phase FROM {links_v} WHERE target <> '' GROUP BY 1, 2, 3) AS x""",
          "paths_of_v": """
    SELECT *, 'assets/' || CASE WHEN phase = 0 THEN lpad(CAST(asset_no AS VARCHAR), 2, '0') || '-chart.png' ELSE 'report' END AS path FROM {assets_v}"""}


@query("embedded_assets", """
    SELECT platform, source_id, asset_no, path, target AS source_url, CASE WHEN phase = 0 THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type
    FROM {paths_of_v}""", ASSETS)
def embedded_assets(v):
    return assets.embedded_assets(v.messages_v).select(*KEY, "asset_no", "path", "source_url", "mime_type")


_REWRITTEN = """
    SELECT m.platform, m.source_id, m.pos, m.id, m.role, m.created_at,
           CASE WHEN i.path IS NULL THEN markdown ELSE replace(replace(markdown, '](' || i.target || ')', '](' || i.path || ')'),
             '](' || f.target || ')', '](' || f.path || ')') END AS markdown
    FROM {messages_v} AS m
    LEFT JOIN {paths_of_v} AS i ON m.platform = i.platform AND m.source_id = i.source_id AND i.phase = 0 AND contains(m.markdown, '](' || i.target || ')')
    LEFT JOIN {paths_of_v} AS f ON m.platform = f.platform AND m.source_id = f.source_id AND f.phase = 1 AND contains(m.markdown, '](' || f.target || ')')"""


@query("rewrite_asset_links", "SELECT platform, source_id, pos, markdown FROM {rewritten_v}", {**ASSETS, "rewritten_v": _REWRITTEN}, heavy=True)
def rewrite_asset_links(v):
    made = assets.embedded_assets(v.messages_v)
    return assets.rewrite_asset_links(v.messages_v, made).select(*KEY, "pos", "markdown")


@query("linked_attachments", """
    SELECT platform, source_id, 'm' || pos AS message_id, 'document' AS kind, 'report' AS title, CAST(NULL AS VARCHAR) AS mime_type, target AS source_url,
           CAST(NULL AS VARCHAR) AS resource_id FROM {links_v} WHERE phase = 1 AND target <> ''
    UNION ALL SELECT platform, source_id, id, 'resource', 'Drive ' || role, NULL, NULL, 'res-' || source_id FROM {messages_v}
    UNION ALL SELECT platform, source_id, id, 'document', 'notes.txt', 'text/plain', NULL, NULL FROM {messages_v}""", ASSETS)
def linked_attachments(v):
    more = F.concat(F.lit("\n> [attachment] Drive "), "role", F.lit(": res-"), "source_id", F.lit("\n> [attachment] notes.txt (text/plain)"))
    rows = v.messages_v.withColumn("markdown", F.concat("markdown", more))
    return assets.linked_attachments(rows).drop("seq")


@query("restore_failed_assets", """
    SELECT r.platform, r.source_id, r.pos, CASE WHEN a.path IS NULL THEN r.markdown ELSE replace(r.markdown, '](' || a.path || ')', '](' || a.target || ')') END AS markdown
    FROM {rewritten_v} AS r LEFT JOIN {paths_of_v} AS a ON a.platform = r.platform AND a.source_id = r.source_id AND a.phase = 1""",
       {**ASSETS, "rewritten_v": _REWRITTEN}, heavy=True)
def restore_failed_assets(v):
    made = assets.embedded_assets(v.messages_v)
    failed = made.where("mime_type = 'application/octet-stream'").select(*KEY, "path", "source_url")
    return assets.restore_failed_assets(assets.rewrite_asset_links(v.messages_v, made), made, failed)[0].select(*KEY, "pos", "markdown")


@query("prepare_bundles", f"""
    SELECT b.platform, b.source_id, coalesce({d.norm_title('title', 'b.source_id')}, {d.prompt_title('prompt', 'b.source_id')}, b.source_id) AS title,
           'r-' || b.source_id AS revision, model, coalesce(n, 0) AS assets, first_path, 'm0|resource|Kept|d-1,m0|resource|Last|d-2'
             || coalesce(',' || files, '') AS links
    FROM {{bundles_v}} AS b
    LEFT JOIN (SELECT platform, source_id, arg_min(markdown, pos) AS prompt FROM {{rewritten_v}} WHERE role = 'user' GROUP BY 1, 2) AS p
      ON b.platform = p.platform AND b.source_id = p.source_id
    LEFT JOIN (SELECT platform, source_id, count(*) AS n, arg_min(path, asset_no) AS first_path FROM {{paths_of_v}} GROUP BY 1, 2) AS a
      ON b.platform = a.platform AND b.source_id = a.source_id
    LEFT JOIN (SELECT platform, source_id, string_agg('m' || pos || '|document|report|' || path, ',' ORDER BY pos) AS files
               FROM (SELECT l.platform, l.source_id, l.pos, a.path FROM {{links_v}} AS l JOIN {{paths_of_v}} AS a
                       ON a.platform = l.platform AND a.source_id = l.source_id AND a.phase = 1 AND a.target = l.target
                     WHERE l.phase = 1) AS f GROUP BY 1, 2) AS l
      ON b.platform = l.platform AND b.source_id = l.source_id""", {**ASSETS, "rewritten_v": _REWRITTEN}, heavy=True)
def prepare_bundles(v):
    # Three stored entries, of which one is given twice with different media types: the last wins, at the first's place.
    def stored(title: str, resource: str, mime: str):
        return F.struct(F.lit("m0").alias("messageId"), F.lit("resource").alias("kind"), F.lit(title).alias("title"),
                        F.lit(mime).alias("mimeType"), F.lit(resource).alias("resourceId"))
    kept = F.array(stored("Kept", "d-1", "a/b"), stored("Last", "d-2", "a/b"), stored("Kept", "d-1", "c/d")).alias("linkedAttachments")
    rows = v.bundles_v.withColumn("revision", F.concat(F.lit("r-"), "source_id")).withColumn("meta", F.to_json(F.struct("model", kept)))
    out = assets.prepare_bundles(rows, v.messages_v, "1.0")["bundles"]
    listed = F.from_json("meta", "embeddedAssets array<struct<path:string>>, "
                         "linkedAttachments array<struct<messageId:string,kind:string,title:string,sourceUrl:string,resourceId:string>>, "
                         "model string, revision string")
    links = F.transform("m.linkedAttachments", lambda a: F.concat_ws("|", a["messageId"], a["kind"], a["title"], F.coalesce(a["sourceUrl"], a["resourceId"])))
    return out.withColumn("m", listed).select(
        *KEY, "title", c("m.revision").alias("revision"), c("m.model").alias("model"), F.size("m.embeddedAssets").cast("bigint").alias("assets"),
        F.array_join(links, ",").alias("links"), F.get(c("m.embeddedAssets"), 0)["path"].alias("first_path"))


@query("file_lists", """
    SELECT platform, source_id, 'embeddedAssets' AS name, CAST(0 AS BIGINT) AS part, count(*) AS entries FROM {paths_of_v} GROUP BY 1, 2
    UNION ALL SELECT platform, source_id, 'linkedAttachments', 0, count(*) FROM (SELECT DISTINCT l.platform, l.source_id, l.pos, a.path
      FROM {links_v} AS l JOIN {paths_of_v} AS a ON a.platform = l.platform AND a.source_id = l.source_id AND a.phase = 1 AND a.target = l.target
      WHERE l.phase = 1) AS f GROUP BY 1, 2""", {**ASSETS, "rewritten_v": _REWRITTEN}, heavy=True)
def file_lists(v):
    """The stretches of all file lists."""
    rows = v.bundles_v.withColumn("revision", F.concat(F.lit("r-"), "source_id")).withColumn("meta", F.lit("{}"))
    lists = assets.prepare_bundles(rows, v.messages_v, "1.0")["lists"]
    return lists.select(*KEY, "name", "part", F.json_array_length("items").cast("bigint").alias("entries"))


@query("platform_windows", """
    SELECT platform, strftime(date_trunc('day', updated_at::TIMESTAMP), '%Y-%m-%d') AS day, status, count(*) AS n FROM {queue_v} GROUP BY 1, 2, 3""")
def platform_windows(v):
    rows = v.queue_v.withColumn("at", c("updated_at").try_cast("timestamp"))
    return streams.platform_windows(rows, "1 day").select("platform", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n")


@query("discovery_sessions", """
    SELECT platform, source_id, max(seq) AS seq, arg_max(revision, seq) AS revision FROM (
      SELECT *, sum(CASE WHEN before IS NULL OR t - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY platform, source_id ORDER BY t, seq) AS nth
      FROM (SELECT *, lag(t) OVER (PARTITION BY platform, source_id ORDER BY t, seq) AS before
            FROM (SELECT *, extracted_at::TIMESTAMP AS t FROM {ingest_v}) AS x) AS y) AS z GROUP BY platform, source_id, nth""")
def discovery_sessions(v):
    events = v.ingest_v.select(*KEY, "seq", "revision", c("extracted_at").try_cast("timestamp").alias("at"))
    return buffers.discovery_sessions(events, "6 hours").select(*KEY, "seq", "revision")


@query("url_hosts", "SELECT id, regexp_extract(url, '://([^:/?#]*)', 1) AS host FROM {urls_v}")
def url_hosts(v):
    return v.urls_v.select("id", ur.host_of(c("url")).alias("host"))


@query("bundle_files", """
    SELECT platform, source_id, 'r-' || source_id AS revision, 'm' || pos AS id, role, markdown FROM {messages_v}""", heavy=True)
def bundle_files(v):
    """Bundles to the rows of their files and back: every message of every stored bundle."""
    message = F.struct("id", "role", "markdown", F.lit(None).cast("string").alias("created_at"))
    nested_rows = v.messages_v.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", message.alias("m")))).alias("l"))
    stored = v.bundles_v.join(nested_rows, KEY).select(
        *KEY, "url", "title", "extracted_at", "source_updated_at",
        F.lit(None).cast("array<struct<id:string,role:string,name:string>>").alias("participants"),
        F.transform("l", lambda x: x["m"]).alias("messages"),
        F.to_json(F.struct(F.concat(F.lit("r-"), "source_id").alias("revision"))).alias("meta"))
    written = files.bundle_files(stored).select(F.lit("x").alias("path"), files.pretty_json().alias("content"))
    back = files.bundles_of(written)
    revisions = files.disk_bundles(back).select(*KEY, "revision")
    return back.join(revisions, KEY).select(*KEY, "revision", F.explode("messages").alias("m")).select(
        *KEY, "revision", "m.id", "m.role", "m.markdown")
