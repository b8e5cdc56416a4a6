"""Platform payloads to conversations and messages.

A platform's shape is an expression over one payload row that gives a struct of `BUNDLE`; so parsing is row-local, several
platforms share one scan (see `parley.adapters`), and a payload is read once. `explode_messages` makes the messages
table, `split` the rejects.

Input: KEY, url, payload (text), title (optional), extracted_at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import nested
from parley.functions.markdown import (
    decode_inline_text, format_thinking, normalize_prompt_text, replace_interactive_blocks,
)
from parley.functions.text import blank_to_null, format_file_size, js_trim, let, normalize_role
from parley.functions.times import iso_from_ms, iso_from_pair, normalize_timestamp
from parley.functions.urls import append_url_attachments, source_id_from_url
from parley.operators import KEY, settled
from parley.operators.conversations import assistant_name
from parley.operators.discovery import dedupe_coalesce, dedupe_last

c = F.col
MESSAGE = "array<struct<id:string,role:string,markdown:string,created_at:string>>"


def v_get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def v_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def v_text(v: Column, path: str = "$") -> Column:
    """The member when it is a JSON string, else NULL."""
    return let(v_get(v, path), lambda at: F.when(v_type(at) == "STRING", at.cast("string")))


def v_is_number(v: Column) -> Column:
    return F.coalesce(v_type(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False))


def v_array(v: Column, path: str) -> Column:
    """The member as an array of variants; empty when it is not an array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def v_time(v: Column, dialect: str) -> Column:
    given = F.struct(F.when(v_type(v).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), v.cast("string")).alias("text"),
                     v_is_number(v).alias("number"))
    return let(given, lambda x: normalize_timestamp(x["text"], dialect, x["number"]))


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")


def people_of(messages: Column, platform: Column) -> Column:
    """Participants of a nested bundle: roles in first-seen order, the assistant alone when none speaks."""
    roles = F.filter(F.array_distinct(F.transform(messages, lambda m: m["role"])),
                     lambda r: r.isin("user", "assistant", "system"))
    roles = F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("assistant")))
    return F.transform(roles, lambda r: F.struct(r.alias("id"), r.alias("role"), F.when(r == "user", "User").when(
        r == "system", "System").otherwise(assistant_name(platform)).alias("name")))


BUNDLE = f"struct<title:string,source_updated_at:string,messages:{MESSAGE},meta:string>"


@dataclass(frozen=True)
class Payload:
    """The columns of a payload row that a shape reads: payload, url and, if the rows have one, title."""
    titled: bool = True

    text = property(lambda self: c("payload"))
    url = property(lambda self: c("url"))
    title = property(lambda self: c("title") if self.titled else F.lit(None).cast("string"))


Shape = Callable[[Payload], Column]


def made_once(shape: Shape) -> Shape:
    """``shape`` with its expressions kept: they name columns only, and to build one takes thousands of calls to the JVM."""
    made: dict[tuple, Column] = {}

    def kept(row: Payload, *options) -> Column:
        key = (row.titled, *options)
        if key not in made:
            made[key] = shape(row, *options)
        return made[key]

    return kept


def _bundle(title: Column, updated: Column, messages: Column, meta: Column) -> Column:
    return F.struct(title.alias("title"), updated.alias("source_updated_at"), messages.alias("messages"),
                    F.to_json(meta).alias("meta")).cast(BUNDLE)


def payload_of(rows: DataFrame) -> Payload:
    return Payload("title" in rows.columns)


def bundles_of(payloads: DataFrame, bundle: Column) -> DataFrame:
    """Bundle rows of payload rows; ``bundle`` is a struct of `BUNDLE`."""
    rows = settled(payloads, "_bundle", bundle)
    extracted = c("extracted_at") if "extracted_at" in payloads.columns else F.lit(None).cast("string")
    messages = c("_bundle.messages")
    return rows.select(*KEY, "url", "_bundle.title", extracted.alias("extracted_at"), "_bundle.source_updated_at",
                       people_of(messages, c("platform")).alias("participants"), messages.alias("messages"), "_bundle.meta")


def _last_time(messages: Column) -> Column:
    return F.get(messages, F.size(messages) - 1)["created_at"]


def explode_messages(bundles: DataFrame) -> DataFrame:
    """(KEY, pos, id, role, markdown, created_at)"""
    return bundles.select(*KEY, F.posexplode("messages").alias("pos", "m")).select(
        *KEY, c("pos").cast("bigint").alias("pos"), "m.*")


def split(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundles with messages, rejects with a reason)"""
    usable = F.size(F.coalesce("messages", F.array().cast(MESSAGE))) > 0
    return (bundles.where(usable), bundles.where(~usable).select(*KEY, "url", F.lit("no usable messages").alias("reason")))


# ---------------------------------------------------------------- ChatGPT

def flatten_parts(content: Column) -> Column:
    """Markdown of a message's content (JSON text): texts, or the first known member of an object, or its JSON."""
    typed = F.from_json(content, "parts array<variant>")["parts"]
    raw = F.from_json(content, "parts array<string>")["parts"]

    def one(pair: Column) -> Column:
        v = pair["v"]
        kind = v_type(v)
        members = [v_text(v, f"$.{n}") for n in ("text", "content", "title", "url")]
        return (F.when(kind == "STRING", v.cast("string"))
                .when(kind.rlike("^(OBJECT|ARRAY)"), F.coalesce(*members, pair["r"])))

    texts = F.transform(F.arrays_zip(typed.alias("v"), raw.alias("r")), lambda p: js_trim(one(p)))
    return F.coalesce(_joined(texts), F.lit(""))


CHATGPT = ("title string, current_node string, update_time variant, mapping map<string,struct<id:string,parent:string,"
           "message:struct<id:string,author:struct<role:string>,create_time:variant,content:string>>>")


def branch_of(mapping: Column, head: Column) -> Column:
    """The ids from the root to ``head``, parent by parent; a repeat ends the walk."""
    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        known = F.map_contains_key(mapping, F.coalesce(at, F.lit(""))) & ~F.array_contains(state["path"], F.coalesce(at, F.lit("")))
        further = F.struct(F.try_element_at(mapping, at)["parent"].alias("at"), F.concat(state["path"], F.array(at)).alias("path"))
        return F.when(F.coalesce(known & (at != ""), F.lit(False)), further).otherwise(F.struct(
            F.lit(None).cast("string").alias("at"), state["path"].alias("path")))

    first = F.struct(head.alias("at"), F.array().cast("array<string>").alias("path"))
    return F.reverse(F.aggregate(F.sequence(F.lit(1), F.size(mapping)), first, step)["path"])


@made_once
def chatgpt_shape(row: Payload) -> Column:
    """The branch that ends at the current node of a tree payload."""
    def message(key: Column, n: Column) -> Column:
        m = n["message"]
        return F.struct(F.coalesce(m["id"], n["id"], F.concat(F.lit("chatgpt-"), key)).alias("id"),
                        normalize_role(m["author"]["role"], "chatgpt").alias("role"),
                        flatten_parts(m["content"]).alias("markdown"),
                        v_time(m["create_time"], "chatgpt_payload").alias("created_at"))

    def shaped(p: Column) -> Column:
        # A walk has a step for each node, and none in an empty tree.
        path = F.when(F.size(p["mapping"]) > 0, branch_of(p["mapping"], p["current_node"])).otherwise(F.array().cast("array<string>"))
        found = F.transform(path, lambda k: let(F.try_element_at(p["mapping"], k), lambda n: message(k, n)))
        usable = F.filter(found, lambda m: m["role"].isNotNull() & (m["markdown"] != ""))
        meta = F.struct(F.lit("api").alias("source"), F.greatest(F.coalesce(F.size(p["mapping"]), F.lit(0)), F.lit(0)).alias("rawNodeCount"))
        return let(usable, lambda messages: _bundle(
            p["title"], F.coalesce(v_time(p["update_time"], "chatgpt_payload"), _last_time(messages)),
            F.when(p["mapping"].isNotNull(), messages), meta))

    return let(F.from_json(row.text, CHATGPT), shaped)


def parse_chatgpt(payloads: DataFrame) -> DataFrame:
    return bundles_of(payloads, chatgpt_shape(payload_of(payloads)))


# ---------------------------------------------------------------- DeepSeek

DEEPSEEK = ("data struct<biz_data:struct<chat_session:struct<id:string,title:string>,chat_messages:array<struct<"
            "message_id:variant,role:string,content:string,thinking_content:string,inserted_at:variant,"
            "fragments:array<struct<type:string,content:string>>,files:array<struct<file_name:string,status:string,"
            "error_code:string,file_size:bigint,download_url:string>>>>>>")


def file_blocks(files: Column) -> Column:
    """Attachment blocks of the named files that did not fail."""
    kept = F.filter(files, lambda f: (F.coalesce(f["file_name"], F.lit("")) != "") & f["error_code"].isNull()
                    & ~f["status"].eqNullSafe("FAILED"))

    def block(f: Column) -> Column:
        size = F.when(f["file_size"].isNotNull(), F.concat(F.lit(" ("), format_file_size(f["file_size"]), F.lit(")")))
        link = F.concat(F.lit("["), f["file_name"], F.lit("]("), f["download_url"], F.lit(")"))
        plain = F.concat(f["file_name"], F.coalesce(size, F.lit("")))
        return F.concat(F.lit("> [attachment] "), F.when(
            F.coalesce(f["download_url"], F.lit("")) != "", link).otherwise(plain))

    return F.coalesce(F.transform(kept, block), F.array().cast("array<string>"))


def deepseek_markdown(m: Column) -> Column:
    def ink(x: Column) -> Column:
        return blank_to_null(js_trim(x))

    pieces = F.transform(F.coalesce(m["fragments"], F.array().cast("array<struct<type:string,content:string>>")),
                         lambda f: F.when(f["type"] == "THINK", format_thinking(ink(f["content"]))).otherwise(ink(f["content"])))
    thinking = format_thinking(ink(m["thinking_content"]))
    body = F.coalesce(ink(m["content"]), blank_to_null(_joined(F.concat(F.array(thinking), pieces))))
    return blank_to_null(_joined(F.concat(file_blocks(m["files"]), F.array(append_url_attachments(body)))))


@made_once
def deepseek_shape(row: Payload) -> Column:
    def shaped(m: Column, i: Column) -> Column:
        number = F.coalesce(m["message_id"].try_cast("string").try_cast("double"), F.lit(0.0))
        text = F.when(v_is_number(m["message_id"]) | (v_type(m["message_id"]) == "STRING"), m["message_id"].cast("string"))
        return F.struct(number.alias("n"), i.alias("i"), blank_to_null(text).alias("id"),
                        normalize_role(m["role"], "deepseek").alias("role"), deepseek_markdown(m).alias("markdown"),
                        v_time(m["inserted_at"], "deepseek_message").alias("created_at"))

    def made(p: Column) -> Column:
        raw = p["chat_messages"]
        named = F.transform(F.array_sort(F.transform(raw, shaped)), lambda m, i: F.struct(
            F.coalesce(m["id"], F.concat(F.lit("deepseek-message-"), i.cast("string"))).alias("id"), m["role"].alias("role"),
            m["markdown"].alias("markdown"), m["created_at"].alias("created_at")))
        usable = F.filter(named, lambda m: m["role"].isNotNull() & m["markdown"].isNotNull())
        meta = F.struct(F.lit("api").alias("source"), F.coalesce(F.size(raw), F.lit(0)).alias("rawMessageCount"))
        return let(F.coalesce(usable, F.array().cast(MESSAGE)), lambda messages: _bundle(
            p["chat_session"]["title"], _last_time(messages), messages, meta))

    return let(F.from_json(row.text, DEEPSEEK)["data"]["biz_data"], made)


def parse_deepseek(payloads: DataFrame) -> DataFrame:
    return bundles_of(payloads, deepseek_shape(payload_of(payloads)))


# ---------------------------------------------------------------- Gemini

def decode_rpc_envelope(text: Column, rpc_id: str = "hNvQHb") -> Column:
    """The inner payload (text) of a batched RPC answer; the first line's when no chunk carries the id."""
    stripped = F.regexp_replace(text, r"^\)\]\}'\n", "")
    chunks = F.transform(F.split(stripped, r"\n\d+\n"), F.try_parse_json)
    right = F.filter(chunks, lambda v: F.coalesce(v_text(v, "$[0][1]") == rpc_id, F.lit(False))
                     & v_text(v, "$[0][2]").isNotNull())
    first = F.try_parse_json(F.substring_index(F.regexp_replace(stripped, r"^\d+\n", ""), "\n", 1))
    return F.coalesce(v_text(F.get(right, 0), "$[0][2]"), v_text(first, "$[0][2]"))


def attachment_key(a: Column) -> Column:
    return F.concat(F.trim(F.coalesce(a["name"], F.lit(""))), F.lit("::"), F.trim(a["url"]))


def fresh_attachments(current: Column, previous: Column) -> Column:
    """What a turn adds: when all of the previous turn's attachments recur, those are dropped; else all stay."""
    before = F.transform(previous, attachment_key)
    inherited = (F.size(before) > 0) & (F.size(F.array_except(before, F.transform(current, attachment_key))) == 0)
    return F.when(F.coalesce(inherited, F.lit(False)),
                  F.filter(current, lambda a: ~F.array_contains(before, attachment_key(a)))).otherwise(current)


def drop_inherited(turns: DataFrame) -> DataFrame:
    """Turns (KEY, turn, attachments) without the attachments they inherit from turn - 1.

    `turn` counts without gaps, so the previous turn is an equi join on (KEY, turn): a long
    conversation spreads over the cluster, as no window over its key could.
    """
    before = turns.select(*KEY, (c("turn") + 1).alias("turn"), c("attachments").alias("_before"))
    return turns.join(before, [*KEY, "turn"], "left").withColumn(
        "attachments", fresh_attachments(c("attachments"), c("_before"))).drop("_before")


def _ink(x: Column, default: Column) -> Column:
    return F.coalesce(blank_to_null(js_trim(x)), default)


def _pair_ms(t: Column) -> Column:
    """[seconds, nanos] of a turn in epoch milliseconds."""
    s, n = v_get(t, "$[4][0]"), v_get(t, "$[4][1]")
    whole = s.try_cast("string").try_cast("decimal(30,9)") * 1000
    part = F.floor(n.try_cast("string").try_cast("decimal(30,9)") / 1000000)
    return F.floor(whole + F.coalesce(part, F.lit(0))).cast("bigint")


@made_once
def gemini_shape(row: Payload, rpc_id: str = "hNvQHb") -> Column:
    def ordered(raw: Column) -> Column:
        # NULL sorts before every time, ties keep their place: the order of the turns.
        order = F.array_sort(F.transform(raw, lambda t, i: F.struct(
            F.coalesce(_pair_ms(t), F.lit(-(1 << 62)).cast("bigint")).alias("at"), i.alias("i"))))
        return F.filter(F.transform(order, lambda o: F.get(raw, o["i"])), lambda t: nested.members(t).isNotNull())

    def opened(t: Column) -> Column:
        prompt = v_get(t, "$[2]")
        return F.struct(t.alias("v"), iso_from_ms(_pair_ms(t)).alias("at"), *[
            nested.collect_nested(prompt, kind).alias(f"{kind}s") for kind in ("image", "document")])

    def image(a: Column, i: Column) -> Column:
        alt = _ink(a["name"], F.concat(F.lit("image-"), (i + 1).cast("string")))
        return F.concat(F.lit("!["), alt, F.lit("]("), a["url"], F.lit(")"))

    def document(a: Column, i: Column) -> Column:
        last = blank_to_null(F.element_at(F.split(a["url"], "/"), -1))
        title = _ink(a["name"], F.coalesce(last, F.concat(F.lit("attachment-"), (i + 1).cast("string"))))
        return F.concat(F.lit("> [attachment] ["), title, F.lit("]("), a["url"], F.lit(")"))

    def voices(turns: Column, x: Column, i: Column) -> Column:
        t, before = x["v"], F.get(turns, i - 1)
        answer = v_get(t, "$[3][0][0]")
        added = [fresh_attachments(x[kind], before[kind]) for kind in ("images", "documents")]
        asked = _joined(F.concat(F.transform(added[0], image), F.transform(added[1], document),
                                 F.array(js_trim(v_text(t, "$[2][0][0]")))))
        plain = replace_interactive_blocks(blank_to_null(js_trim(v_text(answer, "$[1][0]"))), row.url)
        thoughts = F.transform(v_array(answer, "$[37]"), lambda e: js_trim(F.coalesce(v_text(e, "$[0]"), v_text(e, "$[0][0]"))))
        said = _joined(F.array(format_thinking(blank_to_null(js_trim(_joined(thoughts)))), plain))
        number = (i + 1).cast("string")
        return F.array(
            F.struct(F.concat(F.lit("user-"), number).alias("id"), F.lit("user").alias("role"), asked.alias("markdown"),
                     x["at"].alias("created_at")),
            F.struct(F.coalesce(v_text(answer, "$[0]"), F.concat(F.lit("assistant-"), number)).alias("id"),
                     F.lit("assistant").alias("role"), said.alias("markdown"), x["at"].alias("created_at")))

    def made(messages: Column) -> Column:
        dated = F.filter(messages, lambda m: (m["role"] == "assistant") & m["created_at"].isNotNull())
        meta = F.struct(F.lit("gemini.google.com").alias("sourceHost"), F.lit("page-world-rpc").alias("source"),
                        F.size(messages).alias("turnCount"))
        return _bundle(row.title, _last_time(dated), messages, meta)

    def spoken(turns: Column) -> Column:
        return F.filter(F.flatten(F.transform(turns, lambda x, i: voices(turns, x, i))), lambda m: m["markdown"] != "")

    raw = let(F.try_parse_json(decode_rpc_envelope(row.text, rpc_id)), lambda v: v_array(v, "$[0]"))
    turns = F.transform(let(raw, ordered), opened)
    return let(let(turns, spoken), made)


def parse_gemini(payloads: DataFrame, rpc_id: str = "hNvQHb") -> DataFrame:
    return bundles_of(payloads, gemini_shape(payload_of(payloads), rpc_id))


# ---------------------------------------------------------------- AI Studio

@made_once
def aistudio_shape(row: Payload) -> Column:
    def message(t: Column, i: Column) -> Column:
        role = F.when(v_text(t, "$[8]") == "user", "user").otherwise("assistant")
        return let(F.struct(role.alias("role"), F.concat(role, F.lit("-"), (i + 1).cast("string")).alias("id"),
                            nested.turn_files(t).alias("files")), lambda x: written(t, x))

    def written(t: Column, x: Column) -> Column:
        sections = v_array(t, "$[29]")
        flagged = F.forall(sections, lambda s: F.coalesce(
            v_is_number(v_get(s, "$[12]")) & (F.try_variant_get(s, "$[12]", "double") == 1), F.lit(False)))
        minus = F.coalesce(v_is_number(v_get(t, "$[25]")) & (F.try_variant_get(t, "$[25]", "double") == -1), F.lit(False))
        thought = (x["role"] == "assistant") & (minus | ((F.size(sections) > 0) & flagged))
        text = blank_to_null(normalize_prompt_text(v_text(t, "$[0]")))

        def inline(a: Column) -> Column:
            ext = F.coalesce(blank_to_null(F.regexp_replace(F.get(F.split(a["mime"], "/"), 1), "(?i)[^a-z0-9.+-]", "")), F.lit("png"))
            shown = F.concat(F.lit("!["), x["id"], F.lit("."), ext, F.lit("](data:"), a["mime"], F.lit(";base64,"), a["payload"], F.lit(")"))
            # A media type in capitals matches the search but gets the bare marker.
            return (F.when(a["mime"].startswith("image/"), shown)
                    .when(a["mime"].startswith("text/"), decode_inline_text(a["mime"], a["payload"]))
                    .otherwise(F.concat(F.lit("> [attachment] "), a["mime"])))

        drive = F.transform(x["files"]["drive_ids"], lambda d: F.concat(
            F.lit("> [attachment] [Google Drive resource "), d, F.lit("](https://drive.google.com/open?id="), d, F.lit(")")))
        body = F.when(thought, format_thinking(text, "aistudio")).otherwise(text)
        markdown = js_trim(_joined(F.concat(F.transform(x["files"]["inline"], inline), drive, F.array(body))))
        return F.struct(x["id"].alias("id"), x["role"].alias("role"), markdown.alias("markdown"),
                        iso_from_ms(nested.turn_timestamp_ms(t)).alias("created_at"), x["files"]["drive_ids"].alias("drive_ids"))

    def made(v: Column, found: Column) -> Column:
        linked = F.flatten(F.transform(found, lambda m: F.transform(m["drive_ids"], lambda d: F.struct(
            m["id"].alias("messageId"), F.lit("resource").alias("kind"), F.concat(F.lit("Google Drive resource "), d).alias("title"),
            F.concat(F.lit("https://drive.google.com/open?id="), d).alias("sourceUrl"), d.alias("resourceId")))))

        def attribute(name: str) -> Column:
            hits = F.filter(v_array(v, "$[0][4][10]"), lambda e: F.coalesce(v_text(e, "$[0]") == name, F.lit(False)))
            return let(hits, lambda h: v_text(F.get(h, F.size(h) - 1), "$[1]"))

        def inked(path: str) -> Column:
            return let(v_text(v, path), lambda text: F.when(js_trim(text) != "", text))

        meta = F.struct(F.lit("aistudio.google.com").alias("sourceHost"), inked("$[0][3][2]").alias("model"),
                        attribute("promptType").alias("promptType"),
                        F.coalesce(attribute("hasImages") == "true", F.lit(False)).alias("hasImages"),
                        F.size(found).alias("turnCount"), linked.alias("linkedAttachments"))
        pair = [v_get(v, f"$[0][4][4][0][{i}]").try_cast("string") for i in (0, 1)]
        messages = F.transform(found, lambda m: F.struct(*[m[n].alias(n) for n in ("id", "role", "markdown", "created_at")]))
        return _bundle(inked("$[0][4][0]"), iso_from_pair(*pair), messages, meta)

    def shaped(v: Column) -> Column:
        found = F.filter(F.transform(nested.find_role_turns(v), message), lambda m: m["markdown"] != "")
        return let(found, lambda f: made(v, f))

    return let(F.try_parse_json(row.text), shaped)


def parse_aistudio(payloads: DataFrame) -> DataFrame:
    return bundles_of(payloads, aistudio_shape(payload_of(payloads)))


SHAPES: dict[str, Shape] = {"chatgpt": chatgpt_shape, "deepseek": deepseek_shape, "gemini": gemini_shape, "aistudio": aistudio_shape}


# ---------------------------------------------------------------- lists

EVENT = "array<struct<source_id:string,url:string,title:string,source_updated_at:string>>"


def _event(source_id: Column, url: Column, title: Column, at: Column) -> Column:
    return F.struct(source_id.alias("source_id"), url.alias("url"), title.alias("title"), at.alias("source_updated_at"))


def _first_present(v: Column, *paths: str) -> Column:
    def given(p: str) -> Column:
        x = v_get(v, p)
        return F.when(v_type(x) != "VOID", x)
    return F.coalesce(*[given(p) for p in paths])


def _chatgpt_list(v: Column) -> Column:
    kind = v_type(v)
    items = (F.when(kind.startswith("ARRAY"), v_array(v, "$"))
             .when(v_type(v_get(v, "$.items")).startswith("ARRAY"), v_array(v, "$.items"))
             .when(kind.startswith("OBJECT"), F.array(v)))

    def one(x: Column) -> Column:
        sid = F.coalesce(v_text(x, "$.id"), v_text(x, "$.conversation_id"))
        url = v_text(x, "$.url")
        return _event(sid, F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://chatgpt.com/c/"), sid)),
                      v_text(x, "$.title"), v_time(_first_present(x, "$.update_time", "$.updated_at"), "chatgpt_list"))

    return F.transform(items, one)


def _deepseek_list(v: Column) -> Column:
    def session(x: Column, at: Column) -> Column:
        sid = F.coalesce(*[v_text(x, f"$.{n}") for n in ("id", "chat_session_id", "session_id")])
        return _event(sid, F.concat(F.lit("https://chat.deepseek.com/a/chat/s/"), sid), blank_to_null(v_text(x, "$.title")),
                      v_time(at, "deepseek_list"))

    biz = "$.data.biz_data"
    messages = v_array(v, f"{biz}.chat_messages")
    last = v_get(F.get(messages, F.size(messages) - 1), "$.inserted_at")
    current = v_get(v, f"{biz}.chat_session")
    here = session(current, F.coalesce(_first_present(current, "$.updated_at"), last))
    lists = [F.transform(v_array(v, p), lambda x: session(x, _first_present(x, "$.updated_at", "$.inserted_at")))
             for p in (f"{biz}.chat_sessions", f"{biz}.sessions", "$.data.items", "$.data.list")]
    return F.concat(F.array(here), *lists)


def _aistudio_list(v: Column) -> Column:
    def prompt(x: Column) -> Column:
        path = v_text(x, "$[0]")
        url = F.concat(F.lit("https://aistudio.google.com/"), path)
        pair = [v_get(x, f"$[4][4][0][{i}]") for i in (0, 1)]
        at = F.when(v_type(pair[0]) == "STRING", iso_from_pair(pair[0].try_cast("string"), pair[1].try_cast("string")))
        return _event(F.when(path.startswith("prompts/"), source_id_from_url(url, "aistudio")), url,
                      blank_to_null(js_trim(v_text(x, "$[4][0]"))), at)
    return F.transform(v_array(v, "$[0]"), prompt)


# How a list row looks inside a batched answer, plain and escaped once more.
GEMINI_ROWS = (
    r'\["c_([^"]+)","((?:\\.|[^"\\])*+)",null,null,null,\[(\d+)(?:,(\d+))?\]',
    r'\\"c_([^\\"]+)\\",\\"((?:\\\\.|[^\\"])*+)\\",null,null,null,\[(\d+)(?:,(\d+))?\]',
)


def _gemini_list(text: Column) -> Column:
    def rows(pattern: str, escaped: bool) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4)]
        found = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd")])
        found = F.filter(found, lambda r: (r["a"] != "") & (r["b"] != ""))

        def one(r: Column) -> Column:
            raw = F.replace(r["b"], F.lit("\\\\"), F.lit("\\")) if escaped else r["b"]
            title = F.get_json_object(F.concat(F.lit('{"t":"'), raw, F.lit('"}')), "$.t")
            return _event(r["a"], F.concat(F.lit("https://gemini.google.com/app/"), r["a"]), blank_to_null(js_trim(title)),
                          iso_from_pair(r["c"], blank_to_null(r["d"])))
        return F.transform(found, one)

    plain = rows(GEMINI_ROWS[0], False)
    return F.when(F.size(plain) > 0, plain).otherwise(rows(GEMINI_ROWS[1], True))


def parse_discovery(payloads: DataFrame, platform: str) -> DataFrame:
    """List payloads (page, payload) to (page, platform, source_id, url, title, source_updated_at, seq), deduped per page."""
    # A payload is parsed once, however many of its paths are read.
    shapes = {"chatgpt": _chatgpt_list, "deepseek": _deepseek_list, "aistudio": _aistudio_list}
    items = _gemini_list(c("payload")) if platform == "gemini" else let(F.try_parse_json("payload"), shapes[platform])
    rows = payloads.select("page", F.posexplode(items).alias("seq", "e")).select(
        "page", F.lit(platform).alias("platform"), "e.*", c("seq").cast("bigint").alias("seq"))
    rows = rows.where(F.coalesce("source_id", F.lit("")) != "")
    if platform == "chatgpt":
        return rows
    keys = ["page", *KEY]
    return (dedupe_last(rows, keys) if platform == "deepseek" else dedupe_coalesce(rows, keys)).drop("first_seq")
