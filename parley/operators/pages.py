"""Jobs over landed HTML pages (page_id, url, html). Each page is one row, so they are row-local."""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.html import COLUMNS, PageBlocks
from parley.functions.markdown import format_thinking, normalize_prompt_text
from parley.functions.text import blank_to_null, collapse, js_trim, let, normalize_title
from parley.functions.times import extract_time_label
from parley.functions.urls import canonical_url, resolve_url
from parley.operators import KEY, settled
from parley.operators.discovery import dedupe_coalesce, dedupe_last
from parley.operators.ordered import ordered_texts

c = F.col
#: Entity names to characters, from the standard library's table.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
ANCHOR = r"(?is)<a\b[^>]*>.*?</a>(?:(?!<a\b|</li>).)*+"
# Fixed value: the entry of the history list that is open.
ACTIVE = r'(?is)<a\b(?=[^>]*\baria-current="page")(?=[^>]*\bhref="[^"]*/app/)[^>]*>(.*?)</a>'
# Elements of a page that are controls.
CONTROLS = ("button", "svg", "script", "style", "textarea", "select")
FILE_NAME = r"(?i)\.(?:pdf|png|jpe?g|gif|webp|bmp|svg|docx?|pptx?|xlsx?|csv|tsv|md|txt)\z"
# The words above a captured question that are not part of it.
PROMPT_CAPTION = r"(?i)^(?:你说|you said)\z"


def _unescaped(part: Column) -> Column:
    """What follows an ampersand, with the entity it begins with, if any, replaced by its character."""
    name = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,30});", 1)
    number = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(
        F.regexp_extract(name, "^#([0-9]+)$", 1)).try_cast("int")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    known = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    shown = F.coalesce(char, F.try_element_at(known, name))
    return F.when((name != "") & shown.isNotNull(), F.concat(shown, F.substr(part, F.length(name) + 2))).otherwise(
        F.concat(F.lit("&"), part))


def text_of(html: Column) -> Column:
    """The text of a piece of HTML: tags go, entities become their characters, each once."""
    flat = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    parts = F.split(flat, "&")
    shown = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _unescaped), ""))
    return F.when(flat.contains("&"), shown).otherwise(flat)


def attribute(tag: Column, name: str) -> Column:
    return blank_to_null(F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*["\']([^"\']*)["\']', 1))


def page_links(pages: DataFrame, id_pattern: str, origin: str | None = None, coalesce_fields: bool = True,
               dialect: str = "google") -> DataFrame:
    """(page_id, source_id, url, title, source_updated_label, seq): a page's links whose address matches.

    Relative links resolve against ``origin``, by default the page's own. Repeats of an id merge field by
    field, or the last one wins whole.
    """
    rows = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("seq", "_link"))
    # A link's tag ends at its first bracket, the link at its first end tag.
    sides = F.split("_link", "(?i)</a>", 2)
    tag = F.substring_index(sides[0], ">", 1)
    rows = rows.select("page_id", "url", "seq", F.struct(
        tag.alias("tag"), F.substr(sides[0], F.length(tag) + 2).alias("inner"), sides[1].alias("after")).alias("a"))
    base = F.lit(origin) if origin else F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    href = attribute(c("a.tag"), "href")
    rows = settled(rows.where(href.isNotNull()), "link", canonical_url(resolve_url(href, base)))
    near = [attribute(c("a.tag"), "aria-label"), attribute(c("a.tag"), "title"), text_of(c("a.after"))]
    rows = rows.select(
        "page_id", blank_to_null(F.regexp_extract("link", id_pattern, 1)).alias("source_id"), c("link").alias("url"),
        blank_to_null(collapse(text_of(c("a.inner")))).alias("title"), F.lit(None).cast("string").alias("source_updated_at"),
        F.coalesce(*[extract_time_label(x, dialect) for x in near]).alias("source_updated_label"),
        c("seq").cast("bigint").alias("seq")).where(c("source_id").isNotNull())
    merge = dedupe_coalesce if coalesce_fields else dedupe_last
    return merge(rows, ["page_id", "source_id"]).select(
        "page_id", "source_id", "url", "title", "source_updated_label", c("first_seq").alias("seq"))


def page_title(pages: DataFrame, suffix: str, heading: str = r"(?is)<h1\b[^>]*>(.*?)</h1>", strict: bool = True) -> DataFrame:
    """(page_id, title): heading, then the active entry of the history list, then <title> without the site's name, then
    the first prompt line, then NULL.

    ``strict`` drops generic titles on the way.
    """
    def clean(x: Column) -> Column:
        flat = collapse(text_of(x))
        return normalize_title(flat) if strict else blank_to_null(flat)

    named = F.regexp_replace(text_of(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)),
                             rf"(?i)\s*\|\s*{suffix}\s*\z", "")
    prompt = F.regexp_extract("html", r'(?is)class="[^"]*\bquery-text\b[^"]*"[^>]*>(.*?)</(?:div|span|p)>', 1)
    lines = F.filter(F.transform(F.split(text_of(prompt), r"\r?\n"), js_trim),
                     lambda x: (x != "") & ~x.rlike(PROMPT_CAPTION))
    return pages.select("page_id", F.coalesce(
        clean(F.regexp_extract("html", heading, 1)), clean(F.regexp_extract("html", ACTIVE, 1)), clean(named), F.substring(F.get(lines, 0), 1, 80)).alias("title"))


#: Tokens that a fold takes together, so that texts are joined in two steps and not token by token.
STRETCH = 128
# What a page is cut into: elements of raw text as wholes, comments, tags, and the text between.
TOKENS = (r"(?is)<(?:script|style|textarea)\b[^>]*>.*?</(?:script|style|textarea)\s*>|<!--.*?-->|"
          r"</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^<]++|<")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _tokens(html: Column, controls: tuple[str, ...]) -> Column:
    """array<struct<text, name, closes, opens>>: ``opens`` tells the tags of controls and hidden elements."""
    def seen(t: Column) -> Column:
        tag = t.rlike("^</?[a-zA-Z]")
        name = F.when(tag, F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)))
        closes = tag & t.startswith("</")
        hidden = t.contains("aria-hidden") & t.rlike(r"""(?i)\saria-hidden\s*=\s*["']?true\b""")
        return F.struct(t.alias("text"), name.alias("name"), closes.alias("closes"),
                        F.coalesce(tag & ~closes & (name.isin(*controls) | hidden), F.lit(False)).alias("opens"))

    return F.transform(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0)), seen)


def strip_page_chrome(html: Column, controls: tuple[str, ...] = (*CONTROLS, "input")) -> Column:
    """The page without controls and hidden elements, each with all it holds.

    One fold over the tags with the name and the depth of the element that is being left out: only elements of its own
    name nest, as others may leave out their end tags. An element that is never closed loses its tag only.
    """
    def step(s: Column, t: Column) -> Column:
        inside = s["name"].isNotNull()
        # An element without content: void by its name, raw as one token, or closed in its own tag.
        alone = t["name"].isin(*VOID, "script", "style", "textarea") | (t["name"].isin("svg") & t["text"].endswith("/>"))
        same = F.coalesce(t["name"] == s["name"], F.lit(False)) & ~F.coalesce(alone, F.lit(False))
        depth = s["depth"] + F.when(same & t["closes"], -1).when(same, 1).otherwise(0)
        ends = inside & (depth == 0)
        begins = ~inside & t["opens"] & ~alone
        return F.struct(
            F.when(ends, F.lit(None)).when(begins, t["name"]).otherwise(s["name"]).cast("string").alias("name"),
            F.when(inside, depth).when(begins, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("depth"),
            F.when(inside | t["opens"], s["kept"]).otherwise(F.concat(s["kept"], t["text"])).alias("kept"),
            F.when(ends | begins, F.lit("")).when(inside, F.concat(s["held"], t["text"])).otherwise(s["held"]).alias("held"),
            (s["began"] | begins).alias("began"))

    def stretch(s: Column, part: Column) -> Column:
        start = F.struct(s["name"].alias("name"), s["depth"].alias("depth"), F.lit("").alias("kept"), F.lit("").alias("held"),
                         F.lit(False).alias("began"))
        return let(F.aggregate(part, start, step), lambda e: F.struct(
            e["name"].alias("name"), e["depth"].alias("depth"), F.concat(s["kept"], F.array(e["kept"])).alias("kept"),
            # What was left out since the element began, in this stretch or before it.
            F.when(e["name"].isNull(), F.array().cast("array<string>")).when(e["began"], F.array(e["held"])).otherwise(
                F.concat(s["held"], F.array(e["held"]))).alias("held")))

    def folded(tokens: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / STRETCH).cast("int")),
                            lambda k: F.slice(tokens, k * STRETCH + 1, STRETCH))
        first = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("depth"),
                         F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("held"))
        return let(F.aggregate(parts, first, stretch), lambda e: F.concat(F.array_join(e["kept"], ""), F.array_join(e["held"], "")))

    return F.when(html == "", html).otherwise(let(_tokens(html, controls), folded))


BLOCKS = ("page_id bigint, pos bigint, kind string, markdown string, turn bigint, turn_id string, role string, "
          "created_at string")


def pages_to_blocks(pages: DataFrame) -> DataFrame:
    """Ordered markdown blocks of every page; `turn` numbers the chat turns, -1 outside any."""
    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                rows.extend((page_id, *row) for row in PageBlocks().blocks(html or ""))
                if len(rows) >= 5_000:
                    yield pd.DataFrame(rows, columns=["page_id", *COLUMNS])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", *COLUMNS])

    return pages.select("page_id", "html").mapInPandas(convert, BLOCKS)


def infer_role(attribute_value: Column) -> Column:
    low = F.lower(F.coalesce(attribute_value, F.lit("")))
    return F.when(low.rlike("user|human"), "user").otherwise("assistant")


def blocks_to_turns(blocks: DataFrame) -> DataFrame:
    """(page_id, turn, id, role, markdown, created_at): turns with ink, in page order.

    A turn's thoughts come first, quoted as thinking. A group is one turn of one page row.
    """
    thought = c("kind") == "thought"
    thoughts = F.array_join(ordered_texts(c("pos"), c("markdown"), thought), "\n\n")
    said = F.array_join(ordered_texts(c("pos"), c("markdown"), ~thought), "\n\n")
    rows = blocks.where("turn >= 0").groupBy("page_id", "turn").agg(
        F.max("turn_id").alias("turn_id"), F.max("role").alias("role"), F.max("created_at").alias("created_at"),
        thoughts.alias("thoughts"), said.alias("said"))
    quoted = format_thinking(blank_to_null(c("thoughts")), "aistudio")
    rows = rows.withColumn("markdown", F.concat_ws("\n\n", quoted, blank_to_null(c("said")))).where(js_trim(c("markdown")) != "")
    role = infer_role(c("role"))
    made = F.concat(role, F.lit("-"), (c("turn") + 1).cast("string"))
    return rows.select("page_id", "turn", F.coalesce("turn_id", made).alias("id"), role.alias("role"), "markdown", "created_at")


def attachment_cards(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Cards (keys, pos, name, meta) that name a file, distinct by name and meta, with their block."""
    rows = cards.where((F.length("name") <= 260) & c("name").rlike(FILE_NAME))
    rows = rows.groupBy(*keys, "name", "meta").agg(F.min("pos").alias("pos"))
    size = F.when(F.coalesce("meta", F.lit("")) != "", F.concat(F.lit(" ("), "meta", F.lit(")"))).otherwise("")
    return rows.withColumn("markdown", F.concat(F.lit("> [attachment] "), "name", size))


def drop_adjacent_duplicates(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised blocks without blank ones and without repeats of the one just before. A group is one page's turn."""
    rows = settled(blocks, "markdown", normalize_prompt_text(c("markdown"), dom=True)).where("markdown <> ''")
    before = F.lag("markdown").over(W.partitionBy(*keys).orderBy("pos"))
    return rows.withColumn("_before", before).where(~c("_before").eqNullSafe(c("markdown"))).drop("_before")


def distinct_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The first of equal trimmed blocks of a group."""
    rest = [x for x in blocks.columns if x not in keys]
    rows = blocks.withColumn("_text", js_trim(c("markdown"))).where("_text <> ''")
    return (rows.groupBy(*keys, "_text").agg(F.min_by(F.struct(*rest), "pos").alias("_row"))
            .select(*keys, "_row.*").select(*blocks.columns))


# Captions of the settings panel and the names their values get.
SETTINGS = {"System instructions": "systemInstructions", "Temperature": "temperature",
            "Media resolution": "mediaResolution", "Thinking level": "thinkingLevel"}
CONTAINER = r'(?i)<[a-z][a-z0-9-]*\b[^>]*class="[^"]*\b(?:settings-item|selector-container|field-group|overlay-header)\b[^"]*"[^>]*>'


# What follows the settings panel on a page.
AFTER = r'(?is)<ms-chat-turn\b|<[a-z][a-z0-9-]*\b[^>]*class="[^"]*\b(?:settings-tool|group-title)\b|<main\b|</(?:aside|section)\s*>'


def page_settings(pages: DataFrame) -> DataFrame:
    """(page_id, meta): model, tools and the settings panel as JSON. A panel row ends where the next one, the tools, the
    chat or the panel's end begins."""
    panels = F.transform(F.split("html", CONTAINER), lambda p: F.get(F.split(p, AFTER), 0))

    def value(label: str) -> Column:
        hits = F.filter(panels, lambda p: p.rlike(rf"(?is)>\s*{label}\s*</"))
        return blank_to_null(collapse(text_of(F.regexp_replace(F.get(hits, 0), r"(?is)<[^>]*>", " "))))

    model = F.regexp_extract("html", r'(?is)data-test-id="model-name"[^>]*>([^<]*)<', 1)
    tools = F.concat(
        F.regexp_extract_all("html", F.lit(r'(?is)class="[^"]*\bsettings-tool\b[^"]*"[^>]*>\s*<[^>]*class="[^"]*\bitem-description-title\b'
                                           r'[^"]*"[^>]*>([^<]*)<'), F.lit(1)),
        F.regexp_extract_all("html", F.lit(r'(?is)class="[^"]*\bgroup-title\b[^"]*"[^>]*>([^<]*)<'), F.lit(1)))
    tools = F.filter(F.transform(tools, lambda t: js_trim(text_of(t))), lambda t: t != "")
    return pages.select("page_id", F.to_json(F.struct(
        F.lit("aistudio.google.com").alias("sourceHost"), blank_to_null(js_trim(model)).alias("model"),
        *[value(label).alias(name) for label, name in SETTINGS.items()], tools.alias("tools"))).alias("meta"))


def turns_as_messages(turns: DataFrame, pages: DataFrame, platform: str, source_id: Column) -> DataFrame:
    """Turns as rows of the messages table; ``source_id`` is an expression over the page's url."""
    ids = pages.select("page_id", F.lit(platform).alias("platform"), source_id.alias("source_id"))
    return turns.join(ids, "page_id").select(*KEY, c("turn").alias("pos"), "id", "role", "markdown", "created_at")
