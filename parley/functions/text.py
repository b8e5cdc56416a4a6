"""Whitespace, titles, quoting, paths, tokens: the scalar helpers everything keys on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as white space.
SPACE_CHARS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACES = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000\ufeff")
# The same as classes: an ASCII letter fails the first two tests, the gaps between the rare ones come after.
_RARE = (r"\x{a0}-\x{feff}&&[^\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}"
         r"\x{2060}-\x{2fff}\x{3001}-\x{fefe}]")
SPACE = r"[\t\n\x0b\f\r " + _RARE + "]"
# Without the line feed, for rules that work within one line.
INLINE_SPACE = r"[\t\x0b\f\r " + _RARE + "]"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"

# Titles that say nothing about a conversation (exact), and one such prefix.
GENERIC_TITLES = (
    "google gemini", "gemini", "google ai studio", "ai studio", "deepseek", "chatgpt", "new chat",
)
GENERIC_PREFIX = "untitled"
OPAQUE_ID = r"[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{8,}"
PROMPT_TITLE_CHARS = 48

# Image suffix to media type; the default is png.
IMAGE_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp",
    ".gif": "image/gif", ".bmp": "image/bmp", ".svg": "image/svg+xml",
}


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank; ends are kept."""
    return F.regexp_replace(c, SPACE + "+", " ")


def collapse(c: Column) -> Column:
    return F.trim(squeeze(c))


def blank_to_null(c: Column) -> Column:
    """NULL for the empty text. Unlike a comparison, this reads its argument once, also inside a lambda."""
    return F.get(F.array_remove(F.array(c), F.lit("")), 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once: inside a lambda nothing else shares repeated expressions."""
    return F.get(F.transform(F.array(value), body), 0)


def is_opaque_id(text: Column) -> Column:
    return js_trim(F.coalesce(text, F.lit(""))).rlike(rf"(?i)^(?:{OPAQUE_ID})?\z")


def _says_nothing(t: Column, source_id: Column | None) -> Column:
    names = "|".join(GENERIC_TITLES)
    generic = t.rlike(rf"(?i)^(?:{GENERIC_PREFIX}|(?:{names}|{OPAQUE_ID})?\z)")
    if source_id is None:
        return generic
    # An empty id equals an empty title only, and that is generic anyway.
    return generic | (F.lower(t) == F.lower(js_trim(F.coalesce(source_id, F.lit("")))))


def is_generic_title(title: Column, source_id: Column | None = None) -> Column:
    return let(collapse(F.coalesce(title, F.lit(""))), lambda t: _says_nothing(t, source_id))


def normalize_title(title: Column, source_id: Column | None = None) -> Column:
    """The title in one line, NULL for a generic one. A title made from a prompt is costly, so it is computed once."""
    return let(collapse(F.coalesce(title, F.lit(""))), lambda t: F.when(~_says_nothing(t, source_id), t))


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, IMAGE, " ")
    out = F.regexp_replace(out, r"(?i)\[(?:attachment|thinking)\]", " ")
    out = F.regexp_replace(out, rf"(?m)^>{SPACE}*", "")
    return collapse(F.regexp_replace(out, r"[`*_#>-]+", " "))


def prompt_title(markdown: Column, source_id: Column) -> Column:
    """Title made from a prompt. The flattened text has no line ends, so its head is the first line."""
    head = js_trim(F.substring(strip_markdown(markdown), 1, PROMPT_TITLE_CHARS))
    return normalize_title(head, source_id)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(collapse(text)) / F.lit(4)).cast("bigint")


def format_token_count(n: Column) -> Column:
    """`~999`, `~1.2K`. Exact halves (…250, …750) round up; all others follow the binary value."""
    n = n.cast("bigint")
    half = (n % 1000).isin(250, 750)
    up = F.format_string("%d.%d", F.floor(n / 1000).cast("bigint"), F.ceil((n % 1000) / 100).cast("bigint"))
    near = F.call_function("format_number", n / F.lit(1000.0), F.lit("0.0"))
    return F.when(n < 1000, F.concat(F.lit("~"), n.cast("string"))).otherwise(
        F.concat(F.lit("~"), F.when(half, up).otherwise(near), F.lit("K")))


def format_file_size(size: Column) -> Column:
    kb = size.cast("double") / 1024
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
            .when(size < 1024 * 1024, F.format_string("%.2fKB", kb))
            .otherwise(F.format_string("%.2fMB", kb / 1024)))


def path_segment(text: Column) -> Column:
    out = collapse(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    out = F.regexp_replace(out, r"[. ]+\z", "")
    edge = rf"[_.{SPACE_CHARS}-]+"
    return F.regexp_replace(out, rf"^{edge}|{edge}\z", "")


def storage_segment(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "_")


def short_id(text: Column, n: int = 8) -> Column:
    kept = F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", ""), 1, n)
    return F.coalesce(blank_to_null(kept), F.substring(text, 1, n))


def folder_name(title: Column, source_id: Column) -> Column:
    raw = F.coalesce(normalize_title(title, source_id), source_id)
    name = path_segment(F.substring(squeeze(raw), 1, 48))
    name = F.coalesce(blank_to_null(name), path_segment(source_id))
    return F.concat(name, F.lit("__"), short_id(source_id))


def artifact_base_name(title: Column, source_id: Column) -> Column:
    raw = F.coalesce(blank_to_null(js_trim(F.coalesce(title, F.lit("")))), source_id)
    name = path_segment(F.substring(squeeze(raw), 1, 80))
    return F.coalesce(blank_to_null(name), path_segment(source_id))


def archive_prefix(platform: Column, title: Column, source_id: Column, root: str = "export") -> Column:
    return F.concat_ws("/", F.lit(root), path_segment(platform), folder_name(title, source_id))


def archived_revision_prefix(platform: Column, title: Column, source_id: Column, revision: Column,
                             root: str = "export") -> Column:
    return F.concat_ws("/", F.lit(root), F.lit("Archive"), path_segment(platform),
                       folder_name(title, source_id), short_id(revision, 12))


def yaml_quote(value: Column, numeric: bool = False) -> Column:
    text = value.cast("string")
    if numeric:
        return F.coalesce(text, F.lit('""'))
    out = text
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), F.coalesce(out, F.lit("")), F.lit('"'))


def mime_from_filename(name: Column) -> Column:
    suffix = F.regexp_extract(F.lower(js_trim(F.coalesce(name, F.lit("")))), r"(\.[a-z]+)\z", 1)
    known = F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("image/png"))


def extension_from_mime(mime: Column) -> Column:
    low = F.lower(mime)
    sub = F.regexp_replace(F.regexp_extract(low, r"(?s)^[^/]*/(.*)\z", 1), "[^a-z0-9]+", "")
    return (F.when(low == "image/jpeg", "jpg").when(low == "image/svg+xml", "svg")
            .otherwise(F.coalesce(blank_to_null(sub), F.lit("bin"))))


def normalize_role(role: Column, dialect: str) -> Column:
    if dialect == "chatgpt":
        return F.when(role.isin("user", "assistant", "system"), role)
    low = F.lower(role)
    return F.when(low.isin("user", "assistant"), low)


def role_label(role: Column, participant_names: Column | None = None) -> Column:
    """``participant_names`` is a map from role to display name."""
    low = F.lower(role)
    fixed = F.when(low == "user", "User").when(low == "assistant", "Assistant").when(low == "system", "System")
    named = [blank_to_null(F.try_element_at(participant_names, low))] if participant_names is not None else []
    capital = F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 2147483647))
    return F.coalesce(fixed, *named, capital)


def meta_string(meta: Column, key: str) -> Column:
    """Trimmed string member of a JSON object column; NULL when absent, blank or not a string."""
    value = F.try_variant_get(F.try_parse_json(meta), "$." + key, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", blank_to_null(js_trim(value.cast("string"))))


def meta_strings(meta: Column, key: str) -> Column:
    """Non-blank string members of a JSON array held under ``key``; empty when absent."""
    items = F.try_variant_get(F.try_parse_json(meta), "$." + key, "array<variant>")
    texts = F.transform(
        F.coalesce(items, F.array().cast("array<variant>")),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))
    return F.filter(texts, lambda s: s.isNotNull() & (js_trim(s) != ""))
