"""Addresses: canonical form, identity, platform, attachments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import blank_to_null, js_trim, let

PLATFORMS = ("chatgpt", "gemini", "aistudio", "deepseek")
MARKER_PARAMS = ("archive_worker", "archive_discovery")

# Where each platform keeps the conversation id, and the ids that name no conversation.
SOURCE_ID_PATTERNS = {
    "chatgpt": r"/c/([^/?#]+)",
    "deepseek": r"(?i)^https?://chat\.deepseek\.com/a/chat/(?:s/)?([a-zA-Z0-9-]+)",
    "gemini": r"(?i)/app/([^/?#]+)",
    "aistudio": r"(?i)/prompts/([^/?#]+)",
}
# Addresses that belong to each platform.
PLATFORM_PATTERNS = {
    "chatgpt": r"(?i)^https://chatgpt\.com/c/",
    "deepseek": r"(?i)^https://chat\.deepseek\.com/a/chat/",
    "gemini": r"(?i)^https://gemini\.google\.com/app/",
    "aistudio": r"(?i)^https://aistudio\.google\.com/prompts/(?!new_chat)",
}
# Suffixes that mark a linked image or document.
IMAGE_URL = r"(?i)\.(?:png|jpe?g|webp|gif|bmp|svg)(?:\?|#|\z)"
DOCUMENT_URL = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|tsv|md)(?:\?|#|\z)"


def percent_encode(part: Column) -> Column:
    """Characters an address may not hold (blanks, quotes, braces, non-ASCII) as percent escapes."""
    chars = F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0))
    bad = r'[^\x21-\x7e]|["<>`{}]'
    return F.when(part.rlike(bad), F.array_join(F.transform(chars, lambda ch: F.when(ch == " ", "%20").when(
        ch.rlike(bad), F.url_encode(ch)).otherwise(ch)), "")).otherwise(part)


def canonical_url(url: Column, drop: Sequence[str] = MARKER_PARAMS) -> Column:
    """The address without the marker parameters, its query written in form encoding."""
    origin = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    # A port that is the scheme's own is not written.
    origin = F.regexp_replace(origin, r"^(http://.*):80\z|^(https://.*):443\z", "$1$2")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(percent_encode(path))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = percent_encode(F.regexp_extract(url, r"(?s)(#.+)\z", 1))

    def recode(part: Column) -> Column:
        return F.url_encode(F.coalesce(F.try_url_decode(part), part))

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(
        recode(F.substring_index(p, "=", 1)).alias("name"),
        recode(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("value")))
    pairs = F.filter(pairs, lambda p: ~p["name"].isin(*drop)) if drop else pairs
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    return F.when(origin == "", url).otherwise(
        F.concat(origin, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment))


def resolve_url(href: Column, origin: Column | str) -> Column:
    """Absolute form of a link found on a page of ``origin`` (scheme and host)."""
    base = F.lit(origin) if isinstance(origin, str) else origin
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(base, href))
            .otherwise(F.concat(base, F.lit("/"), href)))


def source_id_from_url(url: Column, platform: str) -> Column:
    found = blank_to_null(F.regexp_extract(url, SOURCE_ID_PATTERNS[platform], 1))
    if platform == "gemini":
        return F.when(F.lower(found) != "mystuff", found)
    if platform == "aistudio":
        return F.when(found != "new_chat", found)
    return found


def platform_from_url(url: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in PLATFORM_PATTERNS.items():
        found = F.when(url.rlike(pattern), name).otherwise(found)
    return found


def is_private_host(host: Column) -> Column:
    # Loopback names, private and link-local ranges.
    low = F.lower(host)
    return (host.isin("localhost", "127.0.0.1", "::1", "0.0.0.0")
            | host.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.)")
            | (host.contains(":") & low.rlike(r"^(?:fc|fd|fe80:)")))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)


def classify_urls(text: Column) -> Column:
    """struct<images, documents>: linked files by suffix, distinct, in first-seen order."""
    def sorted_out(found: Column) -> Column:
        images = F.filter(found, lambda u: u.rlike(IMAGE_URL))
        documents = F.filter(found, lambda u: ~u.rlike(IMAGE_URL) & u.rlike(DOCUMENT_URL))
        return F.struct(F.array_distinct(images).alias("images"), F.array_distinct(documents).alias("documents"))

    return let(F.regexp_extract_all(text, F.lit(r"https?://[^\s\x{a0})]+"), F.lit(0)), sorted_out)


def url_file_title(url: Column, default: str) -> Column:
    last = F.element_at(F.split(url, "/"), -1)
    return F.coalesce(blank_to_null(F.substring_index(last, "?", 1)), F.lit(default))


def append_url_attachments(markdown: Column) -> Column:
    """Image and document blocks for the linked files found in the text, after the text."""
    def blocks(found: Column) -> Column:
        images = F.transform(found["images"], lambda u: F.concat(
            F.lit("!["), url_file_title(u, "image"), F.lit("]("), u, F.lit(")")))
        documents = F.transform(found["documents"], lambda u: F.concat(
            F.lit("> [attachment] ["), url_file_title(u, "attachment"), F.lit("]("), u, F.lit(")")))
        return F.concat(images, documents)

    def appended(text: Column) -> Column:
        joined = let(classify_urls(text), lambda found: F.array_join(blocks(found), "\n\n"))
        return let(joined, lambda more: F.when(more == "", text).otherwise(js_trim(F.concat(text, F.lit("\n\n"), more))))

    return let(markdown, appended)
