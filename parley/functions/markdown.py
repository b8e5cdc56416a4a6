"""Rewriting message bodies. Each rule is a linear regular expression or a fold over split pieces.

Possessive quantifiers keep the block rules iterative in the JVM's matcher, so a block of a
million lines costs no stack. Non-characters mark pieces between two passes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import IMAGE, INLINE_SPACE, SPACE, SPACE_CHARS, blank_to_null, js_trim, let

OPEN, CLOSE, SPLIT = "\ufdd0", "\ufdd1", "\ufdd2"
CJK = r"\x{3400}-\x{9fff}"

PRESETS = {
    "complete": {"thinking": True, "images": True, "attachments": True},
    "standard": {"thinking": False, "images": True, "attachments": True},
    "share": {"thinking": False, "images": False, "attachments": False},
}
FORMATS = ("full", "user-only", "assistant-only", "code-only", "compact")

THINKING_BLOCK = (
    rf"(?i:^{INLINE_SPACE}*+>{INLINE_SPACE}*+\[thinking\]{INLINE_SPACE}*+$)"
    rf"(?:\n(?:>[^\n]*+|{INLINE_SPACE}*+(?=\n|\z)))*+"
)
FENCE = r"```.*?```"


def wrap_bare_urls(md: Column) -> Column:
    """`<url>` where a letter, digit or CJK neighbour would glue to the address.

    First every address is marked whole, so a rule can never start inside one.
    """
    def wrapped(text: Column) -> Column:
        marked = F.regexp_replace(text, rf"https?://[^<>(){CJK}{SPACE_CHARS}]++", OPEN + "$0" + CLOSE)
        body = f"([^{CLOSE}]*+){CLOSE}"
        out = F.regexp_replace(marked, rf"{OPEN}(?<=[A-Za-z0-9{CJK}]{OPEN}){body}(?!>)", "<$1>")
        out = F.regexp_replace(out, rf"{OPEN}(?<!\]\({OPEN})(?<!<{OPEN}){body}(?=[{CJK}])", "<$1>")
        return F.when(text.contains("://"), F.replace(F.replace(out, F.lit(OPEN)), F.lit(CLOSE))).otherwise(text)

    return let(md, wrapped)


def _lines(md: Column) -> Column:
    return F.replace(md, F.lit("\r\n"), F.lit("\n"))


def _has_thinking(md: Column) -> Column:
    """A cheap look before the block rules."""
    return F.lower(md).contains("[thinking]")


def _details(block: Column) -> Column:
    body = F.regexp_replace(block, rf"(?m)^>{INLINE_SPACE}?", "")
    body = js_trim(F.regexp_replace(F.regexp_replace(body, rf"(?m)^{INLINE_SPACE}++$", ""), r"\n{3,}", "\n\n"))
    shown = F.when(body == "", "").otherwise(F.concat(body, F.lit("\n\n")))
    return F.concat(F.lit("<details>\n<summary>Thinking</summary>\n\n"), shown, F.lit("</details>"))


def thinking_to_details(md: Column) -> Column:
    marker = rf"(?i)^{SPACE}*>{SPACE}*\[thinking\]{SPACE}*"

    def folded(text: Column) -> Column:
        pieces = F.split(F.regexp_replace(text, "(?m)" + THINKING_BLOCK, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]")
        out = F.array_join(F.transform(pieces, lambda piece, i: F.when(
            i % 2 == 1, _details(F.regexp_replace(piece, marker, ""))).otherwise(piece)), "")
        return F.when(_has_thinking(text), out).otherwise(text)

    return let(_lines(md), folded)


def strip_thinking(md: Column) -> Column:
    block = rf"(?m)\n{THINKING_BLOCK}\z|{THINKING_BLOCK}(?:\n|\z)"
    return let(_lines(md), lambda text: F.when(_has_thinking(text), F.regexp_replace(text, block, "")).otherwise(text))


def strip_attachments(md: Column) -> Column:
    return F.regexp_replace(md, rf"(?im)^>{SPACE}*\[attachment\][^\n\r\x{{2028}}\x{{2029}}]*", "")


def strip_images(md: Column) -> Column:
    return F.regexp_replace(md, IMAGE, "")


def apply_preset(md: Column, preset: str = "complete", **overrides: bool) -> Column:
    """``overrides``: thinking / images / attachments flags that win over the preset."""
    flags = {**PRESETS[preset], **{k: v for k, v in overrides.items() if v is not None}}
    if not flags["thinking"]:
        md = strip_thinking(md)
    if not flags["attachments"]:
        md = strip_attachments(md)
    return md if flags["images"] else strip_images(md)


def normalize_spacing(md: Column) -> Column:
    def spaced(text: Column) -> Column:
        apart = F.regexp_replace(text, r"(</details>)\n(?!\n)", "$1\n\n")
        apart = F.regexp_replace(apart, r"\n(?<!\n\n)(<details>)", "\n\n$1")
        return F.when(text.contains("details>"), apart).otherwise(text)

    return js_trim(let(F.regexp_replace(md, r"\n{4,}", "\n\n\n"), spaced))


def code_blocks(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit("(?s)" + FENCE), F.lit(0))


def compact_code(md: Column) -> Column:
    """Fences lose blank and comment lines; a fence left empty disappears; the rest is squeezed."""
    marked = F.regexp_replace(md, r"(?s)(```[A-Za-z0-9_-]*\n)(.*?)```", f"{OPEN}$1{SPLIT}$2{CLOSE}")

    def squeeze_fence(piece: Column) -> Column:
        code = F.filter(F.split(F.substring_index(piece, SPLIT, -1), "\n"),
                        lambda x: ~js_trim(x).rlike(r"^(?:\z|//|#|/?\*)"))
        kept = F.array_join(code, "\n")
        return F.when(kept == "", "").otherwise(
            F.concat(F.substring_index(piece, SPLIT, 1), kept, F.lit("\n```")))

    pieces = F.transform(F.split(marked, f"[{OPEN}{CLOSE}]"),
                         lambda piece, i: F.when(i % 2 == 1, squeeze_fence(piece)).otherwise(piece))
    out = F.regexp_replace(F.array_join(pieces, ""), r"[ \t]+\n", "\n")
    return js_trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def message_body(role: Column, md: Column, fmt: str = "full", preset: str = "complete", **overrides: bool) -> Column:
    """The rendered body of one message, NULL when the format leaves nothing of it."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    body = wrap_bare_urls(apply_preset(js_trim(md), preset, **overrides))
    if fmt == "code-only":
        return blank_to_null(F.array_join(code_blocks(body), "\n\n"))
    shown = compact_code(body) if fmt == "compact" else body
    shown = blank_to_null(normalize_spacing(thinking_to_details(shown)))
    wanted = {"user-only": "user", "assistant-only": "assistant"}.get(fmt)
    return F.when(role == wanted, shown) if wanted else shown


def format_thinking(text: Column, dialect: str = "deepseek") -> Column:
    """Quoted thinking block; `aistudio` quotes blank lines with a bare `>`."""
    if dialect == "aistudio":
        quoted = F.transform(F.split(text, "\n"),
                             lambda x: F.when(js_trim(x) == "", ">").otherwise(F.concat(F.lit("> "), x)))
        return F.concat(F.lit("> [thinking]\n"), F.array_join(quoted, "\n"))
    return F.concat(F.lit("> [thinking]\n> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def safe_fence(content: Column, language: Column | str = "") -> Column:
    lang = F.lit(language) if isinstance(language, str) else language
    runs = F.transform(F.regexp_extract_all(content, F.lit("~+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("~"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    lang = F.when(js_trim(lang) != "", lang).otherwise("")
    return F.concat(fence, lang, F.lit("\n"), content, F.lit("\n"), fence)


def _split_after_bold(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\*\*[^*\n]+\*\*)[ \t]+(?!{SPACE}|\z)", "$1\n\n")


def normalize_prompt_text(text: Column, dom: bool = False) -> Column:
    """Line ends, edge blanks, paragraphs after bold. ``dom`` also drops words of the page's controls."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+$", ""), r"(?m)^[ \t]+", "")
    if dom:
        # Words of the page's controls that a capture leaves on their own lines.
        for words in (
            r"(?i:edit|more_vert|thumb_up|thumb_down|chevron_right|chevron_left|chevron_more)",
            r"Model \d{1,2}:\d{2}",
            r"(?i:Thoughts?)",
            r"(?i:Expand to view model thoughts)",
            r"(?i:Response ready\.?)",
        ):
            out = F.regexp_replace(out, rf"(?:^|\n){SPACE}*{words}{SPACE}*(?=\n|\z)", "\n")
    out = _split_after_bold(out)
    if dom:
        out = F.regexp_replace(out, rf"(^|\n)(\*\*[^*\n]+\*\*){SPACE}+\2(?=\n|\z)", "$1$2")
        out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return js_trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def replace_interactive_blocks(md: Column, url: Column) -> Column:
    """A fence that holds `"id": "im_…"` becomes a link to the conversation."""
    link = F.concat(F.lit("> [interactive] [Open Gemini visualization demo ($1)]("),
                    F.replace(F.replace(url, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit(")"))
    pattern = rf'(?is)```(?:json)?{SPACE}*.*?"id"{SPACE}*:{SPACE}*"(im_[a-z0-9]+)".*?```'
    return F.regexp_replace(md, F.lit(pattern), link)


def decode_inline_text(mime: Column, payload: Column) -> Column:
    """Attachment marker plus the decoded text in a safe fence; only the marker when it does not decode."""
    raw = F.try_to_binary(payload, F.lit("base64"))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    text = blank_to_null(normalize_prompt_text(text))
    marker = F.concat(F.lit("> [attachment] "), mime)
    return F.coalesce(F.concat(marker, F.lit("\n\n"), safe_fence(text, "text")), marker)
