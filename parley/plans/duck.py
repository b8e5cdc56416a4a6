"""Building blocks of the oracle texts (DuckDB). Braces are doubled because `{name}` means a view."""

from __future__ import annotations

WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {to}, 'g')"


def collapse(x: str) -> str:
    return f"trim({gsub(x, WS + '+', repr(' '))})"


def jtrim(x: str) -> str:
    return gsub(x, rf"^{WS}+|{WS}+\z", "''")


def generic(x: str, sid: str) -> str:
    t = collapse(f"coalesce({x}, '')")
    names = "google gemini|gemini|google ai studio|ai studio|deepseek|chatgpt|new chat"
    return (f"(regexp_matches({t}, {rx(rf'(?i)^((?:{names})?|[0-9a-f]{{8,}}|[0-9a-f]{{8}}-[0-9a-f-]{{8,}})$|(?i)^untitled')})"
            f" OR lower({t}) = lower({jtrim(sid)}))")


def norm_title(x: str, sid: str) -> str:
    t = collapse(f"coalesce({x}, '')")
    return f"CASE WHEN NOT {generic(x, sid)} THEN {t} END"


def strip_md(x: str) -> str:
    out = gsub(x, r"!\[[^\]]*\]\([^)]+\)", "' '")
    out = gsub(out, r"(?i)\[(attachment|thinking)\]", "' '")
    out = gsub(out, rf"(?m)^>{WS}*", "''")
    return collapse(gsub(out, r"[`*_#>-]+", "' '"))


def prompt_title(md: str, sid: str) -> str:
    return norm_title(f"trim(left({strip_md(md)}, 48))", sid)


def iso_ms(x: str) -> str:
    return f"strftime(make_timestamp(CAST(({x}) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ')"


def segment(x: str) -> str:
    out = collapse(gsub(x, r'[<>:"/\\|?*\x00-\x1f]', "'_'"))
    out = gsub(out, r"[. ]+$", "''")
    return gsub(out, r"^[_\s.-]+|[_\s.-]+$", "''")


def short(x: str, n: int) -> str:
    return f"coalesce(nullif(left({gsub(x, '[^a-zA-Z0-9]', repr(''))}, {n}), ''), left({x}, {n}))"


def folder(title: str, sid: str) -> str:
    raw = f"coalesce({norm_title(title, sid)}, {sid})"
    return (f"coalesce(nullif({segment(f'left({gsub(raw, WS + chr(43), repr(chr(32)))}, 48)')}, ''), {segment(sid)})"
            f" || '__' || {short(sid, 8)}")


def yaml(x: str) -> str:
    return (f"'\"' || replace(replace(replace(replace(coalesce({x}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(13), '\\r'),"
            f" chr(10), '\\n') || '\"'")


def tokens(x: str) -> str:
    return f"CAST(ceil(length({collapse(x)}) / 4.0) AS BIGINT)"


def token_label(n: str) -> str:
    return (f"'~' || CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} % 1000 IN (250, 750) "
            f"THEN ({n} // 1000) || '.' || (({n} % 1000 + 50) // 100) || 'K' ELSE printf('%.1fK', {n} / 1000.0::DOUBLE) END")


FINGERPRINT = "sha256('2026-04-15.2::' || platform || '::' || source_id || '::' || coalesce(source_updated_at, ''))"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
