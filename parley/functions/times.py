"""Timestamps travel as ISO-8601 UTC text with milliseconds, as they do in every bundle file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import blank_to_null, collapse, js_trim

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Label patterns, in the order they are tried.
RELATIVE_LABEL = {
    "deepseek": r"(?i)\b((?:today|yesterday|just now|last week|last month|a few seconds ago|a minute ago"
                r"|an hour ago)|\d+\s+(?:minute|hour|day|week|month|year)s?\s+ago)\b",
    "google": r"(?i)\b((?:today|yesterday|just now|last week|last month)"
              r"|\d+\s+(?:minute|hour|day|week|month|year)s?\s+ago)\b",
}
ABSOLUTE_LABEL = (r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
                  r"\s+\d{1,2}(?:,\s+\d{4})?)\b")
CHINESE_LABEL = (r"(\d+\s*(?:分钟|小时|天|周|月|年)前|刚刚|今天|昨天|前天"
                 r"|\d{4}[年-]\d{1,2}[月-]\d{1,2}日?)")
# Seconds in the units a relative label can name.
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}

DIALECTS = ("chatgpt_payload", "chatgpt_list", "deepseek_message", "deepseek_list")


def to_ts(text: Column) -> Column:
    """Lenient parse of a date text; NULL when it is not one."""
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit("MMM d, yyyy")),
                      F.try_to_timestamp(text, F.lit("MMMM d, yyyy")))


def epoch_ms(text: Column) -> Column:
    return F.unix_millis(to_ts(text))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def iso_from_ms(ms: Column) -> Column:
    return iso(F.timestamp_millis(ms.cast("bigint")))


def iso_from_pair(seconds: Column, nanos: Column | None = None) -> Column:
    """[seconds, nanos] pair to text; the nanos are floored to whole milliseconds."""
    whole = seconds.try_cast("decimal(30,9)") * 1000
    part = F.lit(0)
    if nanos is not None:
        part = F.coalesce(F.floor(nanos.try_cast("decimal(30,9)") / 1000000), F.lit(0))
    return iso_from_ms(F.floor(whole + part))


def normalize_timestamp(value: Column, dialect: str, is_number: Column | bool) -> Column:
    """``value`` as text plus whether the payload held it as a number; result is ISO text or NULL."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown timestamp dialect {dialect!r}")
    number = F.lit(is_number) if isinstance(is_number, bool) else is_number
    amount = value.try_cast("decimal(38,9)")
    as_seconds = F.floor(amount * 1000)
    either = F.when(amount > 1000000000000, F.floor(amount)).otherwise(as_seconds)
    numeric_text = value.rlike(r"^\d+(\.\d+)?\z")
    parsed = F.when(~numeric_text, iso(to_ts(value)))
    from_number = iso_from_ms(as_seconds if dialect == "deepseek_list" else either)
    from_text = {
        "chatgpt_payload": F.when(numeric_text, iso_from_ms(as_seconds)).otherwise(parsed),
        "chatgpt_list": parsed,
        "deepseek_message": F.when(numeric_text, iso_from_ms(either)).otherwise(value),
        "deepseek_list": F.when(numeric_text, iso_from_ms(as_seconds)).otherwise(parsed),
    }[dialect]
    return F.when(value.isNotNull() & (value != ""), F.when(number, from_number).otherwise(from_text))


def extract_time_label(text: Column, dialect: str = "deepseek") -> Column:
    flat = collapse(text)
    patterns = [RELATIVE_LABEL[dialect], ABSOLUTE_LABEL]
    if dialect == "deepseek":
        patterns.append(CHINESE_LABEL)
    return F.coalesce(*[blank_to_null(js_trim(F.regexp_extract(flat, p, 1))) for p in patterns])


def relative_label_to_ms(label: Column, now: Column) -> Column:
    """Epoch milliseconds a label such as `6 hours ago` stands for, seen from ``now`` (ISO text)."""
    flat = F.lower(js_trim(label))
    now_ms = epoch_ms(now)
    shape = r"^(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago\z"
    units = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    amount = F.regexp_extract(flat, shape, 1).try_cast("bigint")
    unit = F.try_element_at(units, F.regexp_extract(flat, shape, 2))
    return (F.when(flat == "today", now_ms).when(flat == "yesterday", now_ms - 86400000)
            .otherwise(now_ms - amount * unit * 1000))


def relative_label_to_ts(label: Column, now: Column) -> Column:
    return iso_from_ms(relative_label_to_ms(label, now))


def format_message_timestamp(text: Column, zone: str = "UTC") -> Column:
    """`yyyy-MM-dd HH:mm:ss (UTC±hh:mm)` in ``zone``; text that is not a date passes through."""
    ts = to_ts(text)
    local = F.from_utc_timestamp(ts, zone)
    offset = F.round((F.unix_millis(local) - F.unix_millis(ts)) / 60000).cast("int")
    sign = F.when(offset < 0, "-").otherwise("+")
    shown = F.concat(
        F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" (UTC"), sign,
        F.format_string("%02d:%02d", F.floor(F.abs(offset) / 60).cast("int"), (F.abs(offset) % 60).cast("int")),
        F.lit(")"))
    return F.coalesce(shown, text)


def plus_ms(text: Column, ms: Column | int) -> Column:
    return iso_from_ms(epoch_ms(text) + ms)
