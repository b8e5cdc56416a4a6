"""Secrets in texts: three fixed patterns, and strings a text vocabulary cannot compress.

A byte-pair vocabulary learnt from text spends about one token on three or four characters of words, and one on less
than two of random strings. A long unbroken string with few characters a token is therefore reported as ``random``,
after digests of known lengths and identifiers (words, numbers, UUIDs, paths and names made of words) are set aside. A
part counts as a word only if it has many characters a token itself. Where a string passes as a whole, each stretch of
its parts that are neither words nor numbers is weighed by itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.byte_bpe import tokenizer
from parley.llm.frames import ids_and_texts, map_batches

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
# The base patterns. Letters of the names count in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
#: A string of this many characters at least is weighed, and reported below this many characters a token.
RANDOM_LENGTH, CHARS_A_TOKEN = 20, 2.0
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % RANDOM_LENGTH)
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = re.compile(r"[^+/_=-]+")
_CAPITALS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2,}(?![A-Za-z0-9])")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|([A-Z][a-z]{2,})+|[A-Za-z][a-z]+([A-Z][a-z]+)+|[a-z]+[0-9]{1,4}|v?[0-9]{1,4}")


def is_random(text: str, vocabulary: str) -> bool:
    # The vocabulary knows few words in capitals: parts of capitals alone are weighed in small letters.
    text = _CAPITALS.sub(lambda m: m[0].lower(), text)
    return len(text) < CHARS_A_TOKEN * len(tokenizer(vocabulary).encode(text))


def is_known(part: str, vocabulary: str) -> bool:
    """Words and numbers. Letters alone may have any form of a word, so they are weighed, but for a single one."""
    return bool(_WORD.fullmatch(part)) and (len(part) == 1 or not part.isalpha() or not is_random(part, vocabulary))


#: Strings of up to this many characters are remembered with their spans, which bounds the memory of that.
REMEMBERED = 256


def random_spans(text: str, vocabulary: str) -> tuple[tuple[int, int], ...]:
    """(start, end) of what is random in a long string: all of it, or stretches of parts that are not known."""
    return _remembered(text, vocabulary) if len(text) <= REMEMBERED else _random_spans(text, vocabulary)


@lru_cache(maxsize=1 << 15)
def _remembered(text: str, vocabulary: str) -> tuple[tuple[int, int], ...]:
    return _random_spans(text, vocabulary)


def _random_spans(text: str, vocabulary: str) -> tuple[tuple[int, int], ...]:
    if len(text) < RANDOM_LENGTH or _HEX_ONLY.fullmatch(text) and len(text) in DIGEST_LENGTHS or _UUID.fullmatch(text):
        return ()
    stretches: list[tuple[int, int]] = []
    joined = False
    for m in _PART.finditer(text):
        if is_known(m[0], vocabulary):
            joined = False
            continue
        start = stretches.pop()[0] if joined else m.start()
        stretches.append((start, m.end()))
        joined = True
    if not stretches:
        return ()
    if is_random(text, vocabulary):
        return ((0, len(text)),)
    found = [(a, b) for a, b in stretches if b - a < len(text) and random_spans(text[a:b], vocabulary) == ((0, b - a),)]
    # What is left between them is a string of its own, as it is after redaction.
    rest = zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(text)]) if found else ()
    return tuple(sorted([*found, *((a + s, a + e) for a, b in rest for s, e in random_spans(text[a:b], vocabulary))]))


def spans_of(text: str, vocabulary: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind; base kinds are leftmost and do not overlap themselves."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    # Both lists are walked once: ``reach`` is the farthest end of the base spans that begin before a string ends.
    base, at, reach = sorted(span[1:] for span in found), 0, -1
    for m in _LONG.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= start:
            found += [("random", start + s, start + e) for s, e in random_spans(m[0], vocabulary)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, text>>) for every row; a null or empty text has no spans.

    Whole texts are read. Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty
    one. No shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column("text"):
            text = value.as_py()
            rows.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for k, s, e in spans_of(text, vocabulary)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=kind)], ["doc_id", "spans"])

    return map_batches(ids_and_texts(docs), run,
                       "doc_id long, spans array<struct<kind string, start long, end long, text string>>")


def redacted(text: Column, vocabulary: str, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (overlapping ones as one) replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else cut(t))

    def cut(text: str) -> str:
        out, at = [], 0
        for _, start, end in spans_of(text, vocabulary):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    return clean(text.cast("string"))


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")
