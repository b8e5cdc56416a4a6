"""Searching undeclared, positional JSON at any depth, in native expressions over variants.

`descend` walks a document level by level: the arrays of one level are a column, the next level is made of their members,
and a node carries the path of positions that leads to it, so that what is found can be put in reading order at the end.
One `aggregate` runs over the levels, as many as the document has brackets at most; a level without nodes costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import js_trim, let

# What tells uploaded images and linked documents apart inside a turn.
IMAGE_HOST = r"^https://lh3\.googleusercontent\.com/gg/"
IMAGE_NAME = r"(?i)\.(?:png|jpe?g|webp|gif|bmp)\z"
IMAGE_TYPE = r"(?i)^image/"
DOCUMENT_NAME = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|tsv|md)\z"
DOCUMENT_TYPE = r"(?i)^(?:application|text)/"
ANY_URL = r"(?i)^https?://"
SECONDS_RANGE = (1_000_000_000, 20_000_000_000)

NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\z"
NODE = "array<struct<path:array<int>,v:variant,kids:array<variant>,list:boolean,hit:boolean>>"
Test = Callable[[Column], Column]


def members(v: Column) -> Column:
    """The members of an array, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def texts_of(kids: Column) -> Column:
    """The strings among the members, in order."""
    return F.transform(F.filter(kids, is_text), lambda x: x.cast("string"))


def _node(v: Column, path: Column, test: Test, through_objects: bool) -> Column:
    """The node of an array, or of an object if those are entered; NULL for a scalar."""
    def made(kids: Column, listed: Column) -> Column:
        return F.struct(path.alias("path"), v.alias("v"), kids.alias("kids"), listed.alias("list"),
                        (listed & F.coalesce(test(kids), F.lit(False))).alias("hit"))

    found = let(members(v), lambda kids: F.when(kids.isNotNull(), made(kids, F.lit(True))))
    if not through_objects:
        return found
    held = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(found, let(held, lambda kids: F.when(kids.isNotNull(), made(kids, F.lit(False)))))


def descend(v: Column, test: Test, stop: bool = False, through_objects: bool = False) -> Column:
    """The arrays of a variant, itself included, whose members pass ``test``, in reading order: array<struct<path, v, kids,
    …>>. With ``stop`` nothing is looked for below one that passed. Members of an object come by their names' order."""
    def nodes(found: Column) -> Column:
        return F.filter(found, lambda n: n.isNotNull()).cast(NODE)

    def below(front: Column) -> Column:
        open_ = F.filter(front, lambda n: ~n["hit"]) if stop else front
        return F.flatten(F.transform(open_, lambda n: nodes(F.transform(n["kids"], lambda x, i: _node(
            x, F.concat(n["path"], F.array(i)), test, through_objects)))))

    def level(state: Column, _: Column) -> Column:
        further = F.struct(F.concat(state["found"], F.filter(state["front"], lambda n: n["hit"])).alias("found"),
                           below(state["front"]).alias("front"))
        return F.when(F.size(state["front"]) == 0, state).otherwise(further)

    first = F.struct(F.array().cast(NODE).alias("found"),
                     nodes(F.array(_node(v, F.array().cast("array<int>"), test, through_objects))).alias("front"))
    levels = F.regexp_count(F.to_json(v), F.lit(r"[\[{]"))
    found = F.aggregate(F.sequence(F.lit(0), levels), first, level)["found"]
    return F.array_sort(F.coalesce(found, F.array().cast(NODE)), lambda a, b: F.when(a["path"] < b["path"], -1).when(
        a["path"] > b["path"], 1).otherwise(0))


def _first(texts: Column, *patterns: str) -> Column:
    hits = F.filter(texts, lambda x: x.rlike("|".join(f"(?:{p})" for p in patterns)))
    return F.get(hits, 0)


def collect_nested(v: Column, kind: str) -> Column:
    """The attachments of ``kind`` (image / document) in a variant: array<struct<url, name, mime>>.

    The search stops below a match; of equal (name, url) the last wins, at the first's place.
    """
    if kind not in ("image", "document"):
        raise ValueError(f"unknown kind {kind!r}")

    def wanted(kids: Column) -> Column:
        texts = texts_of(kids)
        if kind == "image":
            return _first(texts, IMAGE_HOST).isNotNull()
        return let(texts, lambda t: _first(t, ANY_URL).isNotNull() & _first(t, DOCUMENT_NAME, DOCUMENT_TYPE).isNotNull())

    url, name, mime = (IMAGE_HOST, IMAGE_NAME, IMAGE_TYPE) if kind == "image" else (ANY_URL, DOCUMENT_NAME, DOCUMENT_TYPE)

    def shown(node: Column) -> Column:
        return let(texts_of(node["kids"]), lambda t: F.struct(
            _first(t, url).alias("url"), _first(t, name).alias("name"), _first(t, mime).alias("mime")))

    def key(a: Column) -> Column:
        return F.struct(F.coalesce(a["name"], F.lit("")), a["url"])

    def merged(hits: Column) -> Column:
        keys = F.array_distinct(F.transform(hits, key))
        return F.transform(keys, lambda k: F.element_at(F.filter(hits, lambda h: key(h) == k), -1))

    found = let(F.transform(descend(v, wanted, stop=True), shown), merged)
    return found if kind == "image" else F.filter(found, lambda a: ~a["url"].rlike(IMAGE_HOST))


def find_role_turns(v: Column) -> Column:
    """The arrays of a variant, at any depth, whose ninth member is a role, as variants."""
    def has_role(kids: Column) -> Column:
        return let(F.get(kids, 8), lambda r: is_text(r) & r.cast("string").isin("user", "model"))
    return F.transform(descend(v, has_role, through_objects=True), lambda n: n["v"])


def _number(v: Column) -> Column:
    """A number or a text that is one, as double; NULL for anything else."""
    kind = F.schema_of_variant(v)
    text = F.when(kind.rlike("^(?:STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), v.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def turn_timestamp_ms(v: Column) -> Column:
    """Latest [seconds, nanos] pair inside a turn, in epoch milliseconds."""
    def seconds(kids: Column) -> Column:
        return _number(F.get(kids, 0))

    def in_range(kids: Column) -> Column:
        return (F.size(kids) >= 2) & let(seconds(kids), lambda s: (s > SECONDS_RANGE[0]) & (s < SECONDS_RANGE[1]))

    def stamp(node: Column) -> Column:
        return let(_number(F.get(node["kids"], 1)), lambda n: (
            F.floor(seconds(node["kids"]) * 1000)
            + F.coalesce(F.when(F.abs(n) < 1e18, F.floor(n / 1e6)), F.lit(0))).cast("bigint"))

    return F.array_max(F.transform(descend(v, in_range), stamp))


def _text_arrays(v: Column) -> Column:
    """The arrays of strings in a variant, as arrays of texts."""
    found = descend(v, lambda kids: (F.size(kids) > 0) & F.forall(kids, is_text), stop=True)
    return F.transform(found, lambda n: texts_of(n["kids"]))


def turn_files(v: Column) -> Column:
    """Drive ids and inline files of a turn: struct<drive_ids, inline: array<struct<mime, payload>>>."""
    def slot(i: int) -> Column:
        return _text_arrays(F.try_variant_get(v, f"$[{i}]", "variant"))

    ids = F.filter(F.flatten(F.concat(slot(1), slot(3))), lambda x: js_trim(x) != "")
    arrays = F.filter(F.concat(slot(12), slot(23), _text_arrays(v)),
                      lambda a: (F.size(a) > 1) & F.get(a, 0).rlike(r"(?i)^(?:image|text)/"))
    inline = F.array_distinct(F.transform(arrays, lambda a: F.struct(F.get(a, 0).alias("mime"), F.get(a, 1).alias("payload"))))
    return F.struct(F.array_distinct(ids).alias("drive_ids"), inline.alias("inline"))
