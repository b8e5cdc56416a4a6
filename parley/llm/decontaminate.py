"""Benchmark passages in documents, by a prefix-filtered set join of word shingles.

A benchmark item's windows are its runs of `WINDOW` words; an item of fewer words is one window. A window is a set of word
shingles, each with its place, and lies in a document if and only if all of them do, at the same distance. So one of
them is enough to find it: with a containment of one, the necessary prefix of a set is its first shingle in the order of
rarity. The order is by the count of each shingle in all documents (a window with a shingle that no document holds is out
at once).

Every document then offers its shingles that are in the prefix of some window, each with its position and the words
around it. They are joined with the prefixes; the window's length must fit the document (length bound), and a shingle at
place j of its window puts the window's begin j words before the hit, where it has to lie within the document (positional
bound). What is left is verified word by word over the window's own size.

The filters that tasks hold are bit maps of fixed size, whatever the benchmark's; a full one costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import words
from parley.llm.frames import bounded_batches
from parley.session import cut_lineage, release

WINDOW = 10
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 4
FILTER_BITS = 1 << 24
#: One prefix that very many documents hold is dealt over this many groups.
SALTS = 8
_ROWS = 1 << 13
_STEP = 1 << 19

_GAPS = np.zeros(256, dtype=bool)
_GAPS[:0x80] = True
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_PLACES = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _document_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the words of text i are hashes[edges[i]:edges[i + 1]]."""
    doc, _, _, _, word = words.located_words(*words.text_bytes(batch.column("text")), _GAPS)
    return words.bounds(doc, batch.num_rows), word


def _grams(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    n = max(len(word) - size + 1, 0)
    value = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        value += word[j:j + n] * _PLACES[j]
    return words.mixed(value)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                    pa.array(flat.view(np.int64)))


def _texts(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, words): the distinct windows of every item, as lists of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, word = _document_words(batch)
            for i in range(batch.num_rows):
                own = word[edges[i]:edges[i + 1]]
                m = min(size, len(own))
                for lo in range(0, len(own) - m + 1 if m else 0, _ROWS):
                    n = min(_ROWS, len(own) - m + 1 - lo)
                    runs = own[np.arange(lo, lo + n)[:, None] + np.arange(m)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[i].as_py()] * n, type=pa.string()),
                                                      _lists(runs.ravel(), np.full(n, m))], ["item", "words"])

    rows = _texts(items, id_col, text_col).where("id is not null").withColumn("id", F.col("id").cast("string"))
    bounded_batches(items.sparkSession)
    return rows.mapInArrow(run, "item string, words array<long>").distinct()


def _shingles(windows: DataFrame) -> DataFrame:
    """(words, place, shingle): the shingles of distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            lengths = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy().view(np.uint64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            owner, place, found = [], [], []
            for m in np.unique(lengths):
                at = np.flatnonzero(lengths == m)
                rows = flat[edges[at][:, None] + np.arange(m)]
                s = min(SHINGLE, int(m))
                for j in range(int(m) - s + 1):
                    value = np.full(len(at), s, dtype=np.uint64)
                    for k in range(s):
                        value += rows[:, j + k] * _PLACES[k]
                    owner.append(at)
                    place.append(np.full(len(at), j))
                    found.append(words.mixed(value))
            if owner:
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [lists.take(pa.array(owner)), pa.array(np.concatenate(place).astype(np.int32)),
                     pa.array(np.concatenate(found).view(np.int64))], ["words", "place", "shingle"])

    return windows.mapInArrow(run, "words array<long>, place int, shingle long")


def bit_map(shingles: DataFrame) -> np.ndarray:
    """A map of `FILTER_BITS` bits of the ``shingle`` column; at most one row for each 32 of them comes to the driver."""
    bit = F.pmod(F.col("shingle"), F.lit(FILTER_BITS))
    rows = (shingles.select(F.floor(bit / 32).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(shingle, 32) as int))").alias("bit"))
            .groupBy("at").agg(F.expr("bit_or(bit)").alias("bits"))).toArrow()
    made = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    made[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return made


def _held(bits: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    at = shingle & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _found(word: np.ndarray, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, shingles) of the runs of words that the bit map holds, step by step."""
    for lo in range(0, len(word), _STEP):
        for size in sizes:
            shingle = _grams(word[lo:lo + _STEP + size - 1], size)
            at = np.flatnonzero(_held(bits, shingle))
            if len(at):
                yield size, at + lo, shingle[at]


def shingle_counts(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(shingle, count): how often each shingle of the bit map stands in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, word = _document_words(batch)
            parts = []
            for size, at, shingle in _found(word, sizes, bits.value):
                whole = np.searchsorted(edges, at, "right") == np.searchsorted(edges, at + size - 1, "right")
                parts.append(shingle[whole])
            if parts:
                shingle, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int64))],
                                                 ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, place, words): the rarest shingle of every distinct window all of whose shingles stand in documents."""
    every = _shingles(windows.select("words").distinct()).join(counts, "shingle", "left")
    first = every.groupBy("words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "shingle")).alias("x"))
    return first.where("x.count > 0").select("x.shingle", "x.place", "words")


def _offers(docs: DataFrame, sizes: list[int], bits, most: int) -> DataFrame:
    """One row a document (id, mark, n_words) and one for each of its shingles of the bit map (id, mark, shingle, at, lo,
    near): ``near`` are the words from position ``lo`` on that a window with that shingle may cover. ``mark`` tells rows of
    one id and different words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, word = _document_words(batch)
            counts = np.diff(edges)
            total = np.zeros(len(word) + 1, dtype=np.uint64)
            np.cumsum(words.mixed(word + (np.arange(len(word)) - np.repeat(edges[:-1], counts)).astype(np.uint64) * _PLACES[0]),
                      out=total[1:])
            mark = words.mixed(total[edges[1:]] - total[edges[:-1]] + counts.astype(np.uint64)).view(np.int64)
            ids = batch.column("id")
            rows = len(counts)
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(mark), pa.array(counts.astype(np.int64)), none, none, none,
                                              pa.nulls(rows, pa.list_(pa.int64()))], NAMES)
            for size, at, shingle in _found(word, sizes, bits.value):
                doc = np.searchsorted(edges, at, "right") - 1
                whole = at + size <= edges[doc + 1]
                doc, at, shingle = doc[whole], at[whole], shingle[whole]
                for k in range(0, len(at), _ROWS):
                    d, p, s = doc[k:k + _ROWS], at[k:k + _ROWS], shingle[k:k + _ROWS]
                    lo = np.maximum(p - (most - size), edges[d])
                    hi = np.minimum(p + most, edges[d + 1])
                    length = hi - lo
                    flat = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), pa.array(mark[d]), pa.nulls(len(d), pa.int64()), pa.array(s.view(np.int64)),
                         pa.array(p - edges[d]), pa.array(lo - edges[d]), _lists(word[flat], length)], NAMES)

    return docs.mapInArrow(run, "id long, mark long, n_words long, shingle long, at long, lo long, near array<long>")


NAMES = ["id", "mark", "n_words", "shingle", "at", "lo", "near"]


def _covered(spans: Column) -> Column:
    """How many positions the sorted spans (from, to) cover."""
    step = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                       lambda s, x: F.struct((s["n"] + F.greatest(x["to"] - F.greatest(x["from"], s["end"]), F.lit(0))).alias("n"),
                                             F.greatest(s["end"], x["to"]).alias("end")))
    return step["n"]


def contained(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): (id, mark, n_words) of every row of ``docs``, and the distinct (id, mark, from, to, words) of all
    windows of ``items`` in them, as written tables; `windows_of` names the items of a window."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = _texts(docs, "doc_id", "text").withColumn("id", F.col("id").cast("long"))
    windows = cut_lineage(windows_of(items, size=size).select("words").distinct())
    sizes = [r["n"] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().orderBy("n").collect()]
    bits = spark.sparkContext.broadcast(bit_map(_shingles(windows)))
    first = cut_lineage(prefixes(windows, shingle_counts(texts, sizes, bits)))
    bits.unpersist()
    release(windows)
    bits = spark.sparkContext.broadcast(bit_map(first))
    rows = cut_lineage(_offers(texts, sizes, bits, size))
    bits.unpersist()
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    offers = rows.where("shingle is not null").withColumn("salt", F.pmod(F.xxhash64("id", "mark", "at"), F.lit(SALTS)).cast("int"))
    # A window of m words lies where its prefix says, within the words of the document that came along.
    begin = F.col("at") - F.col("place") - F.col("lo")
    near = (offers.join(salted, ["shingle", "salt"]).withColumn("begin", begin)
            .where((F.col("begin") >= 0) & (F.col("begin") + F.size("words") <= F.size("near"))))
    hits = near.where(F.slice("near", F.col("begin").cast("int") + 1, F.size("words")) == F.col("words"))
    hits = cut_lineage(hits.select("id", "mark", (F.col("lo") + F.col("begin")).alias("from"),
                                   (F.col("lo") + F.col("begin") + F.size("words")).alias("to"), "words").distinct())
    release(first)
    return rows, hits


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` (doc_id, text) against ``items``
    (item_id, text).

    A null or empty text has no words and no hit; an item without words has no window and one without an id is left out;
    items of one id are one item, repeated rows of ``docs`` give repeated rows, and rows of one id (or of none) but
    different words are judged each for itself. Of a text of any length all windows are looked at. Other columns are
    ignored; an empty table of documents gives an empty one, one of items leaves all documents clean.
    """
    rows, hits = contained(docs, items, size)
    spans = hits.groupBy("id", "mark").agg(_covered(F.sort_array(F.collect_set(F.struct("from", "to")))).alias("n_hit"))
    named = hits.select("id", "mark", "words").distinct().join(windows_of(items, size=size), "words")
    named = named.groupBy("id", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = spans.join(named, (spans["id"].eqNullSafe(named["id"])) & (spans["mark"] == named["mark"])).select(
        spans["id"].alias("hit_id"), spans["mark"].alias("hit_mark"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("listed"))
    out = rows.where("shingle is null").join(
        found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))
