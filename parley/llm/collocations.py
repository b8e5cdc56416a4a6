"""Collocations: the best phrases of two to four words of each language, by best-first growth with admissible bounds.

A phrase grows word by word from its prefix. What is known of a phrase before it is counted bounds its score: it occurs at
most as often as the rarer of its two parts of one word less, a, and its parts at a cut occur l and r times, so that no
cut scores more than 2000000 * a / (l + r); of a prefix, no continuation scores more than 2000000 * a / (l + a) at any cut
inside it, nor does anything in front of a suffix. A wave opens, best first, what can still reach a language's threshold:

* words and pairs are counted whole (a word bounds nothing below the greatest score), pairs of rare words apart, which
  no candidate holds;
* the threshold is the score of a language's `AHEAD`-th pair, and triples and quadruples are counted only where their
  bound, or that of their being a part of a longer phrase, reaches it, or where they could drop a phrase that does;
* a phrase is dropped by a longer one if and only if one that is a single word longer drops it, as that one is the more
  frequent: so the neighbours of the phrases above the threshold settle what survives.

A language is settled when its ``most``-th survivor, ties included, lies at or above its threshold: everything not opened
scores less. The others go on with a threshold four times as deep, at last with none.

What the tasks know of other phrases' counts are tables of `CELLS` cells, the least and the greatest count of the phrases
that fall in a cell: of fixed size, never too tight, so that a full table costs time and no phrase. Words are 64-bit hashes
while counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm import words
from parley.llm.frames import bounded_batches
from parley.session import cut_lineage, release

SCALE = 2_000_000
#: A longer phrase drops one it contains at this share of its count, in percent.
COVERS = 80
#: The pair whose score is a language's first threshold, as a multiple of the phrases asked for; each wave goes deeper.
AHEAD, DEEPER = 2, 4
CELLS = 1 << 21
LANG_CELLS = 1 << 16
#: Distinct phrases that a task adds up before it hands them on, and positions it looks at together.
_HELD, _STEP = 1 << 19, 1 << 17

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                   dtype=np.uint64)
WORDS = ("w1", "w2", "w3", "w4")


def key_of(lang: np.ndarray, *grams: np.ndarray) -> np.ndarray:
    """A 64-bit key of a phrase of a language."""
    value = lang * _PLACES[0]
    for place, gram in zip(_PLACES[1:], grams):
        value = value + gram * place
    return words.mixed(value)


def _cell(key: np.ndarray, cells: int) -> np.ndarray:
    return (key & np.uint64(cells - 1)).astype(np.int64)


# ---- counting ---------------------------------------------------------------------------------------------------

def languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lk, lang, text): the columns that counting reads, lk a hash of the language."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(F.xxhash64(lang).alias("lk"), lang.alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class _Sums:
    """Counts by key with the columns of the key's first occurrence, handed on whenever more than `_HELD` keys are held."""

    def __init__(self, width: int):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows, self.width = 0, width

    def add(self, key: np.ndarray, count: np.ndarray, columns: tuple[np.ndarray, ...]) -> None:
        self.parts.append((key, count, *columns))
        self.rows += len(key)

    def reduced(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate([p[k] for p in self.parts]) for k in range(self.width + 2)]
        _, first, back = np.unique(columns[0], return_index=True, return_inverse=True)
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, back, columns[1])
        return (columns[0][first], total, *(c[first] for c in columns[2:]))

    def full(self) -> tuple[np.ndarray, ...] | None:
        """The sums to hand on, if there are too many."""
        if self.rows <= 2 * _HELD:
            return None
        made = self.reduced()
        if len(made[0]) > _HELD:
            self.parts, self.rows = [], 0
            return made
        self.parts, self.rows = [made], len(made[0])
        return None

    def rest(self) -> tuple[np.ndarray, ...] | None:
        return self.reduced() if self.rows else None


def _counted_once(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uniq, first, count = np.unique(key, return_index=True, return_counts=True)
    return uniq, first, count.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lk, w1, word, a): every word of every language with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(found[0]), 1 << 16):
                _, count, lang, word, text = (c[lo:lo + (1 << 16)] for c in found)
                yield pa.RecordBatch.from_arrays([pa.array(lang.view(np.int64)), pa.array(word.view(np.int64)),
                                                  pa.array(text, type=pa.binary()), pa.array(count)], ["lk", "w1", "word", "a"])

        sums = _Sums(3)
        for batch in batches:
            data, offsets = words.text_bytes(batch.column("text"))
            lk = batch.column("lk").to_numpy().view(np.uint64)
            doc, _, start, end, word = words.located_words(data, offsets, _GAPS, _BREAKS)
            if len(doc):
                lang = lk[doc]
                key, first, count = _counted_once(key_of(lang, word))
                text = np.empty(len(first), dtype=object)
                text[:] = [data[a:b].tobytes().lower() for a, b in zip(start[first].tolist(), end[first].tolist())]
                sums.add(key, count, (lang[first], word[first], text))
                if (out := sums.full()) is not None:
                    yield from made(out)
        if (out := sums.rest()) is not None:
            yield from made(out)

    bounded_batches(docs.sparkSession)
    parts = docs.select("lk", "text").mapInArrow(run, "lk long, w1 long, word binary, a long")
    return parts.groupBy("lk", "w1").agg(F.min("word").alias("word"), F.sum("a").alias("a"))


def phrase_counts(docs: DataFrame, size: int, least: int, held) -> DataFrame:
    """(lk, w1 … w``size``, a): the phrases of ``size`` words that ``held`` (see `Known`) opens, those of ``least`` at least."""
    names = WORDS[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(found[0]), 1 << 17):
                _, count, *columns = (c[lo:lo + (1 << 17)] for c in found)
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(count)],
                                                 ["lk", *names, "a"])

        known, sums = held.value, _Sums(size + 1)
        for batch in batches:
            lk = batch.column("lk").to_numpy().view(np.uint64)
            # Texts of settled languages are not looked at.
            data, offsets = words.text_bytes(pc.if_else(pa.array(known.open_languages(lk)), batch.column("text"), None))
            doc, piece, _, _, word = words.located_words(data, offsets, _GAPS, _BREAKS)
            near = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
            for lo in range(0, len(doc) - size + 1, _STEP):
                n = min(_STEP, len(doc) - size + 1 - lo)
                at = near[lo:lo + n].copy()
                for j in range(1, size - 1):
                    at &= near[lo + j:lo + j + n]
                at = np.flatnonzero(at) + lo
                lang, grams = lk[doc[at]], [word[at + j] for j in range(size)]
                stay = known.opens(lang, grams)
                if len(stay):
                    lang, grams = lang[stay], [g[stay] for g in grams]
                    key, first, count = _counted_once(key_of(lang, *grams))
                    sums.add(key, count, (lang[first], *(g[first] for g in grams)))
                if (out := sums.full()) is not None:
                    yield from made(out)
        if (out := sums.rest()) is not None:
            yield from made(out)

    schema = ", ".join(["lk long", *(f"{n} long" for n in names), "a long"])
    parts = docs.select("lk", "text").mapInArrow(run, schema)
    return parts.groupBy("lk", *names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# ---- what a task knows of other phrases ---------------------------------------------------------------------------

def _below(x: np.ndarray) -> np.ndarray:
    """``x`` as 32-bit numbers, none of them greater."""
    y = x.astype(np.float32)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float32(0)), y)


def _above(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float32(np.inf)), y)


def cells_of(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least count, greatest count, greatest score) by cell of the phrases in ``table`` (lk, w1 …, a, score); 0 where a cell
    is empty, -1 for its score. At most `CELLS` rows come to the driver, whatever the corpus."""
    names, cells = WORDS[:size], CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy().view(np.uint64) for c in ("lk", *names)]
            yield pa.RecordBatch.from_arrays([pa.array(_cell(key_of(*columns), cells).astype(np.int32)), batch.column("a"),
                                              batch.column("score")], ["cell", "a", "score"])

    found = (table.select("lk", *names, "a", F.coalesce("score", F.lit(-1)).cast("long").alias("score"))
             .mapInArrow(run, "cell int, a long, score long").groupBy("cell")
             .agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("score").alias("score"))).toArrow()
    lo, hi, top = np.zeros(cells, np.float32), np.zeros(cells, np.float32), np.full(cells, -1, np.float32)
    at = found.column("cell").to_numpy()
    lo[at], hi[at] = _below(found.column("lo").to_numpy()), _above(found.column("hi").to_numpy())
    top[at] = _above(found.column("score").to_numpy())
    return lo, hi, top


class Known:
    """Which phrases of two, three or four words are worth counting: bounds from the cells of shorter phrases."""

    def __init__(self, least: int, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: np.ndarray | None):
        self.least, self.cells, self.threshold = least, cells, threshold

    def _looked_up(self, lang: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi, top = self.cells[len(grams)]
        cell = _cell(key_of(lang, *grams), len(lo))
        return lo[cell].astype(np.float64), hi[cell].astype(np.float64), top[cell]

    def _frequent(self, lang: np.ndarray, grams: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Those of the positions ``at`` whose phrase ``grams`` may occur ``least`` times."""
        return at[self._looked_up(lang[at], [g[at] for g in grams])[1] >= self.least] if len(at) else at

    def _threshold(self, lang: np.ndarray) -> np.ndarray:
        return self.threshold[_cell(words.mixed(lang), len(self.threshold))]

    def open_languages(self, lang: np.ndarray) -> np.ndarray:
        return np.ones(len(lang), dtype=bool) if self.threshold is None else np.isfinite(self._threshold(lang))

    def opens(self, lang: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
        """The positions to count."""
        at = np.arange(len(lang))
        wide = 1 if len(grams) == 2 else 2
        for k in range(len(grams) - wide + 1):
            at = self._frequent(lang, grams[k:k + wide], at)
        if len(grams) == 2:
            return at
        if not len(at):
            return at
        lang, grams = lang[at], [g[at] for g in grams]
        threshold = self._threshold(lang)
        return at[self._triples(lang, grams, threshold) if len(grams) == 3 else self._quadruples(lang, grams, threshold)]

    @staticmethod
    def _reaches(a: np.ndarray, others: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Whether 2000000 * a / others may be the threshold or more; the slack is for rounding."""
        return SCALE * a * (1 + 1e-9) >= threshold * others

    def _triples(self, lang: np.ndarray, grams: list[np.ndarray], threshold: np.ndarray) -> np.ndarray:
        lo1, _, _ = self._looked_up(lang, grams[:1])
        lo3, _, _ = self._looked_up(lang, grams[2:])
        lo12, hi12, top12 = self._looked_up(lang, grams[:2])
        lo23, hi23, top23 = self._looked_up(lang, grams[1:])
        a = np.minimum(hi12, hi23)
        prefix = self._reaches(a, lo1 + a, threshold) & self._reaches(a, lo12 + a, threshold)
        suffix = self._reaches(a, lo3 + a, threshold) & self._reaches(a, lo23 + a, threshold)
        drops = ((top12 >= threshold) & (100 * hi23 >= COVERS * lo12)) | ((top23 >= threshold) & (100 * hi12 >= COVERS * lo23))
        return prefix | suffix | drops

    def _quadruples(self, lang: np.ndarray, grams: list[np.ndarray], threshold: np.ndarray) -> np.ndarray:
        lo1, _, _ = self._looked_up(lang, grams[:1])
        lo4, _, _ = self._looked_up(lang, grams[3:])
        lo12, hi12, _ = self._looked_up(lang, grams[:2])
        lo34, hi34, _ = self._looked_up(lang, grams[2:])
        lo123, hi123, top123 = self._looked_up(lang, grams[:3])
        lo234, hi234, top234 = self._looked_up(lang, grams[1:])
        a = np.minimum(hi123, hi234)
        scored = ((a >= self.least) & self._reaches(a, lo1 + lo234, threshold) & self._reaches(a, lo12 + lo34, threshold)
                  & self._reaches(a, lo123 + lo4, threshold))
        drops = (((top123 >= threshold) & (hi123 > 0) & (100 * hi34 >= COVERS * lo123))
                 | ((top234 >= threshold) & (hi234 > 0) & (100 * hi12 >= COVERS * lo234)))
        return scored | drops


# ---- scores ---------------------------------------------------------------------------------------------------------

def _score(a: Column, both: Column) -> Column:
    """floor(2000000 * a / both) in decimals: the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(20,0)"), both.cast("decimal(20,0)"))


def scored(table: DataFrame, size: int, shorter: dict[int, DataFrame]) -> DataFrame:
    """``table`` with l, r and score of its lowest cut; null where a part was not counted, which no cut of a phrase at or
    above the threshold has."""
    names, cuts = WORDS[:size], []
    for k in range(1, size):
        for side, part in (("l", names[:k]), ("r", names[k:])):
            found = shorter[len(part)].select("lk", *(F.col(w).alias(n) for w, n in zip(WORDS, part)), F.col("a").alias(f"{side}{k}"))
            table = table.join(found, ["lk", *part], "left")
        both = F.col(f"l{k}") + F.col(f"r{k}")
        cuts.append(F.struct(_score(F.col("a"), both).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"),
                             F.col(f"r{k}").alias("r")))
    known = [F.col(f"{s}{k}").isNotNull() for s in "lr" for k in range(1, size)]
    every = known[0]
    for one in known[1:]:
        every = every & one
    low = F.when(every, F.array_min(F.array(*cuts)))
    return table.select("lk", *names, "a", low["l"].alias("l"), low["r"].alias("r"), low["score"].alias("score"))


def survivors(tables: dict[int, DataFrame], thresholds: DataFrame) -> DataFrame:
    """(lk, w1 … w4, a, l, r, score): the phrases at or above their language's threshold that no phrase one word longer
    drops; absent words are null."""
    out = None
    for size in (2, 3, 4):
        names = WORDS[:size]
        good = tables[size].join(thresholds, "lk").where("score >= threshold")
        if size < 4:
            longer = tables[size + 1]
            for part in (WORDS[:size], WORDS[1:size + 1]):
                most = longer.groupBy("lk", *(F.col(c).alias(n) for c, n in zip(part, names))).agg(F.max("a").alias("longest"))
                good = good.join(most, ["lk", *names], "left").where(
                    f"longest is null or 100 * longest < {COVERS} * a").drop("longest")
        rows = good.select("lk", *names, *(F.lit(None).cast("long").alias(n) for n in WORDS[size:]), "a", "l", "r", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- the search -----------------------------------------------------------------------------------------------------

def ranked_in(table: DataFrame, keys: list[str], order: list[Column], most: int, ties: bool = False,
              as_name: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group; Spark limits each task's rows of a group before it shuffles them."""
    rank = (F.rank() if ties else F.row_number()).over(W.partitionBy(*keys).orderBy(*order))
    found = table.withColumn(as_name or "rank_in_group", rank).where(F.col(as_name or "rank_in_group") <= most)
    return found if as_name else found.drop("rank_in_group")


def _thresholds(pairs: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """(lk, threshold): the score of the ``rank``-th pair of each language, 0 where it has fewer."""
    best = ranked_in(pairs.join(open_, "lk", "left_semi").select("lk", "score"), ["lk"], [F.desc("score")], rank)
    found = best.groupBy("lk").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    return open_.join(found, "lk", "left").select("lk", F.when(F.col("n") >= rank, F.col("low")).otherwise(F.lit(0)).alias("threshold"))


def _threshold_cells(thresholds: DataFrame) -> np.ndarray:
    """The least threshold of the languages of a cell; none is opened in an empty one."""
    count = LANG_CELLS
    cells = np.full(count, np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cell(words.mixed(batch.column("lk").to_numpy().view(np.uint64)), count)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("threshold")], ["cell", "low"])

    rows = (thresholds.select("lk", F.col("threshold").cast("long").alias("threshold")).mapInArrow(run, "cell int, low long")
            .groupBy("cell").agg(F.min("low").alias("low"))).toArrow()
    cells[rows.column("cell").to_numpy()] = rows.column("low").to_numpy()
    return cells


def mine(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of ``docs`` (text, lang).

    A null or empty text has no words, and a language without a phrase of ``least`` occurrences no rows; a null language
    is `und`. Repeated rows count as often as they stand, ids do not matter, texts of any length are taken whole (8 bytes
    a word are held of one), ties are settled by count and by the phrase's bytes; other columns are ignored; an empty table
    gives an empty one. ``docs`` is read once for words and pairs each, and twice a wave.
    """
    spark = docs.sparkSession
    texts = languages(docs)
    every = cut_lineage(word_counts(texts))
    total = every.groupBy("lk").agg(F.sum("a").alias("n"))
    tables: dict[int, DataFrame] = {1: every.where(F.col("a") >= least)}
    cells = {1: cells_of(tables[1].withColumn("score", F.lit(-1)), 1)}
    held = spark.sparkContext.broadcast(Known(least, cells, None))
    tables[2] = cut_lineage(scored(phrase_counts(texts, 2, least, held), 2, tables))
    held.unpersist()
    cells[2] = cells_of(tables[2], 2)
    open_ = cut_lineage(tables[2].select("lk").distinct())
    best: DataFrame | None = None
    rank, made = AHEAD * most, []
    while best is None or not open_.isEmpty():
        thresholds = cut_lineage(_thresholds(tables[2], open_, rank))
        low = _threshold_cells(thresholds)
        for size in (3, 4):
            held = spark.sparkContext.broadcast(Known(least, {k: v for k, v in cells.items() if k < size}, low))
            tables[size] = cut_lineage(scored(phrase_counts(texts, size, least, held), size, tables))
            held.unpersist()
            if size == 3:
                cells[3] = cells_of(tables[3], 3)
        found = cut_lineage(survivors(tables, thresholds))
        enough = found.groupBy("lk").agg(F.count(F.lit(1)).alias("m"))
        settled = cut_lineage(thresholds.join(enough, "lk", "left").where(f"threshold = 0 or m >= {most}").select("lk"))
        now = found.join(settled, "lk", "left_semi")
        best = now if best is None else best.unionByName(now)
        left = cut_lineage(open_.join(settled, "lk", "left_anti"))
        made += [found, settled]
        for table in (thresholds, open_, tables[3], tables[4]):
            release(table)
        open_, rank = left, rank * DEEPER
    release(open_)
    out = cut_lineage(_named(best, every, total, texts, most))
    for table in (every, tables[2], *made):
        release(table)
    return out


def _named(best: DataFrame, vocabulary: DataFrame, total: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The survivors' words in place of their hashes, the best of each language only."""
    # Ties of score and count go by the phrase: all rows tied with the last one are named before they are ranked.
    near = ranked_in(best, ["lk"], [F.desc("score"), F.desc("a")], most, ties=True)
    for w in WORDS:
        near = near.join(vocabulary.select("lk", F.col("w1").alias(w), F.col("word").cast("string").alias(f"{w}_text")),
                         ["lk", w], "left")
    phrase = F.concat_ws(" ", *(F.col(f"{w}_text") for w in WORDS))
    named = near.select("lk", phrase.alias("phrase"), "a", "l", "r", "score")
    named = ranked_in(named, ["lk"], [F.desc("score"), F.desc("a"), F.col("phrase")], most, as_name="rank")
    names = texts.select("lk", "lang").distinct()
    return (named.join(total, "lk").join(names, "lk")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
