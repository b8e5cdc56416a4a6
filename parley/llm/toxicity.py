"""Toxicity by a factorization machine over hashed terms.

Terms are bare words and their first bytes (so that endings do not part forms of one stem), as 64-bit hashes. A term
that goes with the label is kept; the machine has a weight for each kept term and, by vectors, one for each pair of
terms in a text: ``score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the distinct kept terms of the text.

The fit reads a bounded sample of labelled rows (`SAMPLE_ROWS`, by a hash of the id); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import words
from parley.llm.frames import bounded_batches, ids_and_texts, map_batches
from parley.session import cut_lineage

#: Labelled rows the fit reads, about: a hash of the id decides, and the share is this number over the labelled rows.
SAMPLE_ROWS = 20_000
#: Terms kept at most, those with the strongest association first.
TERMS = 8192
#: A term is kept if its likelihood ratio exceeds this times the logarithm of the number of terms weighed.
STRICT = 2.0
PREFIXES = (4, 5, 6)
FACTORS = 8
_FILTER_BITS = 20


@dataclass
class Machine:
    """Kept terms in ascending order with their weights and vectors, and the bias."""
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def score(self, docs: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` texts whose distinct kept terms are the pairs (docs, index)."""
        linear = np.bincount(docs, weights=self.weights[index], minlength=n)
        total = np.stack([np.bincount(docs, weights=self.vectors[index, f], minlength=n) for f in range(FACTORS)])
        square = np.bincount(docs, weights=(self.vectors[index] ** 2).sum(axis=1), minlength=n)
        raw = self.bias + linear + 0.5 * ((total ** 2).sum(axis=0) - square)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def kept_terms(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, place in ``terms``) of the texts; ``terms`` is sorted."""
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    shift = np.uint64(64 - _FILTER_BITS)
    maybe[(terms >> shift).astype(np.int64)] = True
    found = []
    for docs, made in words.term_hashes(texts, PREFIXES):
        for hashes in made:
            at = np.flatnonzero(maybe[(hashes >> shift).astype(np.int64)])
            if len(at) and len(terms):
                place = np.searchsorted(terms, hashes[at])
                place[place == len(terms)] = 0
                hit = terms[place] == hashes[at]
                found.append(docs[at[hit]] * len(terms) + place[hit])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = np.unique(np.concatenate(found))
    return both // len(terms), both % len(terms)


def fit_weights(docs: np.ndarray, index: np.ndarray, labels: np.ndarray, terms: np.ndarray, epochs: int = 120,
                rate: float = 0.05, pull_rate: float = 0.15, decay: float = 0.01) -> Machine:
    """Logistic loss, full-batch AdaGrad, from small random vectors of a fixed seed. Pairs come sorted by text."""
    n, m = len(labels), len(terms)
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6) if n else 0.5
    weights, bias = np.zeros(m), float(np.log(share / (1 - share)))
    vectors = np.random.default_rng(7).normal(0, 0.05, (m, FACTORS))
    if not n or not m or labels.min() == labels.max():
        return Machine(terms, weights, vectors, bias)
    sums = [np.full(m, 1e-8), np.full((m, FACTORS), 1e-8), 1e-8]
    # Both labels weigh alike, so that the rarer one is not drowned.
    cost = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / n
    bias = 0.0
    for _ in range(epochs):
        own = vectors[index]
        total = np.stack([np.bincount(docs, weights=own[:, f], minlength=n) for f in range(FACTORS)], axis=1)
        raw = (bias + np.bincount(docs, weights=weights[index], minlength=n)
               + 0.5 * ((total ** 2).sum(axis=1) - np.bincount(docs, weights=(own ** 2).sum(axis=1), minlength=n)))
        error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) * cost
        down = error[docs]
        g_w = np.bincount(index, weights=down, minlength=m) + decay * weights / m
        pull = down[:, None] * (total[docs] - own)
        g_v = np.stack([np.bincount(index, weights=pull[:, f], minlength=m) for f in range(FACTORS)], axis=1)
        g_v += decay * vectors / m
        g_b = float(error.sum())
        for k, g in enumerate((g_w, g_v, g_b)):
            sums[k] = sums[k] + g * g
        weights = weights - rate * g_w / np.sqrt(sums[0])
        vectors = vectors - pull_rate * g_v / np.sqrt(sums[1])
        bias -= rate * g_b / np.sqrt(sums[2])
    return Machine(terms, weights, vectors, bias)


def in_training(doc_id: Column) -> Column:
    """Whether an id's labels may be learnt from: crc32 of its decimal text modulo 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = TERMS) -> Machine:
    """Fit on labelled rows of the training part; rows without a label, id or text are not learnt from. Of several labels
    of one id the greatest counts, and repeated rows count once.

    ``labels`` has doc_id and toxic. With no row of both labels the machine gives the share of label 1 (one half with
    none at all). What comes to the driver is bounded: ``max_terms`` terms, and their places in ``sample_rows`` texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    total = known.count()
    if total > sample_rows:
        share = F.lit(sample_rows / total)
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
    # Broadcast: about `sample_rows` rows of two numbers. A document that stands several times is learnt from once.
    rows = cut_lineage(ids_and_texts(docs).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text"]))
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), dtype=np.int64)
            pairs = [(d, h) for docs, made in words.term_hashes(batch.column("text"), PREFIXES) for h in made for d in [docs]]
            if not pairs:
                continue
            owner, term = np.concatenate([d for d, _ in pairs]), np.concatenate([h for _, h in pairs])
            order = np.argsort(owner, kind="stable")
            owner, term = words.distinct_by_text(owner[order], term[order])
            order = np.argsort(term, kind="stable")
            term, label = term[order], labels[owner[order]]
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            texts, hits = np.diff(np.append(first, len(term))), np.add.reduceat(label, first)
            yield pa.RecordBatch.from_arrays([pa.array(term[first].view(np.int64)), pa.array(texts), pa.array(hits)],
                                             ["term", "texts", "hits"])

    per_task = rows.select("text", "label").mapInArrow(counted, "term long, texts long, hits long")
    by_term = per_task.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("hits").alias("hits")).where("texts >= 3")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("hits")).first()
    n, hits = whole["n"], whole["hits"]
    if not n or hits in (0, n):
        return fit_weights(*[np.zeros(0, dtype=np.int64)] * 2, np.full(n, 1.0 if hits else 0.0), np.zeros(0, dtype=np.uint64))

    def part(seen, share):
        return F.when(seen > 0, seen * F.log(seen / (F.col("texts") * F.lit(share)))).otherwise(F.lit(0.0))

    strength = 2 * (part(F.col("hits"), hits / n) + part(F.col("texts") - F.col("hits"), 1 - hits / n))
    scored = cut_lineage(by_term.select("term", strength.alias("strength")))
    # As strong as chance makes the strongest of so many terms, or weaker: left out.
    least = STRICT * np.log(max(scored.count(), 2))
    kept = scored.where(F.col("strength") > F.lit(float(least))).orderBy(F.desc("strength"), "term").limit(max_terms)
    terms = np.sort(np.array([r["term"] for r in kept.collect()], dtype=np.int64).view(np.uint64))
    places = docs.sparkSession.sparkContext.broadcast(terms)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, index = kept_terms(batch.column("text"), places.value)
        edges = np.searchsorted(docs, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.ListArray.from_arrays(pa.array(edges), pa.array(index.astype(np.int32)))],
            ["label", "terms"])

    # In the order of ids, so that sums do not depend on the tasks' order.
    sample = map_batches(rows.sort("doc_id", F.xxhash64("text")).select("text", "label"), found,
                         "label int, terms array<int>").toArrow()
    lists = sample.column("terms").combine_chunks()
    docs_of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    index = lists.flatten().to_numpy().astype(np.int64)
    return fit_weights(docs_of, index, sample.column("label").to_numpy().astype(np.float64), terms)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; a null or empty text has the machine's bias alone.

    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one. No shuffle. The
    machine is broadcast: at most `TERMS` terms.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, index = kept_terms(batch.column("text"), held.value.terms)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(held.value.score(docs, index, batch.num_rows))], ["doc_id", "score"])

    return map_batches(ids_and_texts(docs), run, "doc_id long, score double")


def probability(text: Column, machine: Machine, spark: SparkSession) -> Column:
    """The score as a column of a table that is filtered by it."""
    held = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(texts):
        docs, index = kept_terms(pa.array(texts, type=pa.string(), from_pandas=True), held.value.terms)
        return type(texts)(held.value.score(docs, index, len(texts)))

    return run(text.cast("string"))
