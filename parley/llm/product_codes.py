"""Product codes of vectors: integer k-means on each of eight parts, by walks over a trie of the distinct parts.

A part position's distinct parts with their counts are written once, in lexicographic order. In that order they are the
leaves of a trie whose levels are the dimensions. A walk down the trie carries, for the node it is at, the squared
distances to all codebook entries summed over the dimensions so far; parts with a common beginning share them. A leaf
takes the nearest entry and adds its components, times its count, to that entry's sums. `Walk` goes depth first in
blocks of leaves: within a block every level is one array operation over its nodes, and the sums along the path to the
last leaf are kept for the next block, as its first leaves may begin alike.

A round sends every task the codebooks (16 entries a part) and adds up one row a codebook component from each task. The
last assignment walks the distinct parts of each batch of vectors, so that no part has to be joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.frames import bounded_batches
from parley.session import cut_lineage, release

PARTS, ENTRIES, ROUNDS = 8, 16, 6
_BLOCK = 4096
_LONG = (1 << 63) - 1
#: A codebook set: for every vector length, one list of entries (tuples of integers) for each part.
Books = dict[int, list[list[tuple[int, ...]]]]


class Walk:
    """One walk over distinct parts of a position, given in lexicographic order, against a codebook."""

    def __init__(self, entries: list[tuple[int, ...]], reach: int):
        """``reach``: the greatest absolute component of the parts; sums that pass 64 bits are made of whole numbers."""
        self.width = len(entries[0])
        most = max([reach, *(abs(x) for e in entries for x in e)])
        self.kind = np.int64 if 4 * most * most * max(self.width, 1) < 1 << 62 else object
        self.book = np.array(entries, dtype=self.kind).reshape(len(entries), self.width)
        self.last: np.ndarray | None = None
        self.path: list[np.ndarray] = []

    def step(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, distance) of each leaf of the next block; equal distances go to the lower entry."""
        parts = parts.astype(self.kind)
        n = len(parts)
        sums = np.zeros((1, len(self.book)), dtype=self.kind)
        above = np.zeros(n, dtype=np.int64)  # the node of the level before, of every leaf
        new = np.zeros(n, dtype=bool)
        shared = self.last is not None
        path = []
        for j in range(self.width):
            new[1:] |= parts[1:, j] != parts[:-1, j]
            shared = shared and parts[0, j] == self.last[j]
            new[0] = not shared
            nodes = np.flatnonzero(new)
            made = sums[above[nodes]] + (parts[nodes, j][:, None] - self.book[:, j][None, :]) ** 2
            sums = np.concatenate([self.path[j][None, :], made]) if shared else made
            above = np.cumsum(new) - (0 if shared else 1)
            path.append(sums[-1])
        self.path, self.last = path, parts[-1]
        at_leaf = sums[above]
        entry = at_leaf.argmin(axis=1)
        return entry, at_leaf[np.arange(n), entry]


def walked(parts: np.ndarray, entries: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of parts in any order, repeats included, by a walk over the distinct ones."""
    n, width = parts.shape
    order = np.lexsort(parts.T[::-1]) if width else np.arange(n)
    rows = parts[order]
    first = np.ones(n, dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    leaves = rows[first]
    walk = Walk(entries, _reach(parts))
    found = [walk.step(leaves[lo:lo + _BLOCK]) for lo in range(0, len(leaves), _BLOCK)]
    leaf = np.empty(n, dtype=np.int64)
    leaf[order] = np.cumsum(first) - 1
    return np.concatenate([f[0] for f in found])[leaf], np.concatenate([f[1] for f in found])[leaf]


def _reach(parts: np.ndarray) -> int:
    return max(abs(int(parts.max())), abs(int(parts.min()))) if parts.size else 0


# ---- vectors and their parts ------------------------------------------------------------------------------------

def whole_numbers(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """(vec_id, label, dim, v): floor(scale * x) of every component, of the vectors that take part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", finite) & (F.size("x") % PARTS == 0))
    return rows.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def distinct_parts(rows: DataFrame) -> DataFrame:
    """(dim, part, value, n): the distinct parts of every position with their counts, in lexicographic order within each
    of the ranges that the tasks get."""
    width = (F.col("dim") / PARTS).cast("int")
    parts = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "v")
    parts = parts.select("dim", "part", F.slice("v", F.col("part") * width + 1, width).alias("value"))
    counted = parts.groupBy("dim", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.repartitionByRange("dim", "part", "value").sortWithinPartitions("dim", "part", "value")


def first_books(rows: DataFrame) -> Books:
    """The parts of the vectors of the `ENTRIES` smallest ids, of every vector length; an id with several vectors gives
    its least one."""
    named = rows.where("vec_id is not null").groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    place = F.row_number().over(W.partitionBy("dim").orderBy("vec_id"))
    first = named.withColumn("place", place).where(F.col("place") <= ENTRIES).orderBy("dim", "vec_id").collect()
    books: Books = {}
    for row in first:
        width = row["dim"] // PARTS
        of = books.setdefault(row["dim"], [[] for _ in range(PARTS)])
        for part in range(PARTS):
            of[part].append(tuple(row["v"][part * width:(part + 1) * width]))
    return books


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(dim, part, values, counts) of the runs of a batch of `distinct_parts`."""
    dim, part = batch.column("dim").to_numpy(), batch.column("part").to_numpy()
    lists, n = batch.column("value"), batch.column("n").to_numpy()
    flat = lists.flatten().to_numpy()
    edges = np.concatenate([[0], np.cumsum(dim // PARTS)])
    cuts = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (part[1:] != part[:-1]), [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(dim[lo]), int(part[lo]), flat[edges[lo]:edges[hi]].reshape(hi - lo, int(dim[lo]) // PARTS), n[lo:hi]


SUMS = "dim int, part int, entry int, place int, total decimal(38,0), n long"


def leaf_sums(parts: DataFrame, held) -> DataFrame:
    """(dim, part, entry, place, total, n): the weighted sums of the components of each entry's parts, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Books = held.value
        walks: dict[tuple[int, int], tuple[Walk, int]] = {}
        totals: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for dim, part, values, counts in _runs(batch):
                if dim not in books:
                    continue
                reach = _reach(values)
                walk, fits = walks.get((dim, part), (None, -1))
                if walk is None or reach > fits:
                    walk = Walk(books[dim][part], reach)
                    walks[dim, part] = walk, reach
                for lo in range(0, len(values), _BLOCK):
                    leaves, weight = values[lo:lo + _BLOCK], counts[lo:lo + _BLOCK]
                    entry, _ = walk.step(leaves)
                    exact = reach * int(weight.sum()) < 1 << 62
                    weighted = leaves * weight[:, None] if exact else leaves.astype(object) * weight.astype(object)[:, None]
                    for e in np.unique(entry):
                        own = entry == e
                        of = totals.setdefault((dim, part, int(e)), [0, [0] * values.shape[1]])
                        of[0] += int(weight[own].sum())
                        of[1] = [a + int(b) for a, b in zip(of[1], weighted[own].sum(axis=0))]
        rows = [(*key, j, total, n) for key, (n, sums) in totals.items() for j, total in enumerate(sums)]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, type=pa.int32()) for c in columns[:4]),
                 pa.array([Decimal(x) for x in columns[4]], type=pa.decimal128(38, 0)), pa.array(columns[5], type=pa.int64())],
                ["dim", "part", "entry", "place", "total", "n"])

    return (parts.mapInArrow(run, SUMS).groupBy("dim", "part", "entry", "place")
            .agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")))


def trained(parts: DataFrame, books: Books, rounds: int = ROUNDS) -> Books:
    """The codebooks after ``rounds`` rounds over the distinct parts."""
    context = parts.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(books)
        books = {dim: [[list(e) for e in part] for part in of] for dim, of in books.items()}
        for row in leaf_sums(parts, held).collect():  # one row a codebook component
            books[row["dim"]][row["part"]][row["entry"]][row["place"]] = int(row["total"]) // row["n"]
        books = {dim: [[tuple(e) for e in part] for part in of] for dim, of in books.items()}
        held.unpersist()
    return books


def digest(book: list[list[tuple[int, ...]]]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def coded(rows: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every row of `whole_numbers`."""
    held = rows.sparkSession.sparkContext.broadcast((books, {dim: digest(book) for dim, book in books.items()}))
    kind = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
                           T.StructField("codebooks_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = held.value
        for batch in batches:
            dims, lists = batch.column("dim").to_numpy(), batch.column("v")
            flat, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            code, error = np.full(len(dims), None, dtype=object), np.full(len(dims), None, dtype=object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) not in books:
                    continue
                v, width = flat[edges[at][:, None] + np.arange(dim)], int(dim) // PARTS
                found = [walked(v[:, k * width:(k + 1) * width], books[int(dim)][k]) for k in range(PARTS)]
                entries = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                code[at] = [row.tobytes().hex() for row in entries]
                error[at] = [min(sum(int(d) for d in row), _LONG) for row in zip(*(f[1] for f in found))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, type=pa.string()),
                 pa.array(error, type=pa.int64()), pa.array([digests.get(int(d)) for d in dims], type=pa.string())],
                ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, scale: float = 4096.0) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors that take part (vec_id, embedding, label).

    A vector that is null or holds a null or a non-finite component is left out, and so is one whose length eight does
    not divide. Vectors of one length have their own codebooks, which begin with the vectors of its 16 smallest ids (fewer,
    if there are fewer). A row without an id is coded and counted, but begins no codebook; a length without any id has
    none, and null codes and errors. An empty vector is eight empty parts: code 0, error 0. Repeated rows count as often
    as they stand and give repeated rows; other columns are ignored; an empty table gives an empty one. Components
    beyond a 64-bit integer are cut to its range, and so are errors.
    """
    bounded_batches(vectors.sparkSession)
    rows = cut_lineage(whole_numbers(vectors, scale))
    parts = cut_lineage(distinct_parts(rows))
    books = trained(parts, first_books(rows))
    release(parts)
    out = cut_lineage(coded(rows, books))
    release(rows)
    sums = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = sums.select(F.col("label").alias("of_label"), F.when(F.col("total") > _LONG, F.lit(_LONG)).otherwise(
        F.col("total")).cast("long").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")
