"""Exact top-k by inner product with a pivot table.

Candidates get one more coordinate that brings all of them to the greatest length M; then the inner product with a query
is (|q|^2 + M^2 - d^2) / 2 with d the Euclidean distance, so the highest product is the nearest point. Distances from
every candidate to `PIVOTS` pivots are computed once and stored with it. For a query, the greatest difference to its own
pivot distances is a lower bound of d, and so an upper bound of the product. Candidates of a block are taken in the
order of their bounds, in steps, until the next bound cannot reach the k-th best product found: what is left is
eliminated without a look, and the result is exact.

Queries meet candidates in a grid of bounded blocks; each cell gives k rows a query, which are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.vectors import best_per_query, blocks_of, matrix, usable
from parley.session import cut_lineage

PIVOTS = 24
#: Rows of the bounded sample that the pivots are chosen from, each as far from the others as can be.
PIVOT_SAMPLE = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
FIRST_STEP, STEP = 256, 2048
_EXACT = 1 << 52


def quantized(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of every component x as a double, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(usable(F.col("x")) & F.col("vec_id").isNotNull())
    # floor() of a double column gives a long; as a double again the products below run in floating point, exactly.
    return rows.select("vec_id", F.size("x").alias("dim"),
                       F.transform("x", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))


def pivots_of(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """``count`` rows, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lengthened(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more coordinate, so that all have squared length ``longest``."""
    return np.column_stack([v, np.sqrt(np.maximum(longest - (v ** 2).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, table: np.ndarray, pivots: np.ndarray,
                longest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, products): each query's k best of the cell, ties to the smaller id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c, table = c_ids[order], c[order], table[order].astype(np.float32)
    own = distances(np.column_stack([q, np.zeros(len(q))]), pivots).astype(np.float32)
    lengths = (q ** 2).sum(axis=1)
    reach = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(c).max(initial=0)), 1.0) * max(q.shape[1], 1)
    if reach < 1 << 23:
        q, c = q.astype(np.float32), c.astype(np.float32)
    exact_int = reach >= _EXACT
    # Rounding of the distances themselves: wide enough that no bound is too low.
    slack = 1e-3 * (np.sqrt(longest) + np.sqrt(lengths.max(initial=0)) + 1)
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        bound = np.abs(table - own[i]).max(axis=1) if len(pivots) else np.zeros(len(c), dtype=np.float32)
        low = np.maximum(bound.astype(np.float64) - slack, 0)
        most = (lengths[i] + longest - low ** 2) / 2
        first = min(FIRST_STEP, len(c))
        head = np.argpartition(bound, first - 1)[:first] if first < len(c) else np.arange(len(c))
        best_s, best_c = _top(_products(q[i], c[head], exact_int), head, c_ids, q_ids[i], k)
        if first < len(c):
            waiting = np.ones(len(c), dtype=bool)
            waiting[head] = False
            if len(best_s) == k:
                waiting &= most >= best_s[-1]
            rest = np.flatnonzero(waiting)
            rest = rest[np.argsort(bound[rest], kind="stable")]
            for lo in range(0, len(rest), STEP):
                step = rest[lo:lo + STEP]
                if len(best_s) == k and most[step[0]] < best_s[-1]:
                    break
                s, at = _products(q[i], c[step], exact_int), step
                if len(best_s) == k:
                    good = s >= best_s[-1]
                    s, at = s[good], at[good]
                best_s, best_c = _top(np.concatenate([best_s, s]), np.concatenate([best_c, at]), c_ids, q_ids[i], k)
        out_q.append(np.full(len(best_s), q_ids[i]))
        out_c.append(c_ids[best_c])
        out_s.append(best_s)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _products(q: np.ndarray, c: np.ndarray, exact_int: bool) -> np.ndarray:
    if exact_int:  # beyond what a double holds exactly
        return np.array([sum(int(a) * int(b) for a, b in zip(q, row)) for row in c], dtype=object)
    return c @ q


def _top(s: np.ndarray, at: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    other = ids[at] != own
    s, at = s[other], at[other]
    if len(s) > 4 * k and s.dtype != object:
        good = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, at = s[good], at[good]
    order = sorted(range(len(s)), key=lambda j: (-s[j], ids[at[j]]))[:k]
    return s[order], at[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` greatest inner products of floor(scale * x) with other rows.

    ``vectors`` and ``queries`` have vec_id and embedding. Rows of the query's own id are not candidates; a query id
    given twice is one query. Vectors that are null or empty or hold a null or a non-finite component take no part, nor
    do rows without an id; vectors meet vectors of their own length only. Repeated candidate rows are ranked each for
    itself; other columns are ignored; an empty table gives an empty one. Products beyond a 64-bit integer are cut to
    its range.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(quantized(vectors, scale))
    asked = cut_lineage(quantized(queries, scale).groupBy("vec_id", "dim").agg(F.min("v").alias("v")))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    # One row a vector length; in practice one.
    shapes = {r["dim"]: (r["n"], r["longest"]) for r in
              rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).collect()}
    wanted = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for dim, (_, longest) in shapes.items():
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
        pivots[dim] = pivots_of(lengthened(np.array([r["v"] for r in sample]), longest))
    held = spark.sparkContext.broadcast((pivots, {d: s[1] for d, s in shapes.items()}))

    def measure(batches):
        points, longest = held.value
        for batch in batches:
            dims, lists = batch.column("dim").to_numpy(), batch.column("v")
            flat, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            made: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = flat[edges[at][:, None] + np.arange(dim)]
                for j, row in zip(at, distances(lengthened(v, longest[dim]), points[dim]).astype(np.float32)):
                    made[j] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "dim", "v")),
                                              pa.array(made, type=pa.list_(pa.float32()))], ["vec_id", "dim", "v", "table"])

    table = cut_lineage(rows.mapInArrow(measure, "vec_id long, dim int, v array<double>, table array<float>"))

    def spread(dim_col: str, counts: dict[int, int], size: int):
        blocks = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, blocks_of(n, size))]) if counts else None
        return F.coalesce(blocks[F.col(dim_col)], F.lit(1)) if counts else F.lit(1)

    rows_of = {d: n for d, (n, _) in shapes.items()}
    q_blocks, c_blocks = spread("dim", wanted, QUERY_BLOCK), spread("dim", rows_of, CANDIDATE_BLOCK)

    def every(blocks):
        return F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))

    def block(blocks):
        return F.pmod(F.xxhash64("vec_id", F.lit(3)), blocks.cast("long")).cast("int")

    left = asked.withColumn("qb", block(q_blocks)).withColumn("cb", every(c_blocks))
    right = table.withColumn("cb", block(c_blocks)).withColumn("qb", every(q_blocks))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not q.num_rows or not c.num_rows:
            return kind.empty_table()
        points, longest = held.value
        dim = q.column("dim")[0].as_py()
        a, b, s = search_cell(q.column("vec_id").to_numpy(), matrix(q.column("v")), c.column("vec_id").to_numpy(),
                              matrix(c.column("v")), matrix(c.column("table")), points[dim], longest[dim], k)
        s = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in s], dtype=np.int64)
        return pa.table([pa.array(a), pa.array(b), pa.array(s)], schema=kind)

    found = (left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb"))
             .applyInArrow(cell, "query_id long, vec_id long, score long"))
    return best_per_query(found, [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
