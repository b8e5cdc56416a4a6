"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Distinct vectors are dealt into shards of bounded size. In each shard every vector is inserted by a greedy beam search
from the shard's centre on the graph so far; what the search visited is pruned to at most `DEGREE` diverse neighbours: the
nearest is kept, and those that are nearer to it by the factor `RELAX` than to the new vector go. Edges are added in both
directions and an overfull vector is pruned again. A query runs a beam search in every shard, and the shards' answers
are merged. Searches of a batch of vectors run side by side in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.vectors import best_per_query, blocks_of, matrix, usable
from parley.session import cut_lineage

SHARD, QUERY_BLOCK = 4096, 1024
DEGREE, RELAX = 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 48, 96
BATCH = 256
_FAR = np.float32(np.inf)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def beam_search(x: np.ndarray, norm: np.ndarray, edges: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int,
                ) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` nearest vectors each query has met, nearest first; -1 where fewer.

    Every step opens the nearest unopened vector of each query's beam and adds its neighbours, until none is left.
    """
    n, m = len(x), len(q)
    q_norm = _squares(q)
    met = np.zeros((m, n), dtype=bool)
    row = np.arange(m)
    ids = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), _FAR, dtype=np.float32)
    opened = np.zeros((m, beam), dtype=bool)
    s = starts[:beam]
    ids[:, :len(s)] = s
    dist[:, :len(s)] = norm[s][None, :] + q_norm[:, None] - 2 * q @ x[s].T
    met[:, s] = True
    order = np.argsort(dist, axis=1)
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    live = row
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), _FAR, dist[live])
        at = waiting.argmin(axis=1)
        go = waiting[np.arange(len(live)), at] < _FAR
        live, at = live[go], at[go]
        if not len(live):
            break
        opened[live, at] = True
        near = edges[ids[live, at]]
        fresh = (near >= 0) & ~met[live[:, None], near]
        met[live[:, None], np.where(near >= 0, near, ids[live, at][:, None])] = True
        d = norm[near] + q_norm[live][:, None] - 2 * np.einsum("ijk,ik->ij", x[near], q[live])
        d = np.where(fresh, d, _FAR).astype(np.float32)
        both_d, both_i = np.concatenate([dist[live], d], axis=1), np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        both_o = np.concatenate([opened[live], np.zeros(near.shape, dtype=bool)], axis=1)
        pick = np.argpartition(both_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live] = np.take_along_axis(both_d, pick, 1), np.take_along_axis(both_i, pick, 1)
        opened[live] = np.take_along_axis(both_o, pick, 1)
    order = np.argsort(dist, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, norm: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int = DEGREE,
                 relax: float = RELAX) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point from its row of candidates (-1: none)."""
    none = (cand < 0) | (cand == points[:, None])
    own = np.where(none, _FAR, norm[cand] + norm[points][:, None] - 2 * np.einsum("ijk,ik->ij", x[cand], x[points]))
    order = np.argsort(own, axis=1)
    cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
    twice = np.zeros(cand.shape, dtype=bool)
    by_id = np.argsort(cand, axis=1, kind="stable")
    ranked = np.take_along_axis(cand, by_id, 1)
    np.put_along_axis(twice, by_id[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    own[twice] = _FAR
    vec = x[cand]
    alive = own < _FAR
    out = np.full((len(points), degree), -1, dtype=np.int64)
    row = np.arange(len(points))
    for k in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        out[has, k] = cand[row[has], first[has]]
        lead = vec[row, first]
        between = norm[cand] + norm[cand[row, first]][:, None] - 2 * np.einsum("ijk,ik->ij", vec, lead)
        # Squared distances, so the factor is squared as well.
        alive &= relax * relax * between > own
        alive[row, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges: one row of neighbours a vector, -1 where fewer; the start points: the nearest to the centre first)."""
    x = x.astype(np.float32)
    n, norm = len(x), _squares(x)
    rng = np.random.default_rng(seed)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = np.array([int((norm - 2 * x @ x.mean(axis=0)).argmin())])
    order = rng.permutation(n)
    # The first vectors have no graph to be found by: they are linked with each other.
    lo, size = 0, min(n, 2 * degree)
    while lo < n:
        batch = order[lo:lo + size]
        if lo == 0:
            if start[0] not in batch:
                batch = np.append(batch, start[0])
            cand = np.tile(batch, (len(batch), 1))
        else:
            cand, _ = beam_search(x, norm, edges, start, x[batch], beam)
            # Vectors of one batch do not see each other in the graph: each also meets the nearest of its batch.
            inside = norm[batch][None, :] - 2 * x[batch] @ x[batch].T
            np.fill_diagonal(inside, np.inf)
            k = min(8, len(batch) - 1)
            if k:
                cand = np.concatenate([cand, batch[np.argpartition(inside, k - 1, axis=1)[:, :k]], edges[batch]], axis=1)
        edges[batch] = robust_prune(x, norm, batch, cand, degree)
        _back(x, norm, edges, batch, degree)
        lo += size
        size = min(BATCH, max(size, lo))
    return edges, start


def _back(x: np.ndarray, norm: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int) -> None:
    """The edges of ``batch`` in the other direction; whoever gets too many is pruned again."""
    source, target = np.repeat(batch, degree), edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    who, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(who), BATCH):
        part, f, c = who[lo:lo + BATCH], first[lo:lo + BATCH], count[lo:lo + BATCH]
        width = int(c.max())
        new = np.full((len(part), width), -1, dtype=np.int64)
        place = np.arange(width)[None, :] < c[:, None]
        new[place] = source[f[0]:f[-1] + c[-1]]
        cand = np.concatenate([edges[part], new], axis=1)
        edges[part] = robust_prune(x, norm, part, cand, degree)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): every distinct vector that takes part, with the ``k`` smallest of its ids, each as often as it stands but no
    more than ``k`` times: more cannot be among the k nearest of any query. Counted per task before the shuffle, so that
    copies of one vector do not meet."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    rows = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k)
    repeated = F.array_repeat(F.col("vec_id"), F.least("n", F.lit(k)).cast("int"))
    return ranked.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list(repeated))).alias("ids"))


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """The index as a written table: (dim, shard, at, v, ids, edges, start), one row a distinct vector.

    ``edges`` are places (``at``) in the same shard. Vectors that are null or empty or zero, or hold a null or a
    non-finite component, and rows without an id are left out.
    """
    rows = cut_lineage(distinct_vectors(vectors, k).withColumn("dim", F.size("v")))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(F.col("dim") == dim, blocks_of(n, shard)).otherwise(shards)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("v"), shards.cast("long")).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        # The same graph whatever the order in which rows arrive.
        first = np.array([i[0] for i in part.column("ids").to_pylist()])
        part = part.take(np.argsort(first, kind="stable"))
        edges, start = build_graph(matrix(part.column("v")))
        lists = pa.array([e[e >= 0].astype(np.int32) for e in edges], type=pa.list_(pa.int32()))
        at = np.arange(part.num_rows, dtype=np.int32)
        return pa.table([part.column("dim"), part.column("shard"), pa.array(at), part.column("v"), part.column("ids"),
                         lists, pa.array(np.isin(at, start))], names=["dim", "shard", "at", "v", "ids", "edges", "start"])

    return cut_lineage(dealt.groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard int, at int, v array<double>, ids array<long>, edges array<int>, start boolean"))


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, by Euclidean distance in double
    precision, ties to the smaller id. The query's own id is no candidate; a query id given twice is one query."""
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    asked = asked.where(usable(F.col("q")) & F.exists("q", lambda x: x != 0) & F.col("query_id").isNotNull())
    asked = cut_lineage(asked.groupBy("query_id", F.size("q").alias("dim")).agg(F.min("q").alias("q")))
    blocks = blocks_of(asked.count(), QUERY_BLOCK)
    places = index.groupBy(F.col("dim").alias("index_dim"), F.col("shard").alias("index_shard")).count()
    block = F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(blocks)).cast("int")
    left = asked.withColumn("block", block).join(places, F.col("dim") == F.col("index_dim")).select(
        "query_id", "q", "dim", F.col("index_shard").alias("shard"), "block")
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return kind.empty_table()
        c = c.sort_by("at")
        exact, asked_v = matrix(c.column("v")), matrix(q.column("q"))
        x, norm = exact.astype(np.float32), _squares(exact.astype(np.float32))
        edges = np.full((len(x), DEGREE), -1, dtype=np.int64)
        for i, e in enumerate(c.column("edges").to_pylist()):
            edges[i, :len(e)] = e
        start = np.flatnonzero(c.column("start").to_numpy())
        ids, own = c.column("ids").to_pylist(), q.column("query_id").to_numpy()
        out = []
        for lo in range(0, len(own), BATCH):
            found, _ = beam_search(x, norm, edges, start, asked_v[lo:lo + BATCH].astype(np.float32), max(beam, k + 1))
            for name, v, row in zip(own[lo:lo + BATCH], asked_v[lo:lo + BATCH], found):
                row = row[row >= 0]
                d = np.sqrt(((exact[row] - v) ** 2).sum(axis=1))
                mine = sorted((float(s), i) for s, r in zip(d, row) for i in ids[r] if i != name)[:k]
                out += [(int(name), i, s) for s, i in mine]
        return pa.table([pa.array(list(c), type=t) for c, t in zip(zip(*out), kind.types)], schema=kind) if out \
            else kind.empty_table()

    found = (left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
             .applyInArrow(run, "query_id long, vec_id long, score double"))
    return best_per_query(found, [F.col("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index ``vectors`` and search it for ``queries`` (both vec_id, embedding): the ``k`` nearest found of each.

    Vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do rows without an
    id; vectors meet vectors of their own length only. Equal vectors of several ids are one point of the graph and come
    back with their ids in order, an id that stands several times as often. Other columns are ignored; an empty table gives
    an empty one.
    """
    return search(build_index(vectors, k + 1), queries, k)
