"""Vector searches against brute force."""

import numpy as np
import pytest

from parley.llm import exact_topk, graph_ann
from parley.llm.queries import QUERIES
from tests.llm.data import frame

SCHEMA = "vec_id long, embedding array<float>, label int"


def hard_vectors(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1 + i % 3, dim)], 0) for i in range(n)]
    rows += [(400, None, 0), (401, [], 0), (402, [float("nan")] + [0.0] * 7, 0), (403, [float("inf")] + [0.0] * 7, 0),
             (404, [None] + [1.0] * 7, 0), (405, [0.0] * 8, 0), (406, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    rows += [(500 + i, rows[20][1], 0) for i in range(40)]  # copies of a query
    return rows + [rows[40], rows[41]]


def top_by_force(rows, step, k):
    good = [(i, np.floor(64 * np.array(v, dtype=np.float64))) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in dict(sorted((i, tuple(v)) for i, v in good if i % step == 0)).items():
        best = sorted(((-int(np.dot(v, c)), i) for i, c in good if i != q and len(c) == len(v)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_exact_top_k(spark, monkeypatch, extra):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(exact_topk, "FIRST_STEP", 16)
    monkeypatch.setattr(exact_topk, "STEP", 16)
    rows = hard_vectors()
    vectors = frame(spark, rows, extra, SCHEMA)
    got = exact_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(top_by_force(rows, 20, 5))


def test_exact_top_k_of_huge_components_and_none(spark):
    rows = [(0, [1e9, 1.0], 0), (1, [1e9, 2.0], 0), (2, [1e9, 3.0], 0)]
    vectors = frame(spark, rows, False, SCHEMA)
    got = sorted(map(tuple, exact_topk.top_k(vectors, vectors.where("vec_id = 0"), 2).collect()))
    e = [[int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for _, v, _ in rows]
    products = {i: min(sum(a * b for a, b in zip(e[0], e[i])), (1 << 63) - 1) for i in (1, 2)}
    assert got == [(0, r + 1, i, products[i]) for r, i in enumerate(sorted(products, key=lambda i: (-products[i], i)))]
    empty = frame(spark, [], False, SCHEMA)
    assert exact_topk.top_k(empty, empty, 3).collect() == []


def test_pivots_eliminate_without_loss():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 40, (6, 6))
    c = np.floor(np.concatenate([m + rng.normal(0, 1, (400, 6)) for m in centers]))
    longest = float((c ** 2).sum(axis=1).max())
    points = exact_topk.pivots_of(exact_topk.lengthened(c[::7], longest))
    table = exact_topk.distances(exact_topk.lengthened(c, longest), points)
    seen = []
    plain = exact_topk._products
    exact_topk._products = lambda q, rows, big: (seen.append(len(rows)), plain(q, rows, big))[1]
    try:
        q, ids, s = exact_topk.search_cell(np.array([5]), c[5:6], np.arange(len(c)), c, table, points, longest, 10)
    finally:
        exact_topk._products = plain
    want = sorted(((-int(x), i) for i, x in enumerate(c @ c[5]) if i != 5))[:10]
    assert [(-int(x), int(i)) for x, i in zip(s, ids)] == want and sum(seen) < len(c)


def recall(got, rows, step, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    hit = total = 0
    for q, v in good:
        if q % step:
            continue
        want = sorted((float(np.sqrt(((c - v) ** 2).sum())), i) for i, c in good if i != q and len(c) == len(v))[:k]
        mine = sorted((r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        hit += len({i for _, i in want} & {i for _, i in mine})
        total += len(want)
        assert [r["rank"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: (r["score"], r["vec_id"]))] \
            == list(range(1, len(mine) + 1))
    return hit / total


@pytest.mark.parametrize("extra", [False, True])
def test_graph_search_of_hard_vectors(spark, extra):
    rows = hard_vectors()
    vectors = frame(spark, rows, extra, SCHEMA)
    got = graph_ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).collect()
    assert recall(got, rows, 20, 10) >= 0.98
    copies = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 20), key=lambda r: r["rank"])]
    assert copies == list(range(500, 510))
    assert not {r["vec_id"] for r in got} & {400, 401, 402, 403, 404, 405}
    empty = frame(spark, [], False, SCHEMA)
    assert graph_ann.nearest(empty, empty, 3).collect() == []


def test_graph_search_of_many_repeats(spark):
    rows = [(100, [1.0, 0.0, 0.0], 0)] * 50 + [(101, [1.0, 0.0, 0.0], 0), (102, [0.5, 0.0, 0.0], 0)] + [(103, [0.0, 3.0, 0.0], 0)] * 50
    vectors = frame(spark, rows, False, SCHEMA)
    got = graph_ann.nearest(vectors, vectors.where("vec_id = 100"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 3)) for r in got] == [(101, 0.0), (102, 0.5), (103, 3.162), (103, 3.162), (103, 3.162)]


def test_graph_recall_in_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD", 700)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 24)], 0) for i in range(3000)]
    vectors = frame(spark, rows, False, SCHEMA)
    got = graph_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()
    assert recall(got, rows, 100, 10) >= 0.95


def test_graph_degree_is_bounded_and_reached():
    x = np.random.default_rng(5).normal(0, 1, (900, 12))
    edges, start = graph_ann.build_graph(x)
    assert edges.shape == (900, graph_ann.DEGREE)
    seen, front = set(start.tolist()), list(start)
    while front:
        front = [j for i in front for j in edges[i] if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) >= 890


def test_registered_search_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert recall(QUERIES["op8_graph_ann"](spark, sf).collect(), rows, 100, 10) >= 0.9
