"""Product codes against brute force."""

import hashlib
import math

import numpy as np
import pytest

from parley.llm import product_codes
from parley.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.data import frame

SCHEMA = "vec_id long, embedding array<float>, label int"


def coded_by_force(rows):
    groups = {}
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) % 8 == 0:
            whole = [math.floor(4096 * float(np.float32(x))) for x in v]
            groups.setdefault(len(v), []).append((vec_id, label, whole))
    out = []
    for dim, members in groups.items():
        w = dim // 8
        ids = {}
        for vec_id, _, v in members:
            if vec_id is not None:
                ids[vec_id] = min(ids.get(vec_id, v), v)
        seeds = [ids[i] for i in sorted(ids)[:16]]
        if not seeds:
            out += [(i, None, None, lab, None) for i, lab, _ in members]
            continue
        books = [[s[p * w:(p + 1) * w] for s in seeds] for p in range(8)]

        def nearest(part, x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[part]))

        for _ in range(6):
            for p in range(8):
                own = {}
                for _, _, v in members:
                    x = v[p * w:(p + 1) * w]
                    own.setdefault(nearest(p, x)[1], []).append(x)
                for k, xs in own.items():
                    books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, lab, v in members:
            found = [nearest(p, v[p * w:(p + 1) * w]) for p in range(8)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab, sha))
    sums = {}
    for _, _, e, lab, _ in out:
        if e is not None:
            sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, min(sums[lab], (1 << 63) - 1) if lab in sums else None, s) for i, c, e, lab, s in out), key=repr)


def some_vectors(n=200, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    return [(i * 3 % 997, [float(np.float32(x)) for x in rng.normal(0, 0.2, dim).round(2)], None if i % 9 == 0 else i % 4)
            for i in range(n)]


@pytest.mark.parametrize("extra", [False, True])
def test_codes_match_brute_force(spark, extra):
    rows = some_vectors() + some_vectors(5, 8, 4)
    rows += [(400, None, 0), (401, [], 0), (402, [float("nan")] * 24, 0), (403, [float("inf")] * 24, 0), (404, [None] * 24, 0),
             (405, [1.0] * 12, 0), (None, [0.5] * 24, None), (None, [0.25] * 32, 5)]
    rows += [rows[3]] * 50 + [(rows[0][0], [9.0] * 24, 1)]
    got = product_codes.compress(frame(spark, rows, extra, SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == coded_by_force(rows)


def test_codes_of_none_and_of_huge_components(spark):
    assert product_codes.compress(frame(spark, [], False, SCHEMA)).collect() == []
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 3e5, 16)], 0) for i in range(40)]
    got = product_codes.compress(frame(spark, rows, False, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == coded_by_force(rows)
    (row,) = product_codes.compress(frame(spark, [(1, [3e38] * 8, 0)], False, SCHEMA)).collect()
    assert row["code"] == "00" * 8 and row["error"] == 0


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("reach", [40, 1 << 31])
def test_a_walk_shares_sums_and_loses_none(block, reach):
    rng = np.random.default_rng(block)
    leaves = np.unique(rng.integers(-2, 3, (300, 5)) * (reach // 2), axis=0)
    book = [tuple(int(x) for x in rng.integers(-reach, reach, 5)) for _ in range(16)]
    book[7] = book[2]
    walk = product_codes.Walk(book, reach)
    found = [walk.step(leaves[lo:lo + block]) for lo in range(0, len(leaves), block)]
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in leaves]
    assert [(int(d), int(k)) for k, d in zip(*(np.concatenate([f[j] for f in found]) for j in (0, 1)))] == want


def test_registered_codes_match_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), QUERIES["op13_product_codes"], ORACLES["op13_product_codes"], sf) is None
