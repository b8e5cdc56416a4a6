"""Collocations and benchmark passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from parley.llm import collocations, decontaminate
from parley.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.data import frame, hard_documents

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


# ---- collocations -----------------------------------------------------------------------------------------------

def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]


def mined_by_force(rows, least, most):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for p in pieces(text):
            total["und" if lang is None else lang] += len(p)
            for k in range(1, 5):
                f.update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + m] for p, b in good.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                   if p[i:i + m] in good and 100 * b >= 80 * good[p[i:i + m]]}
        found = []
        for p, a in good.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, r + 1, p.decode(), -a, left, right, total[lang], -s)
                for r, (s, a, p, left, right) in enumerate(found[:most])]
    return sorted(out)


def chatter(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "c", "of the", "Über", "ünd", "new york city hall", "x\ty", "q.w", "e,", "r\n", "１２", "z z z"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(30))), rnd.choice(["en", "en", None, "de", "und"]), "s", 0)
            for i in range(n)]


@pytest.mark.parametrize("extra, cells, ahead, most", [(True, 64, 1, 5), (False, 1 << 12, 1, 40)])
def test_collocations_match_brute_force(spark, monkeypatch, extra, cells, ahead, most):
    monkeypatch.setattr(collocations, "CELLS", cells)
    monkeypatch.setattr(collocations, "LANG_CELLS", 2 if extra else 1 << 16)
    monkeypatch.setattr(collocations, "AHEAD", ahead)
    rows = chatter(7) + hard_documents() * 3
    got = collocations.mine(frame(spark, rows, extra), least=4, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined_by_force(rows, 4, most)


def test_collocations_of_nothing_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CELLS", 1 << 12)
    assert collocations.mine(frame(spark, [])).collect() == []
    assert collocations.mine(frame(spark, [(1, None, None, None, None), (2, "one two", "en", "s", 7)])).collect() == []
    rows = [(1, "alpha beta gamma. alpha beta", "en", "s", 0)] * 50
    assert sorted(map(tuple, collocations.mine(frame(spark, rows)).collect())) == mined_by_force(rows, 30, 2000)


def test_sums_hand_on_what_is_too_much(monkeypatch):
    monkeypatch.setattr(collocations, "_HELD", 50)
    rng, sums, seen = np.random.default_rng(1), collocations._Sums(1), Counter()
    want = Counter()
    for _ in range(40):
        key = rng.integers(0, 120, 30).astype(np.uint64)
        want.update(key.tolist())
        uniq, first, count = collocations._counted_once(key)
        sums.add(uniq, count, (key[first],))
        if (out := sums.full()) is not None:
            seen.update(dict(zip(out[2].tolist(), out[1].tolist())))
    if (out := sums.rest()) is not None:
        seen.update(dict(zip(out[2].tolist(), out[1].tolist())))
    assert seen == want


def test_registered_collocations_match_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), QUERIES["op11_collocations"], ORACLES["op11_collocations"], sf) is None


# ---- benchmark passages -----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found_by_force(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m and item is not None else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text, *_ in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    names |= windows[tuple(w[i:i + m])]
        listed = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), listed, bool(hit)))
    return sorted(out, key=repr)


def benchmark_items():
    return [(1, "The quick brown fox jumps over the lazy dog and then some more words"), (2, "one"), (3, "two three"), (4, None),
            (5, ""), (6, " -- !"), (7, "a a a a a a a a a a a a"), (8, "The quick brown fox jumps over the lazy dog and then it ends"),
            (9, "Ärger über naïve　Straße"), (10, "same text again same"), (1, "a second text of item one"), (None, "no id at all here"),
            (11, "one two three four five six seven eight nine ten eleven twelve thirteen")]


def passages(seed):
    rnd = random.Random(seed)
    texts = [t for _, t in benchmark_items() if t]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rnd.randrange(6)):
            w = rnd.choice(texts).split(" ")
            lo = rnd.randrange(len(w))
            parts += w[lo:lo + rnd.randrange(1, 15)] + rnd.choice([[], ["filler"], ["-"]])
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(parts).upper() if i % 3 else " ".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_passages_match_brute_force(spark, extra):
    rows = passages(3) + hard_documents() + [(7, "one two", "en", "s", 0), (7, "two three", "en", "s", 0)] * 25
    items = benchmark_items()
    table = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        from pyspark.sql import functions as F
        table = table.withColumns({c: F.lit("clash") for c in ("words", "item", "id", "mark", "place", "shingle", "count")})
    got = decontaminate.decontaminate(frame(spark, rows, extra), table)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == found_by_force(rows, items)


def test_passages_of_nothing(spark):
    none, items = frame(spark, []), spark.createDataFrame(benchmark_items(), "item_id long, text string")
    assert decontaminate.decontaminate(none, items).collect() == []
    clean = decontaminate.decontaminate(frame(spark, hard_documents()), items.where("false")).collect()
    assert len(clean) == len(hard_documents()) and not any(r["contaminated"] for r in clean)


def test_prefixes_are_the_rarest_shingles(spark):
    """A window comes with its rarest shingle, and one with a shingle that no document holds does not come at all."""
    items = spark.createDataFrame([(1, "k l m n o p"), (2, "never seen in any text")], "item_id long, text string")
    docs = frame(spark, [(1, "k l m n . k l m n . k l m n", None, None, None), (2, "k l m n o p", None, None, None)])
    windows = decontaminate.windows_of(items)
    bits = spark.sparkContext.broadcast(decontaminate.bit_map(decontaminate._shingles(windows.select("words").distinct())))
    texts = decontaminate._texts(docs, "doc_id", "text")
    got = decontaminate.prefixes(windows, decontaminate.shingle_counts(texts, [4], bits)).collect()
    assert [(r["place"], len(r["words"])) for r in got] == [(1, 6)]


def test_a_passage_in_a_very_long_text(spark):
    item = " ".join(f"needle{i}" for i in range(14))
    text = "hay " * 700_000 + item + " stack" * 400_000
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    (row,) = decontaminate.decontaminate(frame(spark, [(1, text, None, None, None)]), items).collect()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (1_100_014, 14, 1)


def test_registered_passages_match_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), QUERIES["op12_decontaminate"], ORACLES["op12_decontaminate"], sf) is None
    assert compare(spark, duck(SF), QUERIES["op12_decontaminate"], ORACLES["op12_decontaminate"], SF) is None
