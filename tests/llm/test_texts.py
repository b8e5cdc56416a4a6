"""Secrets, classifiers, near duplicates and chats against brute force and planted cases."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import chat, near_dup, packing, resample, secret_scan, toxicity, words
from parley.llm.queries import BYTE_BPE, ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.data import frame, hard_documents

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    found = SPACE.findall((text or "").translate(LOWER))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[k:k + 5]) for k in range(len(found) - 4)}


def classes_by_force(rows):
    sets, parent = {}, {}
    for name, text in rows:
        sets[name] = shingles(text)
        parent[name] = name

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {n: (len(sets[n]), root(n), root(n) == n) for n in names}


# ---- words ------------------------------------------------------------------------------------------------------

def test_words_and_windows(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["Ab", "ab", " ", "\t", "\n", "é", "　", "x!"]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    docs, hashes = words.word_hashes(pa.array(texts))
    want = [(i, w.translate(LOWER)) for i, t in enumerate(texts) for w in SPACE.findall(t)]
    assert docs.tolist() == [i for i, _ in want]
    by_hash = {}
    for (_, word), h in zip(want, hashes.tolist()):
        assert by_hash.setdefault(h, word) == word
    assert len(by_hash) == len({w for _, w in want})
    monkeypatch.setattr(words.windows, "__defaults__", (32,))
    small = words.word_hashes(pa.array(texts))
    assert small[0].tolist() == docs.tolist() and small[1].tolist() == hashes.tolist()


# ---- secrets ----------------------------------------------------------------------------------------------------

def spans_by_force(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_base_spans_match_brute_force():
    rnd = random.Random(3)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "a.b",
             "token=", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "ſecret", "-", "deadbeef"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        base = [s for s in secret_scan.spans_of(text, BYTE_BPE) if s[0] != "random"]
        assert base == spans_by_force(text)


def all_spans_by_force(text):
    """Every long string against every base span, nothing remembered."""
    found = spans_by_force(text)
    for m in secret_scan._LONG.finditer(text):
        if not any(s < m.end() and m.start() < e for _, s, e in found if _ != "random"):
            found += [("random", m.start() + a, m.start() + b) for a, b in secret_scan._random_spans(m[0], BYTE_BPE)]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_all_spans_match_brute_force():
    rnd = random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(300):
        parts = []
        for _ in range(rnd.randrange(12)):
            key = "".join(rnd.choice(letters) for _ in range(rnd.choice([8, 20, 24, 40, 300])))
            parts.append(rnd.choice([key, f"token={key}", f"a/{key}/b-{key}", f"AKIA{key.upper()}", "0123456789abcdef" * 3, "plain words",
                                     f"path/to/{key}", "internationalization_of_names", f"{key}=", "secret: abc"]))
        text = rnd.choice([" ", "\n", ", "]).join(parts)
        assert secret_scan.spans_of(text, BYTE_BPE) == all_spans_by_force(text)


def test_a_long_list_of_checksums_takes_time_in_proportion():
    import time
    text = "".join(f"{k:064x}  lib/module-{k}.tar.gz\n" for k in range(100_000))
    start = time.perf_counter()
    spans = secret_scan.spans_of(text, BYTE_BPE)
    assert time.perf_counter() - start < 30 and sum(s[0] == "hex" for s in spans) == 100_000


def test_random_strings_are_found_and_known_ones_left():
    rnd = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = 0
    for _ in range(200):
        key = "".join(rnd.choice(letters) for _ in range(40))
        found += any(s[0] == "random" for s in secret_scan.spans_of(f"the key {key} is out", BYTE_BPE))
    assert found >= 190
    for known in ("123e4567-e89b-12d3-a456-426614174000", "internationalization_of_names", "https/example/articles/overview",
                  "getHttpResponseCodeFromServer", "menteauouqueellement", "20240102-20240103-20240104"):
        assert not secret_scan.spans_of(known, BYTE_BPE)
    assert [s[0] for s in secret_scan.spans_of("d41d8cd98f00b204e9800998ecf8427e", BYTE_BPE)] == ["hex"]


@pytest.mark.parametrize("before,size,after", [
    ("AWS_SECRET_ACCESS_KEY=", 40, ""), ("DB_PASS=", 24, "\nNEXT=1"), ("https://host.example/get?sig=", 26, "&page=2"),
    ('KEY="', 32, '"'), ("KEY='", 32, "'")])
def test_random_values_after_an_equals_sign_are_found(before, size, after):
    rnd = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = 0
    for _ in range(200):
        key = "".join(rnd.choice(letters) for _ in range(size))
        spans = secret_scan.spans_of(before + key + after, BYTE_BPE)
        found += spans == [("random", len(before), len(before) + size)]
    assert found >= 190


def test_letters_of_one_case_are_weighed():
    rnd = random.Random(9)
    assert [s[0] for s in secret_scan.spans_of("key = qzxvkjwpqtrbnmlkjhgfdszxwq", BYTE_BPE)] == ["random"]
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        for form in ("{}", "{}-{}-{}", "{}_{}_{}/{}"):
            found = 0
            for _ in range(200):
                parts = ["".join(rnd.choice(letters) for _ in range(40 // form.count("{}"))) for _ in range(form.count("{}"))]
                found += any(s[0] == "random" for s in secret_scan.spans_of(f"the key {form.format(*parts)} is out", BYTE_BPE))
            assert found >= 185
    for known in ("internationalization", "com/organizations/settings/integrations/webhooks", "GOOGLE_CHALLENGE_COOLDOWN_MS",
                  "MERGE_DOM_IMAGE_PAGE_LIMIT",
                  "a-b-c-d-e-f-g-h-i-j-k-l", "Donaudampfschifffahrtsgesellschaft", "is-it-ok-to-go-up-or-to-do-it"):
        assert not secret_scan.spans_of(known, BYTE_BPE)


def test_random_part_of_a_path_is_found():
    rnd = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    path, found = "com/organizations/settings/integrations/webhooks/incoming/notifications/", 0
    for _ in range(200):
        key = "".join(rnd.choice(letters) for _ in range(24))
        (kind, start, end), = secret_scan.spans_of(path + key + "/overview", BYTE_BPE) or [("", 0, 0)]
        found += kind == "random" and start <= len(path) and end >= len(path) + 24
    assert found >= 190


@pytest.mark.parametrize("extra", [False, True])
def test_scan_and_redaction(spark, extra):
    docs = frame(spark, hard_documents(), extra)
    got = secret_scan.scan(docs, BYTE_BPE).collect()
    assert len(got) == docs.count()
    spans = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["spans"]] for r in got}
    assert spans[8] == [("assign", "password = hunter2hunter2"), ("assign", "token: abcdefghij")] and spans[0] == spans[1] == []
    clean = {r["doc_id"]: r["text"] for r in docs.withColumn("text", secret_scan.redacted(F.col("text"), BYTE_BPE)).collect()}
    assert clean[8] == "[SECRET] and [SECRET]" and clean[0] is None and clean[1] == "" and clean[3] == "one"


# ---- toxicity ---------------------------------------------------------------------------------------------------

def toxic_rows(n=1200):
    """Toxic only where an insult meets a group: each alone is clean."""
    rnd, rows, labels = random.Random(8), [], []
    for i in range(n):
        text = [rnd.choice(["river", "stone", "cloud", "field", "window", "paper"]) for _ in range(30)]
        insult, group = i % 3 != 0, i % 4 < 2
        if insult:
            text[5] = "vermin"
        if group:
            text[20] = "villagers"
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def test_machine_learns_a_pair_that_no_single_term_shows(spark):
    rows, labels = toxic_rows()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(labels[i][2]) for i in held)
    assert right >= 0.98 * len(held)


@pytest.mark.parametrize("extra", [False, True])
def test_toxicity_of_hard_rows_and_no_labels(spark, extra):
    docs = frame(spark, hard_documents(), extra)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    odd = spark.createDataFrame([(3, None, None), (None, 1, 1), (4, 0, 0), (4, 0, 0), (99, 1, 1)], none.schema)
    got = toxicity.score(docs, toxicity.fit(docs, odd)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), odd)).collect() == []


def test_toxicity_is_held_out_accurate_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n, right, clean_flagged = got.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("toxic")).cast("int")),
                                      F.sum((F.col("predicted") > F.col("toxic")).cast("int"))).first()
    assert right >= 0.97 * n and clean_flagged <= 0.01 * n


# ---- quality ----------------------------------------------------------------------------------------------------

def test_draw_keeps_good_and_leaves_bad(spark):
    rnd, rows, labels = random.Random(9), [], []
    for i in range(900):
        good = i % 4 != 0
        pool = ["river", "stone", "cloud", "the", "of", "field"] if good else ["BUY!!", "click###", "$$$", "now&&&", "the"]
        rows.append((i, " ".join(rnd.choice(pool) for _ in range(60)), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    got = resample.draw(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(kept & {i for i in range(900) if i % 4}) >= 670 and len(kept & {i for i in range(900) if not i % 4}) <= 5


@pytest.mark.parametrize("extra", [False, True])
def test_draw_of_hard_rows(spark, extra):
    docs = frame(spark, hard_documents(), extra)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and r["weight"] == 0 for r in resample.draw(docs, none).collect())
    odd = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (None, 1, 1), (9, None, 0)], none.schema)
    assert resample.draw(docs, odd).count() == docs.count()
    assert resample.draw(frame(spark, []), odd).collect() == []


def test_kth_greatest_is_exact(spark):
    values = np.round(np.random.default_rng(3).normal(0, 5, 3000), 2)
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 77, 1500, 2999, 3000, 9999):
        assert resample.kth_greatest(rows, "x", k) == np.sort(values)[::-1][min(k, 3000) - 1]


def test_gumbel_numbers_have_their_distribution(spark):
    got = spark.range(20_000).select(resample.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(got[0] - 0.5772) < 0.03 and abs(got[1] - 1.2825) < 0.03


def test_best_cut_weighs_good_texts_more():
    cut = resample.best_cut(np.array([0.0, 0.1, 0.2]), np.array([-1.0, -0.5, 0.05]))
    assert -0.5 < cut <= 0.0
    assert resample.best_cut(np.array([]), np.array([1.0])) == -np.inf


# ---- near duplicates --------------------------------------------------------------------------------------------

def copies(n_groups=25, seed=11):
    rnd, rows = random.Random(seed), []
    for g in range(n_groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 6, 40, 120, 700]))]
        for _ in range(rnd.randrange(1, 9)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_classes_match_brute_force(spark):
    rows = copies()
    got = near_dup.classes(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == classes_by_force(rows)


def test_chains_join_whole_and_partners_are_never_capped(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PARTNERS", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(24):  # each a step from the last, the ends far apart
        base = base[:2 * i] + [f"n{i}a", f"n{i}b"] + base[2 * i + 2:]
        rows.append((100 - i, " ".join(base)))
    got = near_dup.classes(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == classes_by_force(rows)


@pytest.mark.parametrize("extra", [False, True])
def test_classes_of_hard_rows(spark, extra):
    rows = hard_documents()
    got = near_dup.classes(frame(spark, rows, extra)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by_id[None] == (1, None, True) and by_id[0] == (0, 0, True) and by_id[2] == (0, 2, True)
    assert by_id[10][1:] == (10, True) and by_id[11][1:] == (10, False)
    assert near_dup.classes(frame(spark, [])).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = near_dup.classes(frame(spark, [(5, a, None, None, 0), (5, b, None, None, 0), (7, b, None, None, 0), (9, a, None, None, 0)]))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(5, 5), (7, 5), (9, 5)}


def test_many_repeats_of_a_row_are_one_document(spark, monkeypatch):
    """Fifty repeats of two texts make one pair and one link, and hard rows fifty times the same classes as once."""
    made = []
    confirmed = near_dup.confirmed

    def counted(pairs, docs):
        links = confirmed(pairs, docs)
        made.append((pairs.count(), links.count()))
        return links

    monkeypatch.setattr(near_dup, "confirmed", counted)
    words_of = [f"w{k}" for k in range(60)]
    rows = [(3, " ".join(words_of), "en", "s", 0), (8, " ".join([*words_of[:-1], "other"]), "en", "s", 0)]
    got = near_dup.classes(frame(spark, rows * 50)).collect()
    assert len(got) == 100 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (8, 3, False)}
    assert max(p for p, _ in made) <= 1 and sum(n for _, n in made) == 1
    hard = hard_documents()
    once = {tuple(r) for r in near_dup.classes(frame(spark, hard)).collect()}
    often = near_dup.classes(frame(spark, hard * 50)).collect()
    assert len(often) == 50 * len(hard) and {tuple(r) for r in often} == once


def test_near_copies_that_miss_the_first_are_offered_as_a_forest(spark, monkeypatch):
    """Near copies of one text that no pair with a bucket's first document has joined: few pairs join them."""
    base, offered = [f"w{k}" for k in range(200)], []
    partner_pairs = near_dup.partner_pairs

    def counted(*args):
        pairs = partner_pairs(*args)
        offered.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dup, "partner_pairs", counted)
    monkeypatch.setattr(near_dup, "star_pairs", lambda nodes, buckets: spark.createDataFrame([], "a long, b long"))
    rows = [(0, " ".join(base[:120] + [f"x{k}" for k in range(80)]))]
    for i in range(1, 81):
        text = list(base)
        text[i], text[119 + i] = f"a{i}", f"b{i}"
        rows.append((i, " ".join(text)))
    got = near_dup.classes(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == classes_by_force(rows)
    assert 0 < sum(offered) <= 12 * len(rows)


def test_nearest_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    for size, pairs in ((2, 1), (30, 20), (200, 900), (60, 1770)):
        a, b = np.nonzero(np.triu(np.ones((size, size)), 1))
        pick = rng.permutation(len(a))[:pairs]
        a, b, near, comp = a[pick], b[pick], rng.integers(0, 5, len(pick)) / 5, rng.integers(0, size // 2 + 1, size) * 7
        stay = near_dup._forest(a, b, near, comp)

        def joined(use):
            to = {c: c for c in comp.tolist()}
            for x, y in zip(comp[a[use]].tolist(), comp[b[use]].tolist()):
                to = {c: min(to[x], to[y]) if r in (to[x], to[y]) else r for c, r in to.items()}
            return to

        trees = joined(np.ones(len(a), dtype=bool))
        assert joined(stay) == trees and stay.sum() == len(trees) - len(set(trees.values()))


@pytest.mark.parametrize("shingles", [1 << 20, 9000])
def test_texts_just_unlike_leave_no_task_as_pairs(spark, monkeypatch, shingles):
    """Texts of one base that pass the sketches but not the exact check: only links are rows, in one block or in many."""
    if shingles < 1 << 20:  # absent before blocks were bounded by shingles
        monkeypatch.setattr(near_dup, "SHINGLES", shingles)
    partner_pairs, offered = near_dup.partner_pairs, []

    def counted(*args):
        pairs = partner_pairs(*args)
        offered.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dup, "partner_pairs", counted)
    base, rows = [f"w{k}" for k in range(300)], [(0, " ".join(f"z{k}" for k in range(300)))]
    for x in range(11):
        for y in range(11):  # five words of each text are its own, at most one of them where another text has one: 0.736
            text = list(base)
            for s in range(5):
                text[60 * s + 5 * ((x + s * y) % 11) + 2] = f"x{x}y{y}s{s}"
            rows.append((len(rows), " ".join(text)))
            if x == y:  # and a near copy
                rows.append((len(rows), " ".join([*text[:-1], f"e{x}"])))
    got = near_dup.classes(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    want = classes_by_force(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert sum(kept for _, _, kept in want.values()) == 122
    assert sum(offered) < len(rows)


def test_links_of_a_block_join_what_all_links_join():
    rng = np.random.default_rng(6)
    sets = []
    for g in range(12):
        pool = rng.integers(0, 1 << 63, 140, dtype=np.uint64)
        for size in rng.integers(95, 125, 8):
            sets.append(np.sort(rng.permutation(pool)[:size]))
    size, sizes = len(sets), np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    values = np.concatenate(sets)
    _, _, bands, sketch, filled = near_dup.features_of(edges, values)
    bands[:] = 9
    group = {"bucket": np.full(size, 9, dtype=np.uint64), "node": np.arange(size) * 3, "comp": rng.integers(0, 60, size), "n": sizes,
             "bands": bands, "sketch": sketch, "filled": filled, "edges": edges, "values": values.view(np.int64)}
    links = [(i, j) for i in range(size) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (
        len(sets[i]) + len(sets[j]) - c)]
    for left in (np.ones(size, dtype=bool), np.arange(size) % 2 == 0):
        right = left if left.all() else ~left
        want = np.array([(i, j) for i, j in links if left[i] and right[j] or left[j] and right[i]])
        for most in (1, 64):
            a, b = near_dup._links({**group, "left": left, "right": right}, most)
            assert (a < b).all() and 0 < len(a) < 60 and {*zip(a // 3, b // 3)} <= {(j, i) for i, j in want.tolist()}
            assert (near_dup._merged(group["comp"], a // 3, b // 3) == near_dup._merged(group["comp"], *want.T)).all()


def test_texts_of_wanted_ids_are_not_shuffled(spark, monkeypatch):
    """Neither by a join of ids too many to broadcast nor otherwise, and none is lost."""
    docs = frame(spark, [(i, f"text {i}", "en", "s", 0) for i in range(2000)] + [(None, "none", "en", "s", 0)])
    wanted = spark.range(0, 2000, 3).toDF("doc_id")
    taken, made = [], near_dup.map_batches

    def seen(rows, *args):
        taken.append((rows._jdf.queryExecution().executedPlan().toString(), {r["doc_id"] for r in rows.collect()}))
        return made(rows, *args)

    monkeypatch.setattr(near_dup, "map_batches", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = wanted.selectExpr("doc_id a", "doc_id + 3 b").where("b < 2000")
        assert near_dup.confirmed(pairs, docs).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (plan, ids), = taken
    assert "SortMergeJoin" not in plan and set(range(0, 2000, 3)) <= ids and len(ids) < 1000


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for size in (150, 1000, 8000):
        for target in (0.75, 0.9):
            common = int(round(2 * size * target / (1 + target)))
            pool = rng.integers(0, 1 << 64, 2 * size - common, dtype=np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - common:])
            f = near_dup.features_of(np.array([0, size, 2 * size]), np.concatenate([a, b]))
            shared = near_dup._common(f[3][:1], f[4][:1], f[3][1:], f[4][1:])[0, 0]
            bins = near_dup.BINS * (1 - np.exp(-len(pool) / near_dup.BINS))
            assert abs(shared / bins - target) < 0.08


#: (shingles of the one text, of the other, common ones), at a similarity of 0.75 or just above.
LEAST_LINKS = [(4, 3, 3), (4, 4, 4), (5, 4, 4), (6, 5, 5), (7, 7, 6), (8, 6, 6), (8, 8, 7), (20, 20, 18), (65, 65, 56),
               (70, 70, 60), (100, 75, 75), (100, 80, 78), (98, 98, 84), (140, 140, 120), (350, 350, 300)]


def test_no_sketch_drops_a_least_link(spark):
    rng, groups = np.random.default_rng(12), []
    for a, b, common in [*LEAST_LINKS, (2048, 2048, 1756), (2200, 2000, 1800), (3500, 3500, 3000)]:
        times = 400 if a < 1000 else 40
        pool = rng.integers(0, 1 << 63, (times, a + b - common), dtype=np.uint64)
        sets = [s for row in pool for s in (np.sort(row[:a]), np.sort(row[a - common:]))]
        edges = np.cumsum([0] + [len(s) for s in sets])
        groups.append((np.diff(edges), near_dup.features_of(edges, np.concatenate(sets))))
    rows = []
    for sizes, (_, _, _, sketch, filled) in groups:
        for k in range(0, len(sizes), 2):
            ones = near_dup._ones(sketch[k:k + 1], sketch[k + 1:k + 2])
            assert near_dup._possible(sizes[k] + sizes[k + 1], int(filled[k]) + int(filled[k + 1]), ones).all()
        rows += [tuple({"n": int(sizes[j]), "sketch": sketch[j].view(np.int64).tolist(), "filled": int(filled[j])}
                       for j in (k, k + 1)) for k in range(0, 80, 2)]
    kind = "struct<n: long, sketch: array<long>, filled: int>"
    pairs = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert pairs.where(near_dup.passes("a", "b")).count() == len(rows)


def test_least_links_are_found(spark):
    rows, want = [], {}
    for g, (a, b, common) in enumerate(LEAST_LINKS * 30):
        one = [f"g{g}w{k}" for k in range(a + 4)]
        for text in (one, one[:common + 4] + [f"g{g}x{k}" for k in range(b - common)]):
            want[len(rows)] = (len(text) - 4, 2 * g)
            rows.append((len(rows), " ".join(text), "en", "s", 0))
    got = near_dup.classes(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


# ---- chats ------------------------------------------------------------------------------------------------------

def test_chat_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    rows = [(c, k, *turns[k]) for c, n in ((1, 2), (2, 3), (3, 4), (4, 4)) for k in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"), (None, 0, "user", None)]
    schema = "conv_id long, turn long, role string, text string"
    for extra in (False, True):
        got = chat.format_chats(frame(spark, rows, extra, schema)).collect()
        assert sorted(map(repr, ((r["conv_id"], r["n_turns"]) for r in got))) == sorted(map(repr, [(3, 4), (5, 2), (None, 1)]))
    text = next(r["text"] for r in got if r["conv_id"] == 5)
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert chat.format_chats(frame(spark, [], False, schema)).collect() == []


def test_long_chats_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 4)
    rows = [(c, k, "user", f"turn {k}") for c, n in ((1, 11), (2, 7), (3, 11)) for k in range(n)]
    got = chat.format_chats(frame(spark, rows, False, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["part"]) for r in sorted(got, key=lambda r: r["part"])] == [(1, 0), (1, 1), (1, 2)]
    whole = "".join(r["text"] for r in sorted(got, key=lambda r: r["part"]))
    assert whole == "".join(f"<|im_start|>user\nturn {k}<|im_end|>\n" for k in range(11))


# ---- registered queries -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_near_duplicates_of_the_given_documents(spark):
    rows = duckdb.execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = QUERIES["op9_near_dup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == classes_by_force(rows)


def test_pipeline_decisions_take_effect(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {name: fn for name, fn in corpus_pipeline.STAGES}
    for name, fn in steps.items():
        before, docs = docs, corpus_pipeline.cut_lineage(fn(spark, docs, SF))
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        if name == "near_dup":
            assert near_dup.classes(docs).where(~F.col("kept")).count() == 0
        if name == "secret_scan":
            assert secret_scan.scan(docs, BYTE_BPE).where("size(spans) > 0").count() == 0
    ids = {r[0] for r in before.select("doc_id").collect()}
    assert {r[0] for r in docs.select("doc_id").collect()} == ids
    assert packing.CAPACITY == 2048 and docs.where("length > 2048").count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages_take_hard_rows(spark, tmp_path, extra):
    import corpus_pipeline
    spark.createDataFrame([(3, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for rows in (hard_documents(), []):
        docs = frame(spark, rows, extra)
        for name, fn in corpus_pipeline.STAGES:
            before, docs = docs, corpus_pipeline.cut_lineage(fn(spark, docs, str(tmp_path)))
            assert name == "packing" or docs.columns == before.columns
        assert bool(docs.count()) == bool(rows)


@pytest.mark.parametrize("labels", [[(3, 0), (4, 1)], [(3, 1), (4, 1)], []])
def test_toxicity_stage_keeps_all_when_no_term_is_learnt(spark, tmp_path, labels):
    import corpus_pipeline
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, hard_documents())
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(hard_documents())
