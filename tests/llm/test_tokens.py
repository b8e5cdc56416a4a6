"""Encoding, token files and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import packing, pieces, token_files
from parley.llm.byte_bpe import tokenizer
from parley.llm.elias_fano import EliasFano
from parley.llm.queries import BYTE_BPE, PIECES
from tests.llm.data import frame, hard_documents

LIBRARY = Tokenizer.from_file(BYTE_BPE)


def library_ids(text, end):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("extra", [False, True])
def test_pieces_match_the_library(spark, extra):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = hard_documents()
    got = pieces.decode(pieces.encode(frame(spark, rows, extra), PIECES), PIECES).collect()
    want = []
    for row in rows:
        ids = model.encode(row[1] or "") + [model.eos_id()]
        want.append((row[0], ids, model.decode(ids)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_random_marker_texts_match_the_library():
    model, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "字", "\x00", "<s>", "</s>", "1", "😀", " ▁", "ing"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12))) for _ in range(4000)]
    flat, offsets = pieces.encode_texts(texts, PIECES)
    assert [list(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == model.encode(texts)


def test_ids_digest(spark):
    got = pieces.encode(frame(spark, [(1, "two words", None, None, 0)]), PIECES).select(
        "ids", pieces.ids_sha256(F.col("ids")).alias("h")).first()
    assert got["h"] == hashlib.sha256(" ".join(map(str, got["ids"])).encode()).hexdigest()


def test_byte_bpe_matches_the_library_on_odd_texts():
    rnd = random.Random(5)
    alphabet = ["a", "B's", " ", "  ", "\n", "12", "é", "字", "́", "<|endoftext|>", "'ll", "!?", " ", "😀", "ß"]
    for _ in range(1500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(10)))
        assert tokenizer(BYTE_BPE).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", " \t\n"])
def test_a_million_spaces_match_the_library(space):
    text = "before" + space * (1_050_000 // len(space)) + "after"
    assert tokenizer(BYTE_BPE).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (5, 3), (1000, 10), (1000, 10**6), (700, 2**60), (513, 0)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(-top, top + 1, n))
    coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert coded.values().tolist() == values.tolist() == [coded.select(i) for i in range(n)]
    for lo in range(0, n, 97):
        assert coded.slice(lo, min(n, lo + 300)).tolist() == values[lo:lo + 300].tolist()


def test_elias_fano_is_near_minimal():
    edges = np.cumsum(np.random.default_rng(1).integers(1, 4000, 20_000))
    assert len(EliasFano.of(edges).to_bytes()) * 8 / len(edges) < 2.2 + np.log2(edges[-1] / len(edges))


@pytest.mark.parametrize("extra,file_ids", [(False, 1 << 28), (True, 500)])
def test_token_files_round_trip(spark, tmp_path, extra, file_ids):
    rows = hard_documents()
    manifest = token_files.write_token_files(frame(spark, rows, extra), BYTE_BPE, f"file://{tmp_path}/ids", 0, file_ids)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in got][:2] == [True, True] and len(got) == len(rows)
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == np.cumsum([0] + [len(r["ids"]) // 4 for r in got])[:-1].tolist()
    want = Counter((row[0], library_ids(row[1], 0).tobytes()) for row in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    one = manifest.first()
    with open(one["path"].removeprefix("file://"), "rb") as f:
        size = f.seek(0, 2)
        file = token_files.TokenFile(f, size)
        assert sum(len(file.document(i)) for i in range(file.docs)) == one["ids"]


def test_token_files_of_an_empty_table(spark, tmp_path):
    manifest = token_files.write_token_files(frame(spark, []), BYTE_BPE, f"file://{tmp_path}/none", 0)
    assert token_files.read_token_files(manifest).collect() == []


@pytest.mark.parametrize("extra", [False, True])
def test_packing_places_every_id_once(spark, extra):
    rows = hard_documents() + [(100 + i, "short text " * (i % 7 + 1), "en", "s", 0) for i in range(300)]
    got = packing.pack(frame(spark, rows, extra), BYTE_BPE, 1, 256).collect()
    want = Counter()
    for row in rows:
        ids = library_ids(row[1], 1)
        for at in range(0, len(ids), 256):
            want[(row[0], at, len(ids), ids[at:at + 256].astype("<u2").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])) for r in got) == want
    assert all(r["width"] == 2 and len(r["ids"]) == 2 * r["length"] for r in got)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist()
        assert sum(p[1] for p in parts) <= 256
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_of_an_empty_table(spark):
    assert packing.pack(frame(spark, []), BYTE_BPE, 1).collect() == []


def test_packing_crc(spark):
    got = packing.pack(frame(spark, [(1, "a few words", None, None, 0)]), BYTE_BPE, 1)
    r = got.select(packing.ids_crc32(F.col("ids"), F.col("width")).alias("crc")).first()
    assert r["crc"] == zlib.crc32(library_ids("a few words", 1).tobytes())


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 40), (2, 3000), (3, 40_000)])
def test_plan_uses_every_rank_once_with_little_padding(seed, n):
    lengths = np.random.default_rng(seed).lognormal(6, 1, n).astype(int) % 2047 + 1
    counts = Counter(lengths.tolist())
    plan = packing.packing_plan(counts)
    for length, runs in plan.groupby("length"):
        at = 0
        for run in runs.sort_values("lo").itertuples():
            assert run.lo == at
            at += run.n
        assert at == counts[length]
    sequences = int((plan["sequence"] + plan["n"]).max())
    least = -(-int(lengths.sum()) // 2048)
    assert sequences <= least * 1.004 + 1


def fill_one_by_one(left, size):
    made, left = Counter(), dict(left)
    while any(left.values()):
        room, lengths = size, []
        for k in sorted(left, reverse=True):
            take = min(left[k], room // k)
            lengths += [k] * take
            room, left[k] = room - take * k, left[k] - take
        made[tuple(lengths)] += 1
    return made


def test_largest_first_fills_as_one_by_one():
    rnd = random.Random(13)
    for _ in range(300):
        size = rnd.randrange(5, 80)
        demand = {rnd.randrange(1, size + 1): rnd.randrange(0, 60) for _ in range(rnd.randrange(8))}
        made = packing.fill_largest_first(demand, size)
        assert list(made.items()) == list(fill_one_by_one(demand, size).items())


def test_largest_first_is_bounded_by_the_lengths(monkeypatch):
    steps, search = [0], packing.bisect_right

    def counted(*args):
        steps[0] += 1
        assert steps[0] <= 200_000
        return search(*args)

    monkeypatch.setattr(packing, "bisect_right", counted)
    demand = {k: 10**9 + 7919 * k for k in range(1, 1024)}
    made = packing.fill_largest_first(demand, 1024)
    used = Counter()
    for lengths, n in made.items():
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] += n
    assert used == demand


def test_fractional_patterns_cover_the_demand():
    demand = {3: 40, 5: 33, 7: 21, 11: 9}
    solved = packing.fractional_patterns(demand, 20)
    for size, need in demand.items():
        assert abs(sum(p.get(size, 0) * x for p, x in solved) - need) < 1e-6
    assert all(sum(s * k for s, k in p.items()) <= 20 for p, _ in solved)
    assert sum(x for _, x in solved) <= sum(s * n for s, n in demand.items()) / 20 * 1.05
