"""SentencePiece encoding and decoding by distinct marked words.

A vocabulary whose pieces never hold a white space marker after another character cannot merge across the start of a
marker run. A text is therefore the row of its marked words (a run of markers and what follows it up to the next run),
and each marked word is segmented by itself. Within a block of documents every distinct marked word goes through the
library once; the ids are joined back to the positions by the word's number in that table.

The table is one per block and not one per corpus: a corpus-wide table would have to be joined with one row per word of
text, and moving such a row costs more than segmenting the word (see README).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.frames import ids_and_texts, map_batches

MARK = "▁"
#: Bytes of text whose words share a table.
BLOCK = 8 << 20
END = "end"


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def splits_at_markers(path: str) -> bool:
    """Whether words may be segmented apart: identity normalizer, a dummy prefix, markers only at the front of pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    plain = not norm.precompiled_charsmap and not norm.normalization_rule_tsv
    return (plain and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and all(MARK not in p.piece.lstrip(MARK) and p.type != p.USER_DEFINED for p in model.pieces))


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, offsets of the texts) exactly as the library encodes each text."""
    model = _model(path)
    counts = np.zeros(len(texts), dtype=np.int64)
    # A literal marker character looks like a space to the library but not to the split below; nothing to split in "".
    odd = {i for i, t in enumerate(texts) if MARK in t} if splits_at_markers(path) else set(range(len(texts)))
    plain = [i for i, t in enumerate(texts) if t and i not in odd]
    parts: dict[int, np.ndarray] = {i: np.array(model.encode(texts[i]), dtype=np.int32) for i in odd}
    flat, owner = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    if plain:
        body = (" " + " ".join([texts[i] for i in plain])).encode("utf-8")
        data = np.frombuffer(body, dtype=np.uint8)
        sizes = np.array([len(texts[i].encode("utf-8")) for i in plain]) + 1
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts),
                                      [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])
        table = pc.dictionary_encode(words)
        code = table.indices.to_numpy(zero_copy_only=False)
        # The library puts a marker before every text it is given, so the word goes in without its first one.
        distinct = [w[1:] for w in table.dictionary.to_pylist()]
        lone = [i for i, w in enumerate(distinct) if not w]
        ids = model.encode(distinct, num_threads=1)
        for i in lone:  # a single marker: the library gives nothing for "", two markers less one otherwise
            ids[i] = [model.piece_to_id(MARK)]
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        pool = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lens.sum()))
        base = np.cumsum(lens) - lens
        size = lens[code]
        ends = np.cumsum(size)
        total = int(ends[-1])
        flat = pool[np.repeat(base[code] - (ends - size), size) + np.arange(total)]
        doc = np.searchsorted(begins, starts, "right") - 1
        per_doc = np.bincount(doc, weights=size, minlength=len(plain)).astype(np.int64)
        counts[plain] = per_doc
        owner = np.cumsum(per_doc) - per_doc
    if not odd:
        return flat, np.concatenate([[0], np.cumsum(counts)])
    where = dict(zip(plain, range(len(plain))))
    rows = []
    for i in range(len(texts)):
        row = parts.get(i)
        if row is None:
            k = where.get(i)
            row = flat[owner[k]:owner[k] + counts[i]] if k is not None else flat[:0]
        counts[i] = len(row)
        rows.append(row)
    return np.concatenate(rows) if rows else flat, np.concatenate([[0], np.cumsum(counts)])


def blocks(texts: pa.Array, most: int = BLOCK):
    """(first, one past the last) rows of runs of texts of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``; ``end`` appends the model's end id.

    Null and empty texts give the end id alone. Equal rows give equal rows; other columns are ignored; an empty table
    gives an empty one. No shuffle: a row's ids depend on its text only.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, flats, sizes = batch.column("text"), [], []
        stop = _model(model).eos_id()
        for lo, hi in blocks(texts):
            flat, offsets = encode_texts(texts.slice(lo, hi - lo).to_pylist(), model)
            n = np.diff(offsets)
            if end:
                flat = np.insert(flat, offsets[1:], stop)
                n = n + 1
            flats.append(flat)
            sizes.append(n)
        edges = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(flats), type=pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return map_batches(ids_and_texts(docs), run, "doc_id long, ids array<int>", BLOCK)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with the library's text of the ids; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = batch.column("ids"), []
        for lo in range(0, len(rows), 64):
            texts += _model(model).decode([x or [] for x in rows.slice(lo, 64).to_pylist()], num_threads=1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, pa.array(texts, type=pa.string())],
                                          ["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def ids_sha256(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space, in lowercase hex."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
