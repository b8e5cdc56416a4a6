"""Words and word shingles of Arrow text batches as 64-bit hashes, whole batches at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. Texts are worked on in windows of about `WINDOW` bytes, so that memory follows the window and not the longest
text; only the hashes of a text's words (8 bytes each) are held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 19
SHINGLE = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = _SPACE.copy()
_BREAK[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = True
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n - 1) modulo 2**64, kept for the next window."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, WINDOW + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * WINDOW:
            _powers[int(base)] = have
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array and the offsets of its texts in them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, dtype=np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def windows(data: np.ndarray, offsets: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, offsets) of runs of texts of about ``most`` bytes; a longer text comes in pieces cut at white space."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        if last > first + 1 or offsets[last] - offsets[first] <= most:
            yield first, offsets[first:last + 1]
        else:
            at, end = int(offsets[first]), int(offsets[last])
            while at < end:
                cut = min(at + most, end)
                while cut < end:
                    gaps = np.flatnonzero(_SPACE[data[cut:min(cut + 4096, end)]])
                    if len(gaps):
                        cut += int(gaps[0])
                        break
                    cut = min(cut + 4096, end)
                yield first, np.array([at, cut], dtype=np.int64)
                at = cut
        first = last


def _hashed_words(texts: pa.Array, gaps: np.ndarray, prefixes: tuple[int, ...]):
    data, offsets = text_bytes(texts)
    for first, offs in windows(data, offsets):
        lo, hi = int(offs[0]), int(offs[-1])
        if hi == lo:
            continue
        part = data[lo:hi]
        word = ~gaps[part]
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offs - lo] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if not len(starts):
            continue
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _power(_BASE, hi - lo), out=total[1:])
        from_start = total[starts]
        scale = _power(_BACK, hi - lo)[starts]
        made = [mixed((total[ends] - from_start) * scale + (ends - starts).astype(np.uint64))]
        for k in prefixes:
            cut = np.minimum(starts + k, ends)
            made.append(mixed((total[cut] - from_start) * scale + np.uint64(1_000_003 * k)))
        yield first + np.searchsorted(offs - lo, starts, "right") - 1, made


def located_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray, breaks: np.ndarray | None = None,
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, piece, start, end, hash) of every word of the texts in ``data``; bytes of ``gaps`` part words, and those
    of ``breaks``, which are gaps too, part pieces. Words of one text and piece may stand next to each other."""
    out: list[tuple[np.ndarray, ...]] = []
    passed = 0
    for first, offs in windows(data, offsets):
        lo, hi = int(offs[0]), int(offs[-1])
        if hi == lo:
            continue
        part = data[lo:hi]
        word = ~gaps[part]
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offs - lo] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        broken = np.flatnonzero(breaks[part]) if breaks is not None else np.zeros(0, dtype=np.int64)
        if len(starts):
            total = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * _power(_BASE, hi - lo), out=total[1:])
            value = (total[ends] - total[starts]) * _power(_BACK, hi - lo)[starts] + (ends - starts).astype(np.uint64)
            out.append((first + np.searchsorted(offs - lo, starts, "right") - 1, passed + np.searchsorted(broken, starts),
                        starts + lo, ends + lo, mixed(value)))
        passed += len(broken)
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word of every text, in order."""
    done = list(_hashed_words(texts, _SPACE, ()))
    if not done:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([d for d, _ in done]), np.concatenate([h[0] for _, h in done])


def term_hashes(texts: pa.Array, prefixes: tuple[int, ...] = (), bare: bool = True,
                ) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Window by window: text indexes, and the hashes of the words and of their first bytes, one array for each length
    in ``prefixes``. ``bare``: ASCII punctuation parts words as white space does."""
    yield from _hashed_words(texts, _BREAK if bare else _SPACE, prefixes)


def bounds(docs: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts begins among rows sorted by text, with the end as a last entry."""
    return np.searchsorted(docs, np.arange(n + 1))


def shingle_hashes(docs: np.ndarray, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all word shingles, repeats included; a text of fewer words is one shingle as a whole."""
    out_docs, out = [], []
    if len(words) >= size:
        n = len(words) - size + 1
        value = words[:n] * _PLACE[0]
        for k in range(1, size):
            value += words[k:k + n] * _PLACE[k]
        whole = docs[:n] == docs[size - 1:]
        out_docs.append(docs[:n][whole])
        out.append(mixed(value[whole]))
    if len(words):
        edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))
        counts = np.diff(edges)
        for k in range(1, size):
            at = edges[:-1][counts == k]
            if len(at):
                value = np.full(len(at), k, dtype=np.uint64)
                for j in range(k):
                    value += words[at + j] * _PLACE[j]
                out_docs.append(docs[at])
                out.append(mixed(value))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    all_docs, all_hashes = np.concatenate(out_docs), np.concatenate(out)
    order = np.argsort(all_docs, kind="stable")
    return all_docs[order], all_hashes[order]


def distinct_by_text(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by text and hash; ``docs`` comes sorted."""
    hashes = hashes.copy()
    edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]])) if len(docs) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1], edges[1:]):
        hashes[lo:hi].sort()
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]
