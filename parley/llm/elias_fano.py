"""Elias-Fano code of a non-decreasing row of numbers, with a select structure for single values.

Of n values up to u, the low bits (about log2(u / n) of each) are packed side by side; the high parts are written in
unary, so value i is the position of the i-th one, less i. That is about 2 + log2(u / n) bits a value. Every
`SAMPLE`-th one's position is kept (32 bits: a row holds up to 2**30 values), so a single value is found by counting the ones of a few words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_RUN = 1 << 14
_HEAD = struct.Struct("<qqqqq")


class EliasFano:
    def __init__(self, n: int, low_bits: int, first: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.first, self.low, self.high, self.samples = n, low_bits, first, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values`` are 64-bit integers in non-decreasing order; the first one is kept apart."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        first = int(values[0]) if n else 0
        rest = values.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)
        top = int(rest[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        if low_bits:
            # In runs of rows, each of whole bytes: a value a bit takes 64 times the room of the code.
            places = np.arange(low_bits, dtype=np.uint64)
            packed = np.concatenate([np.packbits(((rest[lo:lo + _RUN, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(),
                                                 bitorder="little") for lo in range(0, n, _RUN)])
            low = np.zeros(-(-len(packed) // 8) * 8 + 8, dtype=np.uint8)
            low[:len(packed)] = packed
        else:
            low = np.zeros(8, dtype=np.uint8)
        return cls(n, low_bits, first, low.view("<u8"), high, ones[::SAMPLE].astype("<u4"))

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.slice(0, self.n)

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Values lo … hi - 1; only the words that hold them are opened."""
        if hi <= lo:
            return np.zeros(0, dtype=np.int64)
        begin, stop = int(self.samples[lo // SAMPLE]), -(-hi // SAMPLE)
        word = begin // 64
        last = int(self.samples[stop]) // 64 + 1 if stop < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[word:last].view(np.uint8), bitorder="little")) + word * 64
        at = np.searchsorted(ones, begin) + lo - lo // SAMPLE * SAMPLE
        index = np.arange(lo, hi)
        return self._joined(ones[at:at + hi - lo] - index, index)

    def select(self, i: int) -> int:
        """Value i from the select structure: a sampled position, then a count of ones word by word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        begin, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = begin // 64
        value = int(self.high[word]) >> (begin % 64) << (begin % 64)
        while left >= (ones := value.bit_count()):
            left -= ones
            word += 1
            value = int(self.high[word])
        for _ in range(left):
            value &= value - 1
        at = word * 64 + (value & -value).bit_length() - 1
        return int(self._joined(np.array([at - i]), np.array([i]))[0])

    def _joined(self, high: np.ndarray, index: np.ndarray) -> np.ndarray:
        low = np.zeros(len(index), dtype=np.uint64)
        if self.low_bits:
            bit = index.astype(np.int64) * self.low_bits
            word, shift = bit // 64, (bit % 64).astype(np.uint64)
            low = self.low[word] >> shift
            carry = shift > np.uint64(0)
            low[carry] |= self.low[word[carry] + 1] << (np.uint64(64) - shift[carry])
            low &= np.uint64((1 << self.low_bits) - 1)
        total = (high.astype(np.uint64) << np.uint64(self.low_bits)) | low
        return (total + np.uint64(self.first & (1 << 64) - 1)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low_bits, self.first, len(self.low), len(self.high))
        return b"".join([head, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, first, low, high = _HEAD.unpack_from(data)
        at = _HEAD.size
        return cls(n, low_bits, first, np.frombuffer(data, "<u8", low, at), np.frombuffer(data, "<u8", high, at + 8 * low),
                   np.frombuffer(data, "<u4", -(-n // SAMPLE), at + 8 * (low + high)))
