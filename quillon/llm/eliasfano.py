"""Elias-Fano sequences and an n-gram trie over them.

A monotone sequence of n values below u keeps floor(log2(u / n)) low bits of
each value plainly and the high bits in unary. `TrieShard` is two such levels:
sorted context hashes with a monotone pointer to each one's range, and the
successors of all contexts as one sequence made monotone by adding
context index * 2**40. A deeper level is one more, without hashes: its contexts
are the positions of the successors in the level above. All arrays lie in one buffer that a file or an
anonymous memory map can hold.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
SUCCESSOR_BITS = 40


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, packed into 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = shift + U(width) > U(64)  # one value a word at most reaches into the next
        out[word[over] + 1] |= values[over] >> (U(64) - shift[over])
    return out


def _read(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * U(width)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    low = words[word] >> shift
    high = np.where(shift > U(0), words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


#: Position of the k-th set bit of each byte.
_IN_BYTE = np.zeros((256, 8), np.uint64)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    _IN_BYTE[_byte, : len(_set)] = _set


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word."""
    at, k = np.zeros(len(word), np.uint64), k.astype(np.int64).copy()
    for size in (32, 16, 8):
        low = np.bitwise_count((word >> at) & U((1 << size) - 1)).astype(np.int64)
        go = k >= low
        k -= np.where(go, low, 0)
        at += np.where(go, U(size), U(0))
    return (at + _IN_BYTE[((word >> at) & U(255)).astype(np.int64), np.clip(k, 0, 7)]).astype(np.int64)


class EliasFano:
    """A monotone sequence of unsigned integers below 2**62."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.zeros_before = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        self.ones_before = np.arange(len(high) + 1) * 64 - self.zeros_before

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        upper = (values >> U(low_bits)).astype(np.int64)
        unary = np.zeros(((n + (int(upper[-1]) if n else 0)) // 64 + 2) * 64, np.uint8)
        unary[upper + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        return cls(n, low_bits, _bits(values & U((1 << low_bits) - 1), low_bits), high)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) zero of the high part."""
        word = np.searchsorted(self.zeros_before, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros_before[word])

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        index = np.asarray(index, np.int64)
        word = np.searchsorted(self.ones_before, index, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], index - self.ones_before[word])
        return ((at - index).astype(np.uint64) << U(self.low_bits)) | _read(self.low, index, self.low_bits)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Position of the first element >= each value (n where there is none)."""
        values = np.asarray(values, np.uint64)
        upper = (values >> U(self.low_bits)).astype(np.int64)
        zeros = int(self.zeros_before[-1])
        inside = upper < zeros
        u = np.where(inside, upper, 0)
        left = np.where(u > 0, self._zero(np.maximum(u - 1, 0)) - (u - 1), 0)
        right = np.minimum(self._zero(u) - u, self.n)
        left = np.minimum(left, right)
        want = values & U((1 << self.low_bits) - 1)
        while (open_ := left < right).any():  # binary search among equal high parts
            middle = (left + right) >> 1
            less = open_ & (_read(self.low, np.minimum(middle, max(self.n - 1, 0)), self.low_bits) < want)
            left = np.where(less, middle + 1, left)
            right = np.where(open_ & ~less, middle, right)
        return np.where(inside, left, self.n)


class TrieShard:
    """Contexts and their successors with a one-byte code each, in one mapped buffer."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 12)
        self.buffer, at, parts = buffer, 12 * 8, []
        for k, kind in enumerate((np.uint64, np.uint64, np.uint64, np.uint64, np.uint64, np.uint8)):
            parts.append(np.frombuffer(buffer, kind, int(head[k]), at))
            at += -(-int(head[k]) * np.dtype(kind).itemsize // 8) * 8
        self.contexts, self.codes = parts[0], parts[5]
        self.pointers = EliasFano(int(head[6]), int(head[7]), parts[1], parts[2])
        self.successors = EliasFano(int(head[8]), int(head[9]), parts[3], parts[4])

    @classmethod
    def build(cls, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> TrieShard:
        """From sorted distinct contexts (none in a deeper level), the start of each one's range (n + 1) and its sorted successors."""
        owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
        p, s = EliasFano.build(starts.astype(np.uint64)), EliasFano.build((owner << U(SUCCESSOR_BITS)) | successors)
        arrays = (contexts, p.low, p.high, s.low, s.high, codes)
        head = np.array([*map(len, arrays), p.n, p.low_bits, s.n, s.low_bits, 0, 0], np.int64)
        size = head.nbytes + sum(-(-a.nbytes // 8) * 8 for a in arrays)
        buffer, at = mmap.mmap(-1, size), head.nbytes
        buffer[:at] = head.tobytes()
        for a in arrays:
            buffer[at : at + a.nbytes] = np.ascontiguousarray(a).tobytes()
            at += -(-a.nbytes // 8) * 8
        return cls(buffer)

    @classmethod
    def open(cls, path: str) -> TrieShard:
        """Map a shard that `save` wrote."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.buffer)

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context index or -1, code of the successor in that context or 0)."""
        if not len(self.contexts) or not len(self.codes):
            return np.full(len(contexts), -1), np.zeros(len(contexts), np.uint8)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        known = self.contexts[at] == contexts
        pos = self.child(np.where(known, at, -1), successors)
        return np.where(known, at, -1), np.where(pos >= 0, self.codes[pos], 0).astype(np.uint8)

    def child(self, at: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Position of each successor in the range of the context with index `at` (-1 where either is absent): its context index one level deeper."""
        if not len(self.codes):
            return np.full(len(at), -1)
        own = np.maximum(at, 0)
        want = (own.astype(np.uint64) << U(SUCCESSOR_BITS)) | successors
        pos = self.successors.successor(want)
        inside = np.minimum(pos, len(self.codes) - 1)
        hit = (at >= 0) & (pos < len(self.codes)) & (inside < self.pointers.get(own + 1).astype(np.int64))
        hit &= self.successors.get(inside) == want
        return np.where(hit, inside, -1)
