"""Vectorised pre-tokeniser for byte-level BPE, and a piece cache.

Splits UTF-8 text at the matches of the public byte-level BPE pattern
(contractions, letters, numbers, other characters each with one optional
leading space, white space) with array operations on bytes. The matches of a
row cover it without gaps, so only their starts are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textblocks import equal_spans, hash_spans

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point (built once in a process)."""
    if not _classes:
        import regex

        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = char_classes()
    ascii_table = np.zeros(256, np.uint8)
    ascii_table[:128] = table[:128]
    out = ascii_table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.uint32)
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        c1, c2, c3 = (padded[lead + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
        point = np.where(two, (b & 0x1F) << 6 | c1, np.where(three, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        out[lead + 1] = kind
        long = lead[b >= 0xE0]
        out[long + 2] = kind[b >= 0xE0]
        out[lead[b >= 0xF0] + 3] = kind[b >= 0xF0]
    return out


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of each pattern match, over all rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kinds = byte_classes(buf)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    begins = np.ones(n, bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins |= row_start[:n]
    rs = np.flatnonzero(begins)
    re = np.append(rs[1:], n)
    kind = kinds[rs]
    joined = ~row_start[re]  # the next run is in the same row
    space = np.flatnonzero((kind == SPACE) & joined)
    if len(space):  # the last white-space character before other text stands alone or leads the next piece
        last = re[space] - 1
        for _ in range(3):
            inner = (buf[last] & 0xC0) == 0x80
            if not inner.any():
                break
            last = last - inner
        begins[last] = True
        attach = buf[last] == 0x20
        begins[re[space[attach]]] = False
    quote = np.flatnonzero((kind == OTHER) & (re - rs == 1) & joined)
    quote = quote[(buf[rs[quote]] == 0x27) & begins[rs[quote]]]
    quote = quote[kind[quote + 1] == LETTER] if len(quote) else quote
    for q in quote.tolist():
        a, b = int(re[q]), int(re[q + 1])
        first, second = int(buf[a]), int(buf[a + 1]) if a + 1 < b else 0
        size = 1 if first in b"stmd" else 2 if (first, second) in ((114, 101), (118, 101), (108, 108)) else 0
        if size:
            begins[a] = False
            if a + size < b:
                begins[a + size] = True
    return np.flatnonzero(begins)


class Generation:
    """Ids of pieces, end to end, and where each piece's begin."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        """Slot of each piece, -1 for an unknown one."""
        known = self.index.get
        return np.array([known(p, -1) for p in pieces], np.int64)

    def add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.index), len(pieces)
        while k + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.size[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.held += sum(map(len, pieces))
        self.index.update(zip(pieces, range(k, k + n), strict=True))

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in these slots, end to end, how many each has)."""
        size = self.size[slots]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class PieceTable:
    """Ids of each distinct piece, computed by `encode(pieces) -> (ids of all, ids a piece)` where they are not held.

    Pieces are told apart by their bytes: within a chunk, hashes only propose
    equal ones. Two generations of at most `limit` pieces, or `byte_limit` of
    their bytes, and a chunk's are held: when the younger is full it becomes
    the older, and what is met again moves to the younger.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 180_000, byte_limit: int = 8 << 20):
        self.encode, self.limit, self.byte_limit = encode, limit, byte_limit
        self.young, self.old = Generation(), Generation()

    def tokens(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row (n + 1))."""
        starts = piece_starts(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(buf))
        at, inverse = distinct_spans(buf, starts, ends)
        data = buf.tobytes()
        pieces = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(self.young.index) > self.limit or self.young.held > self.byte_limit:
            self.young, self.old = Generation(), self.young
        slots = self.young.slots(pieces)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = list(dict.fromkeys([pieces[k] for k in missing.tolist()]))
            before = self.old.slots(new)
            met = np.flatnonzero(before >= 0)
            self.young.add([new[k] for k in met.tolist()], *self.old.ids(before[met]))
            rest = [new[k] for k in np.flatnonzero(before < 0).tolist()]
            if rest:
                self.young.add(rest, *self.encode(rest))
            slots[missing] = self.young.slots([pieces[k] for k in missing.tolist()])
        ids, size = self.young.ids(slots[inverse])
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index of one span of each distinct byte string, which of those each span is); bytes are compared, not hashes alone."""
    _, at, inverse = np.unique(hash_spans(buf, starts, ends, lower), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~equal_spans(buf, starts, ends, at[inverse], lower))
    if len(odd):  # spans that share their hash with another string stand for themselves
        inverse[odd] = len(at) + np.arange(len(odd))
        at = np.append(at, odd)
    return at, inverse
