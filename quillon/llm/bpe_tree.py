"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 7).

Encodings form a monoid under "concatenate the bytes, encode": a piece is cut
in halves, the halves are encoded recursively, and neighbours are joined by
re-encoding a window of tokens round the seam. The window grows until the
tokens outside it provably stay as they are: a token sequence is the BPE
encoding of its bytes exactly if each adjacent pair encodes to itself, so a
window may close once the pairs across both its edges do. Decoding
concatenates byte strings up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from .pretok import PieceTable
from .textblocks import chunks, column, small_batches

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces up to this many bytes are leaves of the tree.
LEAF_BYTES = 6
_MEMO_LIMIT = 200_000


class TreeBpe:
    """Encoder and decoder over a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._merged: dict[bytes, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str) -> TreeBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short string: merge the adjacent pair of lowest rank, leftmost first, until none is known."""
        if (known := self._merged.get(data)) is not None:
            return known
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = [ranks[p] for p in parts]
        if len(data) <= 24:
            if len(self._merged) >= _MEMO_LIMIT:
                self._merged.clear()
            self._merged[data] = out
        return out

    def holds(self, a: int, b: int) -> bool:
        """Whether the adjacent tokens a, b encode to themselves."""
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) >= _MEMO_LIMIT:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left or right
        if self.holds(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(self.bytes_of[t] for t in left[-i:] + right[:j]))
            left_ok = i == len(left) or self.holds(left[-i - 1], window[0])
            right_ok = j == len(right) or self.holds(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            if not left_ok:
                i = min(len(left), 2 * i)
            if not right_ok:
                j = min(len(right), 2 * j)

    def reduce(self, data: bytes) -> list[int]:
        """Tree reduction of one piece."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pattern match: a match that is a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.reduce(data)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and how many each has."""
        each = [self.encode_piece(p) for p in pieces]
        sizes = np.array([len(x) for x in each], np.int64)
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree (leaves of 4,096 ids)."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_encoders: dict[str, tuple[TreeBpe, PieceTable, list[str]]] = {}


def _encoder(path: str) -> tuple[TreeBpe, PieceTable, list[str]]:
    """One encoder a worker process; its memory is bounded by the vocabulary and the piece table's limit."""
    if path not in _encoders:
        bpe = TreeBpe.from_file(path)
        decimals = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        _encoders[path] = bpe, PieceTable(bpe.encode_pieces), decimals
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """Ids of every whole text, one row a document.

    Returns key, ids (array of int), or with `digests` key, n_tokens,
    ids_sha256, decoded_sha256 (the last from decoding the ids again).
    Null and empty texts have no ids; other columns of `docs` are dropped;
    repeated rows stay repeated. The vocabulary file is read on each worker
    and must be installed there.
    """
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table, decimals = _encoder(path)
        for batch in batches:
            for i, j, buf, offsets in chunks(column(batch, "t")):
                ids, first = table.tokens(buf, offsets)
                keys = batch.column(0).slice(i, j - i)
                if not digests:
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))], ["k", "ids"])
                    continue
                each = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
                sha = [hashlib.sha256(",".join([decimals[t] for t in x]).encode()).hexdigest() for x in each]
                back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in each]
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(first)), pa.array(sha), pa.array(back)], ["k", "n", "a", "b"])

    picked = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    if digests:
        return picked.mapInArrow(run, f"k {kind}, n long, a string, b string").toDF(key, "n_tokens", "ids_sha256", "decoded_sha256")
    return picked.mapInArrow(run, f"k {kind}, ids array<int>").toDF(key, "ids")


def decode(tokens: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Bytes of each row's ids (null ids: empty); the inverse of `encode`."""
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)
    small_batches(tokens.sparkSession)
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)[0]
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["k", "bytes"])

    return tokens.select(tokens[key].alias("k"), tokens[ids].alias("i")).mapInArrow(run, f"k {kind}, bytes binary").toDF(key, "bytes")


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), digests=True)
