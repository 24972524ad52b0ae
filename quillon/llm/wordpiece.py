"""Token counts by a linear longest-match automaton (operator 8).

Greedy longest-match word pieces over a vocabulary trie. Each node carries a
failure link and the number of tokens popped on taking it, both precomputed,
so a word's piece count comes from one pass over its bytes, without
backtracking and without building a piece. The last byte of a word is a
symbol of its own (pieces that end a word differ from inner ones).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .bpe_tree import vocabulary_path
from .pretok import distinct_spans
from .textblocks import LOWER_BYTE, chunks, small_batches, sum_by_row, word_spans

DEFAULT_VOCABULARY = "word_bpe_49k.json"
FINAL = 256
#: Words that the cache holds at most, and bytes of the longest of them.
_CACHE_LIMIT, _CACHED_BYTES = 400_000, 64


def printable_bytes() -> dict[str, int]:
    """Byte of each character by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def symbols(token: str, table: dict[str, int]) -> tuple[int, ...] | None:
    """Symbols of a vocabulary entry, None for entries that are no byte strings (special tokens)."""
    ends = token.endswith("</w>")
    body = token[:-4] if ends else token
    if not body or any(c not in table for c in body):
        return None
    out = [table[c] for c in body]
    return (*out[:-1], out[-1] + FINAL) if ends else tuple(out)


class Automaton:
    """Trie over symbol strings with failure links and popped-token counts."""

    def __init__(self, vocabulary: set[tuple[int, ...]]):
        self.child: dict[int, int] = {}
        parent, by, depth, token = [-1], [0], [0], [False]
        for word in sorted(vocabulary):
            node = 0
            for s in word:
                nxt = self.child.get(node << 9 | s)
                if nxt is None:
                    nxt = self.child[node << 9 | s] = len(parent)
                    parent.append(node)
                    by.append(s)
                    depth.append(depth[node] + 1)
                    token.append(False)
                node = nxt
            token[node] = True
        self.fail, self.pops = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if token[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, popped = self.fail[parent[v]], self.pops[parent[v]]
            while z >= 0 and self.child.get(z << 9 | by[v]) is None:
                popped, z = popped + self.pops[z], self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.child[z << 9 | by[v]], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; one, the unknown piece, where no segmentation is reached."""
        child, fail, pops = self.child, self.fail, self.pops
        node, total, last = 0, 0, len(word) - 1
        for i, b in enumerate(word):
            s = b + FINAL if i == last else b
            while (nxt := child.get(node << 9 | s)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else 1


_loaded: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def _automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    if path not in _loaded:
        table = printable_bytes()
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        _loaded[path] = Automaton({s for t in entries if (s := symbols(t, table))}), {}
    return _loaded[path]


def counts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(words, pieces) of each text; A-Z count as lower case."""
    automaton, cache = _automaton(path)
    words, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, j, buf, offsets in chunks(texts):
        starts, ends, first = word_spans(buf, offsets)
        if not len(starts):
            continue
        at, inverse = distinct_spans(buf, starts, ends, lower=True)
        if len(cache) > _CACHE_LIMIT:
            cache.clear()
        data = LOWER_BYTE[buf].tobytes()
        size = []
        for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            word = data[a:b]
            n = cache.get(word)
            if n is None:
                n = automaton.count(word)
                if len(word) <= _CACHED_BYTES:
                    cache[word] = n
            size.append(n)
        words[i:j], pieces[i:j] = np.diff(first), sum_by_row(np.array(size, np.int64)[inverse], first)
    return words, pieces


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """key, n_words, n_tokens of every whole text.

    Words are separated by ASCII white space. Null and empty texts have none;
    repeated rows repeat; extra columns are dropped.
    """
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)
    small_batches(docs.sparkSession)

    def measure(texts: pa.Array) -> pa.Array:
        words, pieces = counts(texts.fill_null(""), path)
        return pa.StructArray.from_arrays([pa.array(words), pa.array(pieces)], ["w", "p"])

    udf = F.arrow_udf(measure, "w long, p long")
    return docs.select(docs[key].alias("k"), udf(docs[text]).alias("n")).select(F.col("k").alias(key), F.col("n.w").alias("n_words"), F.col("n.p").alias("n_tokens"))


def op8_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
