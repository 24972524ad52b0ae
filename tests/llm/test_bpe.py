import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe_tree
from quillon.llm.pretok import piece_starts
from quillon.llm.textblocks import flat

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
AWKWARD = ["", " ", "  ", "a", " a", "don't we'll 'sam ' 's ''s 'REs", "a\n\n b \n", " 　x　 y", "tab\t\tx", "x" * 3000, "ab" * 700 + "é" * 500, "1234567", "日本語テキスト 𝒳𝒴", "!?!? (\"'s\")", "é́", "\x1c\x1d a\x85b", "<|endoftext|>", "'s's'", "a's'tand 'velvet"]


def encoder():
    return bpe_tree._encoder(PATH)


def tokens(texts):
    buf, offsets = flat(pa.array(texts, pa.string()))
    ids, first = encoder()[1].tokens(buf, offsets)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_pieces_and_ids_equal_the_public_library():
    for text, ids in zip(AWKWARD, tokens(AWKWARD)):
        assert ids == OWN.encode_ordinary(text), text
        assert encoder()[0].decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    assert tokens(texts) == [OWN.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinrst é中'", min_size=1, max_size=400))
def test_tree_equals_plain_merging(text):
    bpe = encoder()[0]
    data = text.replace(" ", "_").encode()
    assert bpe.reduce(data) == OWN._encode_single_piece(data) or data in RANKS


def test_long_runs_of_random_letters():
    r = random.Random(1)
    for n in (100, 1000, 20_000):
        data = "".join(r.choice("abcdefghij") for _ in range(n)).encode()
        assert encoder()[0].reduce(data) == OWN._encode_single_piece(data)


def test_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(99, None), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", __import__("pyspark").sql.functions.lit(1))
    got = {r.doc_id: r for r in bpe_tree.encode(docs, digests=True).collect()}
    for i, t in rows:
        ids = OWN.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe_tree.decode(bpe_tree.encode(docs)).collect()
    assert len(back) == len(rows) and all(bytes(r.bytes).decode() == (dict(rows)[r.doc_id] or "") for r in back)
    assert bpe_tree.encode(docs.limit(0), digests=True).count() == 0


def thue_morse(n=11):
    """Two different strings of 2**(n + 1) letters that polynomial hashes modulo a power of two cannot tell apart."""
    a, b = "ab", "ba"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_pieces_with_equal_polynomial_hashes_and_long_texts(spark):
    a, b = thue_morse()
    long = " ".join(f"w{i % 997}é" for i in range(200_000))  # beyond a chunk
    texts = [a, b, f"{a} {b}", f"{b} {a}", long, None]
    assert tokens([t or "" for t in texts]) == [OWN.encode_ordinary(t or "") for t in texts]
    docs = spark.createDataFrame([(None if k < 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = sorted((len(ids := OWN.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in texts)
    assert sorted(tuple(r)[1:] for r in bpe_tree.encode(docs, digests=True).collect()) == want


def test_generations_keep_pieces_apart():
    from quillon.llm.pretok import PieceTable

    table = PieceTable(encoder()[0].encode_pieces, limit=5)
    for text in ["one two three four five six seven", "eight nine one", "two ten one", "one one eleven twelve thirteen fourteen"] * 3:
        buf, offsets = flat(pa.array([text]))
        assert table.tokens(buf, offsets)[0].tolist() == OWN.encode_ordinary(text)
    assert len(table.young.index) + len(table.old.index) < 30
