import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import wordpiece as wp

SF = "/root/testdata/sf0.001"


def greedy(word, vocabulary):
    """Longest match from the left, the plain way; an unmatched word is one unknown piece."""
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_on_random_vocabularies():
    r = random.Random(6)
    for _ in range(300):
        vocabulary = {tuple(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        coded = {tuple(97 + "abc".index(c) + (wp.FINAL if r.random() < 0.2 and k == len(w) - 1 else 0) for k, c in enumerate(w)) for w in vocabulary}
        automaton = wp.Automaton(coded)
        for _ in range(40):
            word = bytes(97 + r.randrange(3) for _ in range(r.randint(1, 12)))
            assert automaton.count(word) == greedy((*word[:-1], word[-1] + wp.FINAL), coded)


def test_whole_texts(spark):
    path = wp.vocabulary_path(wp.DEFAULT_VOCABULARY)
    import json

    table = wp.printable_bytes()
    vocabulary = {s for t in json.load(open(path, encoding="utf-8"))["model"]["vocab"] if (s := wp.symbols(t, table))}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).select("doc_id", "text").collect()} | {-1: "", -2: " \n", -3: "É日本x " + "Abc" * 50}
    docs = spark.createDataFrame([*texts.items(), (-4, None), (-4, None)], "doc_id long, text string").withColumn("n_words", F.lit(0))
    got = wp.count_tokens(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", texts.get(r.doc_id) or "")]
        want = 0
        for w in words:
            b = w.encode()
            want += greedy((*b[:-1], b[-1] + wp.FINAL), vocabulary)
        assert (r.n_words, r.n_tokens) == (len(words), want)
    assert wp.count_tokens(docs.limit(0)).count() == 0
    assert wp.counts(pa.array([], pa.string()), path)[0].size == 0


def test_words_with_equal_polynomial_hashes_null_ids_and_long_texts(spark):
    import json

    a, b = "ab", "ba"
    for _ in range(11):
        a, b = a + b, b + a
    path = wp.vocabulary_path(wp.DEFAULT_VOCABULARY)
    table = wp.printable_bytes()
    vocabulary = {s for t in json.load(open(path, encoding="utf-8"))["model"]["vocab"] if (s := wp.symbols(t, table))}
    texts = [f"{a} {b}", f"{b} {a} {a}", "Word " * 300_000, None, ""]
    each = {w: greedy((*w.encode()[:-1], w.encode()[-1] + wp.FINAL), vocabulary) for w in (a[:64], "word")}
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r.n_words, r.n_tokens) for r in wp.count_tokens(docs).collect())
    automaton, _ = wp._automaton(path)
    own = {w: automaton.count(w.encode()) for w in (a, b, "word")}
    assert own["word"] == each["word"] and automaton.count(a[:64].encode()) == each[a[:64]]
    assert got == sorted([(0, 0), (0, 0), (2, own[a] + own[b]), (3, 2 * own[a] + own[b]), (300_000, 300_000 * own["word"])])
