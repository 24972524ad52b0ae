"""Queries without SQL, against plain Python over the whole small tables."""

import difflib
import hashlib
import json
import re
import unicodedata
from collections import Counter

from quillon.functions.tokens import porter
from quillon.operators import jobs
from quillon.plans import catalog, corpus, documents, logs, records  # noqa: F401

SF = "/root/testdata/sf0.001"


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def rows(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_nfkc(spark):
    change = str.maketrans(jobs.REPLACEMENTS)
    want = {d: t and hashlib.md5(unicodedata.normalize("NFKC", t).translate(change).encode()).hexdigest() for d, t in table(spark, "documents", "doc_id", "text")}
    assert {r.doc_id: r.h for r in rows(spark, "nfkc_normalise")} == want


def test_stems(spark):
    words = {d: {w.lower() for w in re.findall(r"\w+", t or "")} for d, t in table(spark, "documents", "doc_id", "text")}
    want = Counter(s for own in words.values() for s in set(map(porter, own)) if len(s) >= 2 and not s.isnumeric())
    assert {r.stem: r.n_docs for r in rows(spark, "porter_stems")} == want


def turns(spark):
    out = {}
    for c, t, role, text in sorted(table(spark, "conversations", "conv_id", "turn", "role", "text"), key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((t, role, text))
    return out


def test_line_diffs(spark):
    want = []
    for c, own in turns(spark).items():
        for (t, _, a), (_, _, b) in zip(own, own[1:]):
            x, y = ([s for s in (v or "").split("\n") if s.strip()] for v in (a, b))
            changed = [o for o in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if o[0] != "equal"]
            want.append((c, t, sum(o[2] - o[1] + o[4] - o[3] for o in changed)))
    got = sorted((json.loads(r.pair)["conv_id"], json.loads(r.pair)["turn"], r.n_diffs) for r in rows(spark, "line_diffs"))
    # difflib's unified diff drops what its junk heuristic calls popular only in long texts; these are short
    assert got == sorted(want)


def test_section_sequences(spark):
    got = {}
    for r in rows(spark, "section_sequence_diff"):
        got.setdefault(r.conv_id, []).append((r.op, r.a0, r.a1, r.b0, r.b1))
    for c, own in turns(spark).items():
        roles = [role for _, role, _ in own]
        want = (["user", "assistant"] * len(roles))[: len(roles)]
        rebuilt = [x for op, a0, a1, b0, b1 in sorted(got[c], key=lambda o: (o[1], o[3])) for x in (roles[a0:a1] if op == "equal" else want[b0:b1])]
        assert rebuilt == want, c


def test_layout_finds_every_turn(spark):
    got = {(r.doc, r.section_ord): (r.found_page, r.issue) for r in rows(spark, "layout_match")}
    assert got and all(page == 1 and issue is None for page, issue in got.values())
    assert len(got) == len({(c, t) for c, own in turns(spark).items() for t, _, text in own if text is not None})


def test_extraction(spark):
    for r in rows(spark, "extraction_ops"):
        d = json.loads(r.extracted)
        assert d["metadata"].keys() == {"brand", "type"} and [b["marker"] for b in d["bullets"]] == ["\\itemi", "\\itemi"]
        assert d["bullets"][1] == {"marker": "\\itemi", "latex_raw": "5\\% off", "plaintext": "5% off"} and r.kind == "work_history"
