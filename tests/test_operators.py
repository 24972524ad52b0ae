"""Small literal inputs with hand-derived results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import latex
from quillon.functions import text as T
from quillon.functions.tokens import CorpusStore, Tokenizer, porter
from quillon.operators import compare, events, items, jobs, layout, registry, reports, stats, windows
from quillon.operators.extraction import Extractor, infer_section_type
from quillon.sources import readers
from quillon.streaming import registry_stream


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_co_occurrence_counts_positions(spark):
    df = spark.createDataFrame([("d1", 0, "A"), ("d1", 1, "A"), ("d1", 2, "B"), ("d2", 0, "B")], "d string, p int, n string")
    assert rows(stats.co_occurrence(df, "d", "p", "n"), "name_a", "name_b", "n") == [("A", "A", 2), ("A", "B", 2), ("B", "A", 2)]
    assert rows(stats.prevalence(df, "d", "n"), "n", "n_docs") == [("A", 1), ("B", 2)]


def test_titles_and_keywords(spark):
    df = spark.createDataFrame([("d", "X | Y |  | X")], "d string, t string")
    parts = stats.title_components(df, "d", "t", r"\|")
    assert rows(parts, "position", "component") == [(0, "X"), (1, "Y"), (2, "X")]
    docs = spark.createDataFrame([("Abc abc",), (None,), ("x",)], "t string")
    assert rows(stats.keyword_counts(docs, "t", ["ABC", "none"]), "keyword", "n_docs", "n_occurrences") == [("ABC", 1, 2), ("none", 0, 0)]
    assert rows(stats.search_field(docs, "t", ["ABC", "%"]), "pattern", "n") == [("%", 0), ("ABC", 1)]


def sections(spark):
    sub = [("work_experience", None, "Firm", "Boss", "2020", ["w1"], [("P", ["p1", "p2"])]), ("work_experience", None, "Other", "Dev", "2021", [], None)]
    branch = [("project", "Q", None, None, None, ["q1"], None), ("skill_category", "Tools", None, None, None, ["hammer"], None)]
    data = [("r", 1, "p", 1, "Skills", "skill_list_caps", ["a", "b"], None), ("r", 1, "p", 2, "Work", "work_history", None, sub), ("r", 1, "p", 3, "Mixed", "projects", None, branch), ("r", 1, "p", 4, "School", "education", ["x"], None)]
    return spark.createDataFrame(data, items.SECTION_SCHEMA)


def test_items_flatten_and_store(spark, tmp_path):
    store = items.ItemStore.build(sections(spark), str(tmp_path / "items"))
    got = rows(store.items, "id", "section_type", "subsection_name", "subsection_type", "item_text", "item_order", "company", "job_title", "project_name")
    assert got == [
        (1, "skill_list_caps", None, None, "a", 0, None, None, None), (2, "skill_list_caps", None, None, "b", 1, None, None, None),
        (3, "work_history", "Firm", "work_experience", "w1", 0, "Firm", "Boss", None), (4, "work_history", "Firm", "project", "p1", 0, "Firm", "Boss", "P"), (5, "work_history", "Firm", "project", "p2", 1, "Firm", "Boss", "P"),
        (6, "projects", "Q", "project", "q1", 0, None, None, "Q"), (7, "projects", "Tools", "skill_category", "hammer", 0, None, None, None),
    ]
    assert rows(store.query("SELECT item_text FROM items WHERE item_text ILIKE ? AND section_type IN (?, ?)", ["%P%", "work_history", "x"]), "item_text") == [("p1",), ("p2",)]
    assert store.by_section_type().count() == 0 and store.skills().count() == 2 and store.bullets().count() == 5
    with pytest.raises(FileNotFoundError):
        items.ItemStore.open(spark, str(tmp_path / "none"))


LOG = [(1, "2026-01-01", "registration", "a", "historical", "raw", None, None), (2, "2026-01-02", "status_change", "a", None, None, "raw", "parsed"), (3, "2026-01-03", "logged_activity", "a", None, None, None, None), (4, "2026-01-03", "registration", "b", "test", "raw", None, None)]
LOG_SCHEMA = "log_order long, timestamp string, event_type string, resume_name string, resume_type string, status string, old_status string, new_status string"


def test_events(spark):
    log = spark.createDataFrame(LOG, LOG_SCHEMA)
    assert rows(events.reconstruct(log), "resume_name", "status", "last_updated") == [("a", "parsed", "2026-01-02"), ("b", "raw", "2026-01-03")]
    swapped = log.withColumn("timestamp", F.when(F.col("log_order") == 2, "2025-01-01").otherwise(F.col("timestamp")))
    with pytest.raises(ValueError):
        events.reconstruct(swapped)
    assert [r.log_order for r in events.recent(log, ["log_order"], 2).collect()] == [3, 4]
    assert events.recent(log, ["log_order"], 0).count() == 4 and events.recent(log, ["log_order"], 9, event_type="registration").count() == 2
    changes = spark.createDataFrame([("x", 1, "a", "b"), ("x", 2, "c", "d")], "k string, o int, old_status string, new_status string")
    assert rows(events.discontinuities(changes, "k", "o"), "place", "expected", "old_status") == [(1, "b", "c")]


def test_registry(spark):
    existing = spark.createDataFrame([("j0",)], "id string")
    batch = spark.createDataFrame([("j1", 1), ("j1", 2), ("", 3), ("j0", 4)], "id string, o int")
    fresh, summary = registry.register_new(existing, batch, "id", "o")
    assert rows(fresh, "id", "o") == [("j1", 1)] and rows(summary, "added", "skipped") == [(1, 3)]
    table = spark.createDataFrame([("a", "historical", "raw", "t"), ("b", "test", "x", "t")], readers.REGISTRY_SCHEMA)
    new, found = registry.update_status(table, spark.createDataFrame([("a", "parsed"), ("z", "q")], "resume_name string, status string"), "resume_name", F.lit("now"))
    assert rows(new, "resume_name", "status", "last_updated") == [("a", "parsed", "now"), ("b", "x", "t")] and rows(found, "resume_name", "found") == [("a", True), ("z", False)]
    assert rows(registry.gated(table, registry.LOAD_GATES, "resume_type", "status"), "resume_name") == [("b",)]
    assert rows(registry.search_names(table, "resume_name", "[ab]"), "resume_name") == [("a",), ("b",)]
    assert set(registry.ALLOWED["test"]) >= set(registry.HISTORICAL)


def test_windows(spark):
    df = spark.createDataFrame([([0.0, 2.0, 4.0],)], "v array<double>")
    assert df.select(windows.anchored_clusters(F.col("v"), 3.0).alias("c")).first().c == [0, 0, 1]
    heads = spark.createDataFrame([("d", i, lv) for i, lv in enumerate([1, 2, 3, 2, 1, 3])], "d string, o int, lv int")
    assert [r.parent for r in windows.heading_parents(heads, "d", "o", "lv").orderBy("o").collect()] == [None, 0, 1, 0, None, 4]


def test_jobs(spark):
    text = "intro\n**A**\n**B:** x\ny\n## C:\nlast\n**B** again\n# Empty\n"
    got = jobs.sections(spark.createDataFrame([("j", text)], "job_id string, text string"))
    assert rows(got, "name", "content") == [("B", "again"), ("C", "last")]
    names = spark.createDataFrame([(1, 1, "Ideal Qualifications"), (2, 1, "Requirements"), (2, 2, "Ideal qualifications"), (3, 1, "Qualifications"), (4, 1, "Preferred required skills")], "j int, o int, n string")
    classes = {(r.j, r.o): r.qualification for r in jobs.qualification_class(names, "j", "o", "n").collect()}
    assert classes == {(1, 1): "required", (2, 1): "required", (2, 2): "preferred", (3, 1): "required", (4, 1): "required"}
    one = spark.range(1).select(
        jobs.archetype(F.lit("Required and Preferred Qualifications")).alias("a"), jobs.is_boilerplate(F.lit("Resource allocation")).alias("b"), jobs.parse_identifier(F.lit("MLEng_AcmeCorp")).alias("p"),
        jobs.job_type(F.lit("Res202507_MLOps_Revature")).alias("t"), jobs.job_type(F.lit("_test_Res202511_Fry_MomCorp")).alias("u"), jobs.identifier(F.lit("Senior Machine Learning Engineer - Vision"), F.lit("Acme, Inc")).alias("i"),
        jobs.metadata(F.lit("**Company:** Acme\n**Title:** Eng\nPay $100,000 - $120,000 per year in Austin, TX. Remote. Job ID: R-77")).alias("m"), jobs.normalise_unicode(F.lit("ﬁne — “x”​")).alias("n"), jobs.filename_metadata(F.lit("Eng_Acme_R1234")).alias("f"),
    ).first()
    assert one.a == "required_qualifications" and one.b and (one.p.title, one.p.job_id, one.p.company) == ("MLEng", "AcmeCorp", "") and (one.t, one.u) == ("MLOps", "Unknown")
    assert one.i == "MLEng_Sen_Vision_Acme" and one.n == 'fine -- "x"' and (one.f.company, one.f.job_id) == ("Acme", "R1234")
    assert one.m == {"Company": "Acme", "Role": "Eng", "Salary": "$100,000 - $120,000 per year", "Location": "Austin, TX", "Work Mode": "Remote", "Job ID": "R-77"}


def test_text_and_tokens(spark, tmp_path):
    one = spark.range(1).select(T.to_latex(F.lit("\\")).alias("a"), T.truncate_display(F.lit("x" * 60), 58).alias("b"), T.without_overlap(F.lit("abc"), F.lit("bcd")).alias("c"), T.relative_time(F.lit(dt.datetime(2026, 1, 1)), F.lit(dt.datetime(2026, 1, 1, 2, 5))).alias("d"), T.leading_number(F.lit("0.35\\w")).alias("e")).first()
    assert one == ("\\textbackslash\\{\\}", "x" * 55 + "...", "abcd", "2h ago", 0.35)
    docs = spark.createDataFrame([(0, "Machine learning is useful"), (1, "one"), (2, None)], "o int, t string")
    tokenizer = Tokenizer(phrases={"machine learning": "ml"}, stopwords=("is",), ngrams=2)
    assert [r.x for r in docs.orderBy("o").select(tokenizer(F.col("t")).alias("x")).collect()] == [["ml", "useful", "ml_useful"], ["one"], []]
    assert [porter(w) for w in ("caresses", "ponies", "relational", "hopping", "adjustable", "sky")] == ["caress", "poni", "relat", "hop", "adjust", "sky"]
    assert docs.filter("o = 0").select(Tokenizer(stem=True)(F.col("t")).alias("x")).first().x == ["machin", "learn", "us"]
    assert docs.filter("o = 0").select(Tokenizer(stopwords=(), verbs=("learn",), nouns=("machine",))(F.lit("Machines learned learning is")).alias("x")).first().x == ["machine", "learn", "learn", "is"]
    store = CorpusStore(spark, str(tmp_path))
    key = store.save(docs, tokenizer, "t", "o")
    store.save(docs, Tokenizer(), "t", "o")
    assert [r.doc_count for r in store.configs().collect()] == [3, 3] and store.load(key).count() == 3
    assert store.delete(key) and not store.delete(key)
    with pytest.raises(KeyError):
        store.load(key)


CONFIGS = {
    "job": {"operations": {
        "type": {"operation": "set_literal", "output_path": "type", "value": "job"},
        "env": {"operation": "extract_environment", "env_name": ["nope", "itemizeAcademic"], "num_params": 2, "param_names": ["metadata.company", "metadata.title"], "output_context": "body"},
        "title": {"operation": "split", "source_path": "metadata.title", "delimiter_pattern": r"\\\\", "output_paths": ["metadata.title", "metadata.subtitle"]},
        "projects": {"operation": "recursive_parse", "recursive_pattern": "itemizeProj", "config_name": "project", "source": "body", "output_path": "content.projects"},
        "bullets": {"operation": "parse_itemize_content", "marker_pattern": "ITEM", "source": "body", "output_path": "content.bullets"},
    }},
    "project": {"operations": {"env": {"operation": "extract_environment", "env_name": "itemizeProj", "num_params": 1, "param_names": ["name"], "output_context": "body"}, "names": {"operation": "extract_regex", "pattern": r"\\itemii\s+(?P<x>\w+)", "source": "body", "output_path": "items"}}},
}


def test_extraction(spark):
    tex = r"\begin{itemizeAcademic}{Acme}{Dev\\Lead} \itemi \textbf{Did} 5\% \begin{itemizeProj}{P} \itemii one \itemii two \end{itemizeProj} \itemi more\end{itemizeAcademic}"
    engine = Extractor(CONFIGS, {"ITEM": r"\\itemi\s+"})
    got = json.loads(spark.createDataFrame([(tex,)], "t string").select(engine.column("job")("t")).first()[0])
    assert got["metadata"] == {"company": "Acme", "title": "Dev", "subtitle": "Lead"} and got["content"]["projects"] == [{"name": "P", "items": ["one", "two"]}]
    assert [b["plaintext"] for b in got["content"]["bullets"]] == ["Did 5%", "more"]
    assert latex.to_plaintext(r"\centering \textbf{Bold \emph{x}}\par {A} \{b\} 1 $\to$ 2 a---b \$5") == "Bold xA {b} 1 to 2 a—b 5"
    with pytest.raises(ValueError):
        latex.closing("{a\\}", 0)
    kinds = spark.createDataFrame([("a | b", "x"), (r"\begin{itemizeAcademic}", "x"), ("", "x"), (r"\begin{itemizeLL}", "left_column"), (r"\begin{itemize} \item a", "main_column"), (r"\begin{itemizeLL}", "main_column"), (r"\begin{itemize} University", "x"), (r"\begin{itemize}\item[x] a \begin{itemizeLL}", "x"), (r"\setlength\baselineskip\scshape", "x"), (r"\begin{itemizeProjMain}", "x")], "c string, r string").select(infer_section_type(F.col("c"), F.col("r")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["skill_list_pipes", "work_history", "unknown", "personality_alias_array", "custom_itemize", "simple_list", "education", "skill_categories", "skill_list_caps", "projects"]


def test_compare_layout_reports(spark):
    pairs = spark.createDataFrame([(1, "a\n\nb", "a\nb"), (2, "a", "b")], "k long, x string, y string")
    assert rows(compare.diff_counts(pairs, "k", "x", "y"), "k", "n_diffs") == [(1, 0), (2, 2)]
    assert compare.count_new_fields({"a": 1}, {"a": 2, "b": {"c": 1}}) == 2
    chars = spark.createDataFrame([("d", 1, 0, float(x), 10.0 + (i % 2), c) for i, (x, c) in enumerate(enumerate("Head"))] + [("d", 1, 0, float(x), 30.0, c) for x, c in enumerate("body text")], "doc string, page int, col int, x0 double, top double, text string")
    lines = layout.lines(chars)
    assert rows(lines, "line", "text") == [(0, "Head"), (1, "body text")]
    want = spark.createDataFrame([("d", 1, 1, 0, "Head", "Body text"), ("d", 2, 1, 0, "Gone", "x")], "doc string, section_ord long, page int, col int, name string, content string")
    assert rows(layout.diagnose(want, lines), "name", "found_page", "issue") == [("Gone", None, "missing"), ("Head", 1, None)]
    assert reports.percentage(1, 0) == "0.0%" and "a" in reports.frequency_report(spark.createDataFrame([("a", 3)], "s string, n long"), "s", "n", 4, "T")
    with pytest.raises(ValueError):
        reports.table([reports.Column("x", 3)], [(1, 2)])


def test_readers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"timestamp":"1","event_type":"registration","resume_name":"a","n":1}\nbroken\n{"timestamp":"2","event_type":"x","resume_name":"a"}\n')
    got = readers.events(spark, str(tmp_path / "log.jsonl"))
    assert rows(got, "event_type", "resume_name") == [("registration", "a"), ("x", "a")] and got.orderBy("log_order").first().extras == {"n": "1"}
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "one.yaml").write_text("document:\n  pages:\n  - page_number: 1\n    regions:\n      main_column:\n        sections:\n        - type: skill_list_caps\n          metadata: {name: S}\n          content: {items: [{plaintext: a}, {plaintext: b}]}\n")
    (tmp_path / "y" / "bad.yaml").write_text("x: [")
    docs = readers.yaml_documents(spark, str(tmp_path / "y"))
    assert docs.filter("error is not null").count() == 1
    assert rows(items.flatten(readers.sections(docs)), "resume_name", "section_name", "item_text") == [("one", "S", "a"), ("one", "S", "b")]
    assert readers.presets({"a": {"b": {"x": 1}}}) == {"a_b": {"x": 1}}
    with pytest.raises(ValueError):
        readers.apply_presets({}, {}, ["none"])
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": " "}]}))
    assert rows(readers.notebook_cells(spark, str(tmp_path / "n.ipynb")), "cell", "source") == [(0, "a\nb")]


def test_registry_files_and_texts(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert readers.ensure_registry(spark, path).count() == 0 and readers.ensure_registry(spark, path).columns[0] == "resume_name"
    table = spark.createDataFrame([("a", "historical", "raw", "t")], readers.REGISTRY_SCHEMA)
    readers.write_reconstruction(table, str(tmp_path / "deduced"))
    assert readers.registry(spark, str(tmp_path / "deduced")).collect() == table.collect()
    with pytest.raises(FileExistsError):
        readers.write_reconstruction(table, str(tmp_path / "deduced"))
    for name in ("Job.md", "job.md", "Other.md"):
        (tmp_path / name).write_text(name)
    found = readers.texts(spark, str(tmp_path / "*.md"))
    assert [readers.find_text(found, n).first().text for n in ("job", "JOB", "other")] == ["job.md", "Job.md", "Other.md"] and readers.find_text(found, "none").count() == 0
    out = readers.write_yaml(spark.createDataFrame([('{"b": [1, "é"], "a": null}',), (None,)], "j string"), "j").collect()
    assert out[0].yaml == "b:\n- 1\n- é\na: null\n" and out[1].yaml is None
    assert latex.strip_formatting(r"\textbf{a \emph{b}} c") == "a b c" and latex.remove_at_end("x \\par \\vspace{3pt}\n", "vspace") == "x \\par" and latex.remove_at_end("x \\vspace{3pt} y", "vspace") == "x \\vspace{3pt} y"
    assert readers.interpolated({"a": {"b": 3}, "c": "${a.b}", "d": "n ${c}!", "e": ["${e.1}", 7]}) == {"a": {"b": 3}, "c": 3, "d": "n 3!", "e": [7, 7]}
    bad = spark.createDataFrame([(str(k), "e") for k in range(4)] + [("x", None)], "path string, error string")
    assert tuple(readers.error_summary(bad, 2).first()) == (4, ["0: e", "1: e", "... and 2 more"])
    assert compare.document_diff({"a": 1, "b": [1, 2]}, {"b": [1, 3], "a": 1})[1] == 2 and latex.pattern_literal(r"\\begin\{paracol\}\{2\}") == r"\begin{paracol}{2}"


def test_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("a", t, "registration", "raw"), ("a", t + dt.timedelta(hours=1), "status_change", "parsed"), ("b", t, "registration", "raw")], "resume_name string, ts timestamp, event_type string, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("resume_name string, ts timestamp, event_type string, status string").parquet(str(tmp_path / "in"))
    q = registry_stream.registry_updates(stream).writeStream.outputMode("update").format("memory").queryName("registry_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("registry_out"), "resume_name", "status", "n_events", "violations") == [("a", "parsed", 2, 0), ("b", "raw", 1, 0)]
