from pyspark.sql import functions as F

from quillon.operators import documents as D

TEX = "\\usepackage{a}\\usepackage[x]{b}\\renewcommand{\\name}{Fry}\\renewcommand{\\name}{Leela}\\setlength{\\gap}{2pt}\\begin{document}left \\section*{A} a1 \\switchcolumn \\section*{B} b1 \\section*{C} c1\\clearpage\\section*{D} d1"


def test_latex_structure(spark):
    docs = spark.createDataFrame([(1, TEX)], "k int, t string")
    pages = D.pages(docs, "k", "t")
    assert [(r.page_number, r.has_clearpage_after) for r in pages.orderBy("page_number").collect()] == [(1, True), (2, False)]
    rows = D.section_segments(D.regions(pages, "k"), "k").orderBy("page_number", "region", "section_ord").collect()
    assert [(r.page_number, r.region, r.name, r.content) for r in rows] == [(1, "left_column", "A", "a1"), (1, "main_column", "B", "b1"), (1, "main_column", "C", "c1"), (2, "main_column", "D", "d1")]
    meta = docs.select(D.preamble(F.col("t")).alias("m"), D.overrides(D.preamble(F.col("t")), {"packages": "a,b"}).alias("o")).first()
    assert meta.m == {"name": "Leela", "length.gap": "2pt", "packages": "a,b"} and meta.o == {"name": "Leela", "length.gap": "2pt"}


def test_views(spark):
    s = spark.createDataFrame([("r", 2, "B", 1, "main_column", "unknown", ["x"]), ("r", 1, "A", 1, "left_column", "skill_list_caps", ["a&b", "c"])], "resume_name string, section_ord long, section_name string, page_number int, region string, section_type string, items array<string>")
    assert [r.line[:5] for r in D.table_of_contents(s).orderBy("section_ord").collect()] == [" 1. A", " 2. B"]
    assert D.all_text(s).first().text == "## A\n- a&b\n- c\n\n## B\n- x"
    assert D.get_section(s, "a").count() == 1 and D.get_section(s, "a", case_sensitive=True).count() == 0
    docs = spark.createDataFrame([("r",), ("none",)], "resume_name string")
    assert {r.resume_name: r.pages for r in D.page_count(s, docs).collect()} == {"r": 1, "none": 0}
    made = {r.t: r.x for r in s.select(F.col("section_type").alias("t"), D.generate_section(F.col("section_type"), F.col("section_name"), F.col("items")).alias("x")).collect()}
    assert made["skill_list_caps"] == "\\section*{A}\n{\\scshape a\\&b \\\\ c}" and "\\item x" in made["unknown"]


def test_markdown_tree_and_replies(spark):
    text = "pre\n# Job\nintro\n## Need\n- a\n- b\n### Deep\nz\n## Nice\nc\n# Need\nlast"
    tree = D.markdown_tree(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    got = [(r.node_id, r.parent_id, r.level, r.title, r.content) for r in tree.orderBy("node_id").collect()]
    assert got == [(1, None, 1, "Job", "intro"), (3, 1, 2, "Need", "* a\n* b"), (6, 3, 3, "Deep", "z"), (8, 1, 2, "Nice", "c"), (10, None, 1, "Need", "last")]
    assert {r.title: r.content for r in D.flatten_tree(tree, "k").collect()}["Need"] == "last"
    replies = spark.createDataFrame([('{"a": "x", "b": "N/A"}',), ('```json\n{"a": "x"}\n```',), ('Sure: {"a": "x"} ok',), ("no",)], "r string")
    assert [r.m for r in replies.select(D.parse_reply(F.col("r")).alias("m")).collect()] == [{"a": "x", "b": None}, {"a": "x"}, {"a": "x"}, None]
    lists = spark.createDataFrame([('["p", "q"]',), ("1. p\n2) q",)], "r string")
    assert [r.a for r in lists.select(D.parse_array_reply(F.col("r")).alias("a")).collect()] == [["p", "q"], ["p", "q"]]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string"), spark.createDataFrame([(1, "x"), (2, "z")], "k int, t string")
    assert [r.k for r in D.changed_only(a, b, "k", "t").collect()] == [2]
