"""Registered queries over nested documents, job texts, LaTeX and registries, with expected values written out in SQL.

Texts are dealt to the rows of `part` by its key, so every row runs the operator; the SQL has the results as values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex
from ..functions import text as T
from ..functions.tokens import CorpusStore, Tokenizer
from ..operators import compare, conversion, documents, events, items, jobs, layout, records, reports, stats
from ..operators.extraction import infer_section_type, log_messages
from ..session import spread
from .catalog import query


def _read(spark, sf_dir, table):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _expected(rows: list[tuple], names: str, modulus: int) -> str:
    """SQL: for each part the rows whose first value is its key modulo `modulus`, without that value."""
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    return f"SELECT p_partkey, {names} FROM part JOIN (VALUES {values}) v(k, {names}) ON p_partkey % {modulus} = v.k"


def _dealt(spark, sf_dir, rows: list[tuple], *names: str):
    """p_partkey and the columns of the row that its key picks."""
    structs = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    picked = F.element_at(structs, (F.col("p_partkey") % len(rows) + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", picked.alias("c")).select("p_partkey", "c.*")


_KINDS = [
    (r"\begin{itemizeProjMain}\end{itemizeProjMain}", "main_column", "projects"),
    (r"\begin{itemizeAcademic}{x} a | b", "main_column", "work_history"),
    (r"\begin{itemize} \item University of X", "main_column", "education"),
    (r"\begin{itemize}\item[\faCode] Tools \begin{itemizeLL}", "main_column", "skill_categories"),
    (r"\setlength{\baselineskip}{1pt}{\scshape a}", "left_column", "skill_list_caps"),
    ("a | b", "left_column", "skill_list_pipes"),
    (r"\begin{itemizeMain} \item a", "left_column", "personality_alias_array"),
    (r"\begin{itemize} \item a", "main_column", "custom_itemize"),
    (r"\begin{itemizeLL} \itemLL a", "main_column", "simple_list"),
    (r"\item alone", "main_column", "unknown"),
]


@query("section_types", _expected([(k, r[2]) for k, r in enumerate(_KINDS)], "kind", len(_KINDS)))
def section_types(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [r[:2] for r in _KINDS], "content", "region")
    return rows.select("p_partkey", infer_section_type(F.col("content"), F.col("region")).alias("kind"))


_LOGS = [
    ("This is it\n! Missing $ inserted.\nl.12 x\nLaTeX Warning: Reference `a' undefined.\nOverfull \\hbox (3.0pt too wide) in\n! Emergency stop.\n",),
    ("x Undefined control sequence \\foo\nUndefined control sequence \\bar\nPackage hyperref Warning: Token not allowed\nUnderfull \\hbox (badness 10000) in\nLaTeX Warning: Last one. \n",),
    ("fatal error\nall is well\n",),
]
_MESSAGES = [(0, "error", 0, "Missing $ inserted."), (0, "error", 1, "Emergency stop."), (0, "warning", 0, "Reference `a' undefined."), (0, "warning", 1, "3.0pt too wide"), (1, "error", 0, "Undefined control sequence \\foo"), (1, "warning", 0, "Last one."), (1, "warning", 1, "Token not allowed"), (1, "warning", 2, "badness 10000")]


@query("log_messages", _expected(_MESSAGES, "kind, place, message", len(_LOGS)))
def log_message_rows(spark, sf_dir):
    return log_messages(_dealt(spark, sf_dir, _LOGS, "log"), "p_partkey", "log")


_ROLES = [
    ("Senior Machine Learning Engineer - Vision", "Acme, Inc", "MLEng_Sen_Vision_Acme"),
    ("AI/ML Engineer", "Booz Allen Hamilton", "AIEng_BAH"),
    ("Data Scientist, Research Operations", "Inc Holdings Corp", "DataSci_Research Operations_IncHoldings"),
    ("Staff, Pre-training Developer", "O'Neil-Smith LLC", "PretrainingDev_Staff_ONeilSmith"),
    ("Jr. Software Engineer – Infrastructure, Tools", "Technology", "SoftEng_Jr_Infrastructure, Tools_Tech"),
    ("Engineer", "", None),
]


@query("identifiers", _expected([(k, r[2]) for k, r in enumerate(_ROLES)], "identifier", len(_ROLES)))
def identifiers(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [r[:2] for r in _ROLES], "role", "company")
    return rows.select("p_partkey", jobs.identifier(F.col("role"), F.col("company")).alias("identifier"))


_IDS = [("MLEng_Sen_AcmeCorp_10130042", "MLEng", "AcmeCorp", "Sen", "", "", "10130042"), ("MLEng_AcmeCorp", "MLEng", "", "", "", "", "AcmeCorp"), ("Eng", "Eng", "", "", "", "", ""), ("AIEng_Vision_Lead_Speech_Acme_LI_R7", "AIEng", "Acme", "Lead", "Speech", "LI", "R7"), ("Eng_Acme_GH_x", "Eng", "Acme", "", "", "GH", "x")]


@query("identifier_parts", _expected([(k, *r[1:]) for k, r in enumerate(_IDS)], "title, company, seniority, focus, source, job_id", len(_IDS)))
def identifier_parts(spark, sf_dir):
    return _dealt(spark, sf_dir, [r[:1] for r in _IDS], "i").select("p_partkey", jobs.parse_identifier(F.col("i")).alias("x")).select("p_partkey", "x.*")


_FILES = [("MLEng_Disney_12345.md", "Disney", "12345"), ("a/b/MLEng_Walt-Disney-Co.md", "Walt Disney Co", None), ("MLEng_Acme_abc", "abc", None), ("MLEng_Acme_a1", "a1", None), ("plain", None, None)]


@query("filename_hints", _expected([(k, *r[1:]) for k, r in enumerate(_FILES)], "company, job_id", len(_FILES)))
def filename_hints(spark, sf_dir):
    return _dealt(spark, sf_dir, [r[:1] for r in _FILES], "f").select("p_partkey", jobs.filename_metadata(F.col("f")).alias("x")).select("p_partkey", "x.*")


_POSTS = [
    ("# ML Engineer\n**Company:** Acme\n**Pay:** much\nPay $100,000 - $120,000 per year in Austin, TX. Hybrid. Job ID: R-77", "X_Other_R1234.md", "ML Engineer", "Acme", "Austin, TX", "$100,000 - $120,000 per year", "Hybrid", "R-77"),
    ("intro\n**Title:** Analyst\nWe sit in New Haven, Connecticut and work in-office.", "X_Big-Co_99999.md", "Analyst", "Big Co", "New Haven, Connecticut", None, "On-site", "99999"),
    ("nothing here", "plain", None, None, None, None, None, None),
]
_FIELDS = ("Role", "Company", "Location", "Salary", "Work Mode", "Job ID")


@query("job_metadata", _expected([(k, *r[2:]) for k, r in enumerate(_POSTS)], "role, company, location, salary, work_mode, job_id", len(_POSTS)))
def job_metadata(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [r[:2] for r in _POSTS], "t", "f").withColumn("m", jobs.metadata(F.col("t"), F.col("f")))
    return rows.select("p_partkey", *[F.try_element_at("m", F.lit(f)).alias(f.lower().replace(" ", "_")) for f in _FIELDS])


_SECTIONED = [
    ("## Metadata\n### company\nAcme\n\n### Role\nEngineer\n### Nonsense\nx\n## Body\n### Location\nno", "Engineer", "Acme", None, "Engineer"),
    ("### Role\nno\n\n## **First** heading\n", None, None, None, "Role"),
]


@query("metadata_section", _expected([(k, *r[1:]) for k, r in enumerate(_SECTIONED)], "role, company, location, title", len(_SECTIONED)))
def metadata_section(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [r[:1] for r in _SECTIONED], "t").withColumn("m", jobs.metadata_section(F.col("t")))
    picked = [F.try_element_at("m", F.lit(f)).alias(f.lower()) for f in ("Role", "Company", "Location")]
    return rows.select("p_partkey", *picked, jobs.title(F.col("m"), F.col("t")).alias("title"))


_JOBS = [
    ("intro\n**About the role**\nBuild things.\n**Basic Qualifications:** Python\n* SQL\n**- Nice to have:** Rust\n## Benefits\n- Lunch\n- Rest",),
    ("# Ideal Qualifications\nTaste\n# Requirements\nWork\n# Who we are\nUs",),
    ("# Qualifications\nAll",),
]
_PARTS = [
    (0, "About the role", "Build things.", None, "about_role", False),
    (0, "Basic Qualifications", "Python\n* SQL", "required", "required_qualifications", False),
    (0, "Nice to have", "Rust", "preferred", "preferred_qualifications", False),
    (0, "Benefits", "- Lunch\n- Rest", None, "benefits", True),
    (1, "Ideal Qualifications", "Taste", "preferred", "other", False),
    (1, "Requirements", "Work", "required", "required_qualifications", False),
    (1, "Who we are", "Us", None, "about_company", False),
    (2, "Qualifications", "All", "required", "other", False),
]


def _jobs(spark, sf_dir):
    return jobs.parse_job_text(_dealt(spark, sf_dir, _JOBS, "text"), "p_partkey")


@query("job_sections", _expected(_PARTS, "name, content, qualification, archetype, boilerplate", len(_JOBS)))
def job_sections(spark, sf_dir):
    return _jobs(spark, sf_dir)[1].select("p_partkey", "name", "content", "qualification", "archetype", "boilerplate")


@query("job_titles", _expected([(0, "intro"), (1, "Ideal Qualifications"), (2, "Qualifications")], "title", 3))
def job_titles(spark, sf_dir):
    return _jobs(spark, sf_dir)[0].select("p_partkey", "title")


_WARN = ["no required qualifications", "no preferred qualifications", "fewer than three sections"]


@query("job_validation", _expected([(0, 4, 6, 43, []), (1, 3, 3, 11, []), (2, 1, 1, 3, _WARN[1:])], "n_sections, n_lines, n_chars, warnings", 3).replace(", [])", ", CAST([] AS VARCHAR[]))"))
def job_validation(spark, sf_dir):
    return jobs.validation(_jobs(spark, sf_dir)[1], "p_partkey").select("p_partkey", "n_sections", "n_lines", "n_chars", "warnings")


@query("job_bullets", _expected([(0, 0, "Lunch"), (0, 0, "SQL"), (0, 1, "Rest")], "position, bullet", 3))
def job_bullets(spark, sf_dir):
    return jobs.bullets(_jobs(spark, sf_dir)[1], "p_partkey", "content")


@query("job_plain_text", _expected([(0, "Build things.\n\nPython\n* SQL\n\nRust"), (1, "Taste\n\nWork\n\nUs"), (2, "All")], "text", 3))
def job_plain_text(spark, sf_dir):
    return jobs.plain_text(_jobs(spark, sf_dir)[1], "p_partkey", boilerplate=False)


_STYLED = [
    (r"\textbf{Bold \emph{x}} 5\% $\to$ 2", "Bold x 5% to 2", "**Bold *x*** 5% to 2"),
    (r"\href{http://a}{link} a---b \texttt{code}", "link a—b code", "link a—b `code`"),
    (r"\centering {A} \& \{b\}\vspace{3pt}", "A & {b}", "A & {b}"),
]


@query("latex_texts", _expected([(k, *r[1:]) for k, r in enumerate(_STYLED)], "plain, markdown", len(_STYLED)))
def latex_texts(spark, sf_dir):
    return _dealt(spark, sf_dir, [r[:1] for r in _STYLED], "t").select("p_partkey", latex.plaintext_column("t").alias("plain"), latex.markdown_column("t").alias("markdown"))


_COMMENTED = [
    ("%%%%%%\n%%% My part %%%\n% words\n% \\old\na 5\\% b\n\\x % ----\n{}%Aug 2024\nkept %\nend % note", "a 5\\% b\n\\x\n{}\nkept %\nend"),
    ("a\n\\suggest{b {c} d}e", "a\ne"),
]


@query("latex_comments", _expected([(k, r[1]) for k, r in enumerate(_COMMENTED)], "cleaned", len(_COMMENTED)))
def latex_comments(spark, sf_dir):
    return _dealt(spark, sf_dir, [r[:1] for r in _COMMENTED], "t").select("p_partkey", latex.cleaned_column("t").alias("cleaned"))


_LOOSE = [
    ("  \\section*{A}\nx\n\\begin{itemize}\n\\item[a] {b}\n\\itemLL  c\n\\end{itemize}\ny", "\\section*{A}\n\n\nx\n\n\\begin{itemize}\n\n\\item[a]{b}\n\n\\itemLL c\n\n\\end{itemize}\n\n\ny"),
    ("\\switchcolumn\n\\vspace{3pt}\nz\n\n\n\\setlength{\\x}{1pt}\n\nw \\\\ v", "\\switchcolumn\n\nz\n\\setlength{\\x}{1pt}\nw \\\\\nv"),
]


@query("latex_normalised", _expected([(k, r[1]) for k, r in enumerate(_LOOSE)], "normal", len(_LOOSE)))
def latex_normalised(spark, sf_dir):
    return _dealt(spark, sf_dir, [r[:1] for r in _LOOSE], "t").select("p_partkey", latex.normalise_column("t").alias("normal"))


_TEX = ["pre \\begin{document}\\section*{A} a \\switchcolumn x \\section*{B} b \\section*{C} \\clearpage \\section*{D} d \\clearpage  "]


@query("latex_sections", "SELECT p_partkey, page_number, region, section_ord, name, content FROM part, (VALUES (1, 'left_column', 0, 'A', 'a'), (1, 'main_column', 0, 'B', 'b'), (1, 'main_column', 1, 'C', ''), (2, 'main_column', 0, 'D', 'd')) v(page_number, region, section_ord, name, content)")
def latex_sections(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [(_TEX[0],)], "t")
    return documents.section_segments(documents.regions(documents.pages(rows, "p_partkey", "t"), "p_partkey"), "p_partkey")


@query("default_stopwords", "SELECT p_partkey, ['engineer', 'platform', 'data'] AS tokens FROM part")
def default_stopwords(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", Tokenizer()(F.lit("The engineer of this platform is very 42 a Data")).alias("tokens"))


@query("lemmas", "SELECT p_partkey, ['study', 'box', 'woman', 'run', 'experience', 'glasses', 'wolf'] AS tokens FROM part")
def lemmas(spark, sf_dir):
    tokenizer = Tokenizer(stopwords=(), verbs=("study", "run", "experience"), nouns=("box", "woman", "wolf", "glasses"))
    return _read(spark, sf_dir, "part").select("p_partkey", tokenizer(F.lit("studies boxes women runs experienced glasses wolves")).alias("tokens"))


_PLACED = "(SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL)"
_FLAT = f"""SELECT conv_id, place, -1 AS sub, -1 AS proj, i AS item_order, 'skill_list_pipes' AS section_type, NULL AS subsection_type, CASE i WHEN 0 THEN role ELSE text END AS item_text, NULL AS company, NULL AS project_name FROM {_PLACED}, (VALUES (0), (1)) n(i) WHERE place % 3 = 0
 UNION ALL SELECT conv_id, place, 0, -1, 0, 'projects', 'project', text, NULL, role FROM {_PLACED} WHERE place % 3 = 1
 UNION ALL SELECT conv_id, place, 0, -1, 0, 'work_history', 'work_experience', text, role, NULL FROM {_PLACED} WHERE place % 3 = 2
 UNION ALL SELECT conv_id, place, 0, 0, i, 'work_history', 'project', CASE i WHEN 0 THEN role ELSE text END, role, 'P' FROM {_PLACED}, (VALUES (0), (1)) n(i) WHERE place % 3 = 2"""


def _sections(spark, sf_dir):
    """Turns of conversations as sections of the three shapes."""
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null and role is not null and text is not null")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1)
    shape = F.col("place") % 3
    none = F.lit(None).cast("string")
    project = F.struct(F.lit("P").alias("name"), F.array("role", "text").alias("items"))
    sub = lambda kind, name, company, projects: F.array(F.struct(F.lit(kind).alias("type"), name.alias("name"), company.alias("company"), none.alias("title"), none.alias("dates"), F.array("text").alias("items"), projects.alias("projects")))
    nothing = F.slice(F.array(project), 1, 0)
    subs = F.when(shape == 1, sub("project", F.col("role"), none, nothing)).when(shape == 2, sub("work_experience", none, F.col("role"), F.array(project)))
    kind = F.when(shape == 0, "skill_list_pipes").when(shape == 1, "projects").otherwise("work_history")
    name = F.concat(F.lit("Turn "), F.col("place").cast("string"))
    return rows.select(F.col("conv_id").cast("string").alias("resume_name"), F.col("conv_id").alias("resume_ord"), F.lit("").alias("path"), F.col("place").cast("long").alias("section_ord"), name.alias("section_name"), kind.alias("section_type"), F.when(shape == 0, F.array("role", "text")).alias("items"), subs.alias("subsections"))


def _items(spark, sf_dir):
    return items.numbered(items.flatten(_sections(spark, sf_dir)), ["resume_ord", "section_ord", "sub_ord", "proj_ord", "item_order"])


@query("items_from_sections", f"SELECT row_number() OVER (ORDER BY conv_id, place, sub, proj, item_order) AS id, CAST(conv_id AS VARCHAR) AS resume_name, 'Turn ' || place AS section_name, section_type, subsection_type, item_order, item_text, company, project_name FROM ({_FLAT})")
def items_from_sections(spark, sf_dir):
    """The flattening of nested sections, with row ids in document order."""
    return _items(spark, sf_dir).select("id", "resume_name", "section_name", "section_type", "subsection_type", "item_order", "item_text", "company", "project_name")


@query("items_skills", f"SELECT item_text, count(*) AS n FROM ({_FLAT}) WHERE section_type = 'skill_list_pipes' GROUP BY item_text")
def items_skills(spark, sf_dir):
    return items.ItemStore(items.flatten(_sections(spark, sf_dir))).skills().groupBy("item_text").agg(F.count("*").alias("n"))


@query("items_bullets", f"SELECT section_type, subsection_type, count(*) AS n FROM ({_FLAT}) WHERE section_type IN ('work_history', 'projects') GROUP BY ALL")
def items_bullets(spark, sf_dir):
    return items.ItemStore(items.flatten(_sections(spark, sf_dir))).bullets().groupBy("section_type", "subsection_type").agg(F.count("*").alias("n"))


@query("items_by_section", f"SELECT CAST(conv_id AS VARCHAR) AS resume_name, 'Turn ' || place AS section_name, list(item_text ORDER BY sub, proj, item_order) AS items FROM ({_FLAT}) WHERE place IN (0, 2) GROUP BY conv_id, place")
def items_by_section(spark, sf_dir):
    return records.items_by_section(_items(spark, sf_dir), ["turn 0", "TURN 2"])


@query("resume_count", f"SELECT count(DISTINCT conv_id) AS n FROM {_PLACED}")
def resume_count(spark, sf_dir):
    return _sections(spark, sf_dir).select("resume_name").distinct().agg(F.count("*").alias("n"))


@query("document_text", f"SELECT CAST(conv_id AS VARCHAR) AS resume_name, string_agg('## Turn ' || place || CASE WHEN place % 3 = 0 THEN chr(10) || '- ' || role || chr(10) || '- ' || text ELSE '' END, chr(10) || chr(10) ORDER BY place) AS text FROM {_PLACED} GROUP BY conv_id")
def document_text(spark, sf_dir):
    return documents.all_text(_sections(spark, sf_dir))


@query("date_distribution", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def date_distribution(spark, sf_dir):
    months = _read(spark, sf_dir, "orders").filter("o_orderdate is not null").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return months.groupBy("month").agg(F.count("*").alias("n"))


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7 LIMIT 1")
def point_lookup(spark, sf_dir):
    return records.lookup(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), c_custkey=7)


@query("registered_exists", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def registered_exists(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.exists(orders, _read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("missing_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_files(spark, sf_dir):
    return records.resolved(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), "doc_id")[1]


@query("archive_status", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'parsed' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'normalized' ELSE 'raw' END AS status FROM documents")
def archive_status(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels")
    return records.archive_status(_read(spark, sf_dir, "documents"), labels.filter("quality = 1"), labels, "doc_id")


_REQUESTS = [
    ("historical", "raw", "normalise", "1", True, "normalized"), ("historical", "parsed", "normalise", "1", False, "parsed"), ("historical", "normalized", "parse", "0", True, "parsing_failed"), ("historical", "parsed", "generate", "1", False, "parsed"),
    ("experimental", "drafting_completed", "generate", "1", True, "templating_completed"), ("experimental", "drafting", "generate", "1", False, "drafting"), ("generated", "templating_failed", "generate", "0", True, "templating_failed"), ("generated", "targeting", "parse", "1", False, "targeting"),
    ("test", "anything", "parse", "1", True, "parsed"), ("historical", "parsed", "compile", "1", True, "parsed"), ("generated", "templating_completed", "compile", "0", True, "compiling_failed"), ("historical", "parsed", "validate", "1", False, "parsed"), ("generated", "compiling_completed", "validate", "1", True, "validating_completed"), ("experimental", "validating_completed", "approve", "1", True, "approved"),
]


@query("lifecycle", _expected([(k, r[2], r[4], r[5]) for k, r in enumerate(_REQUESTS)], "action, allowed, status", len(_REQUESTS)))
def lifecycle(spark, sf_dir):
    """Gates and outcomes of the document life cycle."""
    rows = _dealt(spark, sf_dir, [r[:4] for r in _REQUESTS], "resume_type", "status", "action", "ok").withColumnRenamed("p_partkey", "resume_name")
    return records.advance(rows, rows.select("resume_name", "action", (F.col("ok") == "1").alias("ok"))).withColumnRenamed("resume_name", "p_partkey")


@query("group_by_key", "SELECT c_mktsegment AS \"group\", list(c_custkey ORDER BY c_custkey) AS members FROM customer WHERE c_custkey % 10 = 0 AND c_mktsegment <> '' GROUP BY 1")
def group_by_key(spark, sf_dir):
    """Every tenth customer by segment."""
    return records.grouped(_read(spark, sf_dir, "customer").filter("c_custkey % 10 = 0"), F.col("c_mktsegment"), "c_custkey", "c_custkey")


@query("set_relations", "SELECT o_orderkey, list_sort(list_filter(['O', 'F'], lambda x: x <> o_orderstatus)) AS rest, o_orderstatus IN ('O', 'F') AS inside FROM orders")
def set_relations(spark, sf_dir):
    own, every = F.array("o_orderstatus"), F.array(F.lit("O"), F.lit("F"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.sort_array(F.array_except(every, own)).alias("rest"), records.is_subset(own, every).alias("inside"))


@query("grep_remove", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '[0-9]') GROUP BY doc_id")
def grep_remove(spark, sf_dir):
    return records.without_lines(items.lines(_read(spark, sf_dir, "documents")), "item_text", "[0-9]").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("reverse_lookup", "SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'BRASS') THEN 'alloy' WHEN contains(p_type, 'S') THEN 'other' END AS field FROM part")
def reverse_lookup(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", records.first_contained(F.col("p_type"), {"STEEL": "metal", "BRASS": "alloy", "S": "other"}).alias("field"))


@query("shown_errors", "SELECT o_custkey, CASE WHEN len(l) > 3 THEN list_concat(l[1:3], ['... and ' || (len(l) - 3) || ' more']) ELSE l END AS shown FROM (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)")
def shown_errors(spark, sf_dir):
    keys = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(keys.alias("l")).select("o_custkey", records.shown(F.col("l"), 3).alias("shown"))


@query("template_preview", "SELECT doc_id, CASE WHEN len(l) > 2 THEN array_to_string(l[1:2], chr(10)) || chr(10) || '...' ELSE text END AS preview FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def template_preview(spark, sf_dir):
    return _read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", records.preview(F.col("text"), 2).alias("preview"))


@query("pruned_metadata", "SELECT doc_id, list_sort(list_filter([CASE WHEN lang IS NOT NULL THEN 'lang=' || lang END, CASE WHEN n_chars IS NOT NULL THEN 'n_chars=' || n_chars END], lambda x: x IS NOT NULL)) AS kept FROM documents")
def pruned_metadata(spark, sf_dir):
    given = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    kept = records.without_nulls(records.only(given, ("lang", "n_chars")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.sort_array(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("kept"))


@query("display_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' (Left Column)' ELSE p_brand END AS name FROM part")
def display_names(spark, sf_dir):
    region = F.when(F.col("p_partkey") % 2 == 0, "left_column").otherwise("main_column")
    return _read(spark, sf_dir, "part").select("p_partkey", documents.display_name(F.col("p_brand"), region).alias("name"))


_OVERLAPS = [("abc", "bcd", "abcd"), ("abc", "xyz", "abcxyz"), ("a", "a", "a"), ("", "b", "b")]


@query("prepended", _expected([(k, r[2]) for k, r in enumerate(_OVERLAPS)], "joined", len(_OVERLAPS)))
def prepended(spark, sf_dir):
    return _dealt(spark, sf_dir, [r[:2] for r in _OVERLAPS], "a", "b").select("p_partkey", T.without_overlap(F.col("a"), F.col("b")).alias("joined"))


@query("canonical_documents", "SELECT p_partkey, '{\"a\": [1, {\"c\": 2, \"d\": 3}], \"b\": ' || p_size || '}' AS canonical FROM part")
def canonical_documents(spark, sf_dir):
    given = F.concat(F.lit('{"b": '), F.col("p_size").cast("string"), F.lit(', "a": [1, {"d": 3, "c": 2}]}'))
    return _read(spark, sf_dir, "part").select("p_partkey", compare.canonical_json(given).alias("canonical"))


_MARKDOWN = ["# Top\nintro\n## One\n- a\n+ b\n## Metadata\nx: 1\n# Two ##\n\n## One\nlast"]
_NODES = [(0, 0, None, 1, "Top", "intro"), (0, 2, 0, 2, "One", "* a\n* b"), (0, 5, 0, 2, "Metadata", "x: 1"), (0, 7, None, 1, "Two", ""), (0, 9, 7, 2, "One", "last")]


@query("markdown_nodes", _expected(_NODES, "node_id, parent_id, level, title, content", 1))
def markdown_nodes(spark, sf_dir):
    return documents.markdown_tree(_dealt(spark, sf_dir, [(_MARKDOWN[0],)], "t"), "p_partkey", "t")


@query("tree_sections", _expected([(0, "Top", "intro\n\nOne\n* a\n* b\n\nMetadata\nx: 1"), (0, "Two", "One\nlast"), (0, "One", "last")], "title, content", 1))
def tree_sections(spark, sf_dir):
    return documents.flatten_tree(documents.markdown_tree(_dealt(spark, sf_dir, [(_MARKDOWN[0],)], "t"), "p_partkey", "t"), "p_partkey")


@query("corpus_configs", "SELECT 2 AS corpora, CAST(2 * count(*) AS BIGINT) AS stored, TRUE AS deleted, 1 AS left_over FROM documents")
def corpus_configs(spark, sf_dir):
    """Two corpora saved, counted, one deleted, in the shared folder where there is one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    store = CorpusStore(spark, f"{base}/corpus-{uuid.uuid4().hex}")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    keys = [store.save(docs.filter("doc_id is not null"), Tokenizer(stopwords=(), min_length=n), "text", "doc_id") for n in (3, 9)]
    rows = store.configs().agg(F.count("*").alias("c"), F.sum("doc_count").alias("n")).first()
    gone = store.delete(keys[0])
    left = store.configs().count()
    store.delete(keys[1])
    return spark.range(1).select(F.lit(rows["c"]).cast("int").alias("corpora"), F.lit(rows["n"]).cast("long").alias("stored"), F.lit(gone).alias("deleted"), F.lit(left).cast("int").alias("left_over"))


_PAGES = "(SELECT n_nationkey FROM nation)"
_DIAGNOSED = [("A", 1, 1, 1, 0, None), ("B", 1, 2, 2, 1, "bumped"), ("C", 2, 2, 3, 1, "overflow"), ("D", 3, 3, 3, 0, None), ("E", 1, None, None, 0, "missing"), ("F", 4, 4, 4, 0, None), ("G", None, None, None, 0, "missing")]
_WANT = [(0, 1, 0, "A", "alpha text"), (1, 1, 0, "B", "beta text"), (2, 1, 0, "C", "gamma begins and runs over the whole page until its very last omega words"), (3, 1, 0, "D", "delta text"), (4, 1, 1, "E", "epsilon"), (5, 2, 0, "F", "phi text"), (6, 3, 0, "G", "eta")]
_HAVE = [(1, 0, ("A", "alpha text")), (2, 0, ("B", "beta text", "C", "gamma begins and runs over the whole page")), (3, 0, ("until its very last omega words", "D", "delta text")), (4, 0, ("F", "phi text")), (1, 1, ("other",))]


def _diagnosed(spark, sf_dir):
    docs = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"))
    want = F.array(*[F.struct(F.lit(o).cast("long").alias("section_ord"), F.lit(p).alias("page"), F.lit(c).alias("col"), F.lit(n).alias("name"), F.lit(t).alias("content")) for o, p, c, n, t in _WANT])
    have = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(c).alias("col"), F.lit(k).alias("line"), F.lit(t).alias("text")) for p, c, ts in _HAVE for k, t in enumerate(ts)])
    return layout.diagnose(docs.select("doc", F.inline(want)), docs.select("doc", F.inline(have)))


@query("layout_diagnosis", "SELECT n_nationkey AS doc, name, expected_page, found_page, end_page, overflow, issue FROM nation, (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _DIAGNOSED) + ") v(name, expected_page, found_page, end_page, overflow, issue)")
def layout_diagnosis(spark, sf_dir):
    """Sections found a page late and running over push the later ones of their column, and later pages, back."""
    return _diagnosed(spark, sf_dir).drop("section_ord")


@query("layout_issues", "SELECT n_nationkey AS doc, 4 AS n_issues, FALSE AS is_valid, ['B: bumped', 'C: overflow', 'E: missing', 'G: missing'] AS issues FROM nation")
def layout_issues(spark, sf_dir):
    return layout.issues(_diagnosed(spark, sf_dir))


@query("sorted_stats", "SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def sorted_stats(spark, sf_dir):
    return stats.sorted_counts(_read(spark, sf_dir, "orders"), "o_orderstatus")


_REPLIES = [('```json\n{"a": "x", "b": "None"}\n```', "x", None), ('Sure: {"a": " y ", "b": "z"} ok', "y", "z"), ("nothing", None, None)]


@query("model_replies", _expected([(k, *r[1:]) for k, r in enumerate(_REPLIES)], "a, b", len(_REPLIES)))
def model_replies(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [r[:1] for r in _REPLIES], "r").withColumn("m", documents.parse_reply(F.col("r")))
    return rows.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("a", "b")])


def _tex(spark, sf_dir):
    """Conversations written as LaTeX documents: a turn is a list of pipes, an itemize or a job, by its place."""
    rows = _sections(spark, sf_dir).filter("resume_ord is not null")
    body = F.coalesce(F.try_element_at("items", F.lit(2)), F.col("subsections")[0]["items"][0])
    shown = T.to_latex(F.regexp_replace(body, r"[\\{}\[\]]", ""))
    shape = F.col("section_ord") % 3
    listed = F.concat(F.lit("\\begin{itemize}\n\\item "), shown, F.lit("\n\\end{itemize}"))
    job = F.concat(F.lit("\\begin{itemizeAcademic}{C}{T \\\\ S}{L}{D}\n\\itemi "), shown, F.lit("\n\\begin{itemizeKeyProject}{s}{P}{d}\n\\itemii x \\itemii y\n\\end{itemizeKeyProject}\n\\end{itemizeAcademic}"))
    tex = F.concat(F.lit("\\section*{"), "section_name", F.lit("}\n"), F.when(shape == 0, F.concat(F.lit("A | "), shown)).when(shape == 1, listed).otherwise(job))
    parts = rows.groupBy("resume_ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_ord", tex.alias("t")))), lambda x: x["t"]), "\n\n").alias("t"))
    return parts.select(F.col("resume_ord").alias("conv_id"), F.concat(F.lit("\\renewcommand{\\name}{N {x}}\n\\begin{document}\n\\switchcolumn\n"), "t", F.lit("\n\\end{document}\n")).alias("tex"))


@query("document_roundtrip", f"SELECT conv_id, CAST(NULL AS VARCHAR) AS error, TRUE AS same, 1 AS n_pages, CAST(count(*) AS INTEGER) AS n_sections FROM {_PLACED} GROUP BY conv_id")
def document_roundtrip(spark, sf_dir):
    """LaTeX parsed, written and parsed again."""
    return conversion.round_trip(_tex(spark, sf_dir), "conv_id", "tex")


@query("document_types", f"SELECT conv_id, place, 'Turn ' || place AS name, CASE place % 3 WHEN 0 THEN 'skill_list_pipes' WHEN 1 THEN 'custom_itemize' ELSE 'work_history' END AS kind FROM {_PLACED}")
def document_types(spark, sf_dir):
    """Types and names of the sections of parsed LaTeX."""
    parsed = _tex(spark, sf_dir).select("conv_id", conversion.read_column("tex").alias("j"))
    kinds = F.from_json(F.get_json_object("j", "$.document.pages[0].regions.main_column.sections"), "array<struct<type:string,metadata:struct<name:string>>>")
    return parsed.select("conv_id", F.posexplode(kinds).alias("place", "s")).select("conv_id", F.col("place").cast("long").alias("place"), "s.metadata.name", F.col("s.type").alias("kind"))


@query("report_counts", "SELECT place, rtrim(rpad(name, 12, ' ') || ' ' || lpad(CAST(n AS VARCHAR), 8, ' ') || ' ' || lpad(printf('%.1f%%', round(n * 100.0 / total, 1)), 8, ' ')) AS line FROM (SELECT CASE WHEN length(p_type) > 12 THEN left(p_type, 9) || '...' ELSE p_type END AS name, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type) WHERE place <= 5")
def report_counts(spark, sf_dir):
    return reports.count_lines(stats.distribution(_read(spark, sf_dir, "part"), "p_type"), "p_type", "n", 5, 12)


@query("report_partners", "SELECT a.p_brand AS name_a, row_number() OVER (PARTITION BY a.p_brand ORDER BY count(*) DESC, b.p_type) AS place, '  ' || rpad(CASE WHEN length(b.p_type) > 20 THEN left(b.p_type, 17) || '...' ELSE b.p_type END, 20, ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 8, ' ') AS line FROM part a JOIN part b ON a.p_partkey = b.p_partkey GROUP BY a.p_brand, b.p_type")
def report_partners(spark, sf_dir):
    from pyspark.sql import Window

    pairs = _read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name_a"), F.col("p_type").alias("name_b")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("name_a").orderBy(F.desc("n"), "name_b"))
    return reports.partner_lines(pairs.withColumn("place", place), 20)


@query("report_timeline", "SELECT o_custkey, row_number() OVER w - 1 AS place, strftime(o_orderdate, '%Y-%m-%d') || '  ' || coalesce(lag(o_orderstatus) OVER w, '(none)') || ' -> ' || o_orderstatus AS line FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def report_timeline(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("timestamp"), F.col("o_orderstatus").alias("state"))
    return reports.timeline_lines(events.timeline(rows, "o_custkey", "o_orderkey", "state"), "o_custkey")


@query("report_layout", "SELECT n_nationkey AS doc, place, line FROM nation, (VALUES (1, '1. E is missing'), (2, '2. G is missing'), (3, '3. C runs over to page 3')) v(place, line)")
def report_layout(spark, sf_dir):
    return reports.layout_feedback(_diagnosed(spark, sf_dir))


@query("report_tree", _expected([(0, 0, "Top (5)"), (0, 2, "  One (7)"), (0, 5, "  Metadata (4)"), (0, 7, "Two (0)"), (0, 9, "  One (4)")], "node_id, line", 1))
def report_tree(spark, sf_dir):
    return reports.tree_lines(documents.markdown_tree(_dealt(spark, sf_dir, [(_MARKDOWN[0],)], "t"), "p_partkey", "t"), "p_partkey")


@query("report_checklist", _expected([(0, ["[x] Company: Acme", "[x] Role: ML Engineer", "[x] Salary: $100,000 - $120,000 per year"]), (1, ["[x] Company: Big Co", "[ ] Role", "[ ] Salary"]), (2, ["[ ] Company", "[ ] Role", "[ ] Salary"])], "lines", 3))
def report_checklist(spark, sf_dir):
    posts = [r[:2] for r in _POSTS]
    posts[1] = (posts[1][0].replace("**Title:** Analyst", "text"), posts[1][1])
    rows = _dealt(spark, sf_dir, posts, "t", "f")
    return rows.select("p_partkey", reports.checklist(jobs.metadata(F.col("t"), F.col("f")), ("Company", "Role", "Salary")).alias("lines"))


@query("list_by_type", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def list_by_type(spark, sf_dir):
    return _read(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")
