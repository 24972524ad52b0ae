"""Registered queries over documents, parts, conversations and pages, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import Tokenizer, grams
from ..operators import items, jobs, stats, windows
from ..session import spread
from .catalog import query

KEYWORDS = ("the", "onre", "und", "que", "Zebra-Unseen", "$")
_WORDS = r"[\p{L}\p{N}_]+"
_TOKENS = f"regexp_extract_all(lower(text), '{_WORDS}')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0)))).alias("skill"))


@query("skill_frequency", f"SELECT skill, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS skill FROM documents) GROUP BY skill")
def skill_frequency(spark, sf_dir):
    return _words(_read(spark, sf_dir, "documents")).groupBy("skill").agg(F.count("*").alias("n_docs"))


@query("skill_frequency_top", f"SELECT skill, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS skill FROM documents) GROUP BY skill ORDER BY n_docs DESC, skill LIMIT 20")
def skill_frequency_top(spark, sf_dir):
    return skill_frequency(spark, sf_dir).orderBy(F.desc("n_docs"), "skill").limit(20)


@query("distinct_skills", "SELECT DISTINCT w AS skill FROM (SELECT unnest(" + _TOKENS + ") AS w, lang FROM documents WHERE lang NOT IN ('fr', 'es'))")
def distinct_skills(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").filter(~F.col("lang").isin("fr", "es"))
    return _words(docs).select("skill").distinct()


@query("items_flatten", "SELECT doc_id, generate_subscripts(l, 1) - 1 AS item_order, unnest(l) AS item_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def items_flatten(spark, sf_dir):
    return items.lines(_read(spark, sf_dir, "documents"))


@query("items_sql_like", "SELECT p_partkey AS id, p_name AS item_text FROM part WHERE p_name ILIKE '%COLD%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2')")
def items_sql_like(spark, sf_dir):
    store = items.ItemStore(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("item_text"), F.col("p_brand").alias("section_type")))
    return store.query("SELECT id, item_text FROM items WHERE item_text ILIKE ? AND section_type IN (?, ?, ?, ?)", ["%COLD%", "Brand#11", "Brand#12", "Brand#1", "Brand#2"])


@query("items_in_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def items_in_filter(spark, sf_dir):
    store = items.ItemStore(_read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("section_type")))
    return store.by_section_type("purchase", "signup").withColumnRenamed("section_type", "event_type")


_ROLES = "(SELECT conv_id, turn, role FROM conversations WHERE role IS NOT NULL)"


@query("section_prevalence", f"SELECT role, count(DISTINCT conv_id) AS n_docs FROM {_ROLES} GROUP BY role")
def section_prevalence(spark, sf_dir):
    return stats.prevalence(_read(spark, sf_dir, "conversations").filter("role is not null"), "conv_id", "role")


@query("section_type_distribution", f"SELECT role, count(*) AS n FROM {_ROLES} GROUP BY role")
def section_type_distribution(spark, sf_dir):
    return stats.distribution(_read(spark, sf_dir, "conversations").filter("role is not null"), "role")


@query("section_co_occurrence", f"SELECT a.role AS name_a, b.role AS name_b, count(*) AS n FROM (SELECT *, row_number() OVER () AS r FROM {_ROLES}) a JOIN (SELECT *, row_number() OVER () AS r FROM {_ROLES}) b ON a.conv_id = b.conv_id AND a.r <> b.r GROUP BY ALL")
def section_co_occurrence(spark, sf_dir):
    return stats.co_occurrence(_read(spark, sf_dir, "conversations").filter("role is not null"), "conv_id", "turn", "role")


_BASKET = "(SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"
_PAIRS = f"(SELECT a.p_brand AS name_a, b.p_brand AS name_b, count(*) AS n FROM {_BASKET} a JOIN {_BASKET} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY ALL)"


def _baskets(spark, sf_dir):
    lines, parts = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "l_linenumber", "p_brand")


@query("basket_co_occurrence", f"SELECT * FROM {_PAIRS}")
def basket_co_occurrence(spark, sf_dir):
    """(orderkey, linenumber) identifies a line only where it is unique; positions are counted, so repeats pair too."""
    rows = _baskets(spark, sf_dir)
    same = rows.groupBy("l_orderkey", "l_linenumber", "p_brand").agg(F.count("*").alias("c"))
    per = stats.co_occurrence(rows, "l_orderkey", "l_linenumber", "p_brand")
    # Lines that repeat a line number do not pair with each other.
    clash = same.alias("a").join(same.alias("b"), ["l_orderkey", "l_linenumber"]).select(F.col("a.p_brand").alias("name_a"), F.col("b.p_brand").alias("name_b"), F.when(F.col("a.p_brand") == F.col("b.p_brand"), F.col("a.c") * (F.col("a.c") - 1)).otherwise(F.col("a.c") * F.col("b.c")).alias("m"))
    less = clash.filter("m > 0").groupBy("name_a", "name_b").agg(F.sum("m").alias("m"))
    return per.join(less, ["name_a", "name_b"], "left").select("name_a", "name_b", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).filter("n > 0")


@query("basket_co_occurrence_topk", f"SELECT name_a, name_b, n, place FROM (SELECT p.*, row_number() OVER (PARTITION BY p.name_a ORDER BY n DESC, name_b) AS place FROM {_PAIRS} p JOIN (SELECT name_a, sum(n) AS total FROM {_PAIRS} GROUP BY name_a ORDER BY total DESC, name_a LIMIT 5) t ON p.name_a = t.name_a) WHERE place <= 10")
def basket_co_occurrence_topk(spark, sf_dir):
    return stats.top_partners(basket_co_occurrence(spark, sf_dir), 5, 10).select("name_a", "name_b", "n", "place")


@query("title_distribution", "SELECT trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title, count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY 1")
def title_distribution(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").filter("p_name is not null and p_name <> ''").select(T.collapse(F.col("p_name")).alias("title"))
    return stats.distribution(rows, "title")


@query("title_component_frequency", "SELECT component, count(*) AS n_docs FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS component FROM part) WHERE component <> '' GROUP BY component")
def title_component_frequency(spark, sf_dir):
    return stats.prevalence(stats.title_components(_read(spark, sf_dir, "part"), "p_partkey", "p_name", " "), "p_partkey", "component")


_COMPONENTS = "(SELECT p_partkey, generate_subscripts(l, 1) AS position, unnest(l) AS component FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part))"


@query("title_component_co_occurrence", f"SELECT a.component AS name_a, b.component AS name_b, count(*) AS n FROM {_COMPONENTS} a JOIN {_COMPONENTS} b ON a.p_partkey = b.p_partkey AND a.position <> b.position WHERE a.component <> '' AND b.component <> '' GROUP BY ALL")
def title_component_co_occurrence(spark, sf_dir):
    return stats.co_occurrence(stats.title_components(_read(spark, sf_dir, "part"), "p_partkey", "p_name", " "), "p_partkey", "position", "component")


@query("work_count_per_doc", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def work_count_per_doc(spark, sf_dir):
    return stats.counts_with_zero(_read(spark, sf_dir, "customer"), "c_custkey", _read(spark, sf_dir, "orders"), "o_custkey")


@query("work_count_summary", "SELECT round(avg(n), 6) AS avg_n, min(n) AS min_n, max(n) AS max_n, count(*) AS n_docs FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)")
def work_count_summary(spark, sf_dir):
    n = work_count_per_doc(spark, sf_dir)
    return n.agg(F.round(F.avg("n"), 6).alias("avg_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count("*").alias("n_docs"))


def _keyword_sql(columns: str) -> str:
    one = "SELECT '{w}' AS keyword, count(*) FILTER (contains(lower(text), '{l}')) AS n_docs, CAST(coalesce(sum((length(lower(text)) - length(replace(lower(text), '{l}', ''))) // length('{l}')), 0) AS BIGINT) AS n_occurrences, CAST(coalesce(sum(length(text)) FILTER (contains(lower(text), '{l}')), 0) AS BIGINT) AS n_chars FROM documents"
    return f"SELECT {columns} FROM (" + " UNION ALL ".join(one.format(w=w, l=w.lower()) for w in KEYWORDS) + ")"


@query("keyword_frequency", _keyword_sql("keyword, n_docs"))
def keyword_frequency(spark, sf_dir):
    return stats.keyword_counts(_read(spark, sf_dir, "documents"), "text", list(KEYWORDS)).select("keyword", "n_docs")


@query("keyword_occurrences", _keyword_sql("keyword, n_docs, n_occurrences, n_chars"))
def keyword_occurrences(spark, sf_dir):
    return stats.keyword_counts(_read(spark, sf_dir, "documents"), "text", list(KEYWORDS))


@query("keyword_regex_occurrences", "SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ing[^a-z]')) AS n FROM documents")
def keyword_regex_occurrences(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Z][a-z]+ing[^a-z]")).cast("long").alias("n"))


@query("search_field_counts", "SELECT p AS pattern, count(*) FILTER (contains(lower(c_mktsegment), lower(p))) AS n FROM customer, (VALUES ('BUILD'), ('auto'), ('%'), ('zzz')) v(p) GROUP BY p")
def search_field_counts(spark, sf_dir):
    return stats.search_field(_read(spark, sf_dir, "customer"), "c_mktsegment", ["BUILD", "auto", "%", "zzz"])


@query("search_field_matches", "SELECT p AS pattern, c_custkey, c_mktsegment FROM customer, (VALUES ('build'), ('AUTO')) v(p) WHERE contains(lower(c_mktsegment), lower(p))")
def search_field_matches(spark, sf_dir):
    return stats.search_field(_read(spark, sf_dir, "customer"), "c_mktsegment", ["build", "AUTO"], matches=True).select("pattern", "c_custkey", "c_mktsegment")


@query("search_docs", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'there') AND NOT contains(text, 'xyz')")
def search_docs(spark, sf_dir):
    text = F.col("text")
    return _read(spark, sf_dir, "documents").filter(stats.contains_text(text, "There") & ~stats.contains_text(text, "xyz", case_sensitive=True)).select("doc_id", "lang")


@query("section_extents", "SELECT doc_id, item_order, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY item_order), total) AS extent_end FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS item_order, CAST(coalesce(list_sum(list_transform(list_slice(l, 1, generate_subscripts(l, 1) - 1), lambda x: length(x) + 1)), 0) AS BIGINT) AS start, length(text) AS total FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))")
def section_extents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("total"), F.split("text", "\n", -1).alias("l"))
    lengths = docs.select("doc_id", "total", F.posexplode("l").alias("item_order", "line")).withColumn("size", F.char_length("line") + 1)
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("item_order")
    starts = lengths.withColumn("start", (F.sum("size").over(w) - F.col("size")).cast("long"))
    return windows.extents(starts, "doc_id", "start", "total").select("doc_id", F.col("item_order").cast("long").alias("item_order"), "start", "extent_end")


_LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS item_order, unnest(l) AS item_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query("header_islands", f"SELECT doc_id, island, count(*) AS n_lines FROM (SELECT doc_id, CAST(sum(CASE WHEN length(item_text) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY item_order ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM {_LINES}) GROUP BY ALL")
def header_islands(spark, sf_dir):
    lines = items.lines(_read(spark, sf_dir, "documents"))
    return windows.islands(lines, "doc_id", "item_order", F.char_length("item_text") < 40).groupBy("doc_id", "island").agg(F.count("*").alias("n_lines"))


@query("page_break_flags", "SELECT conv_id, turn, role, role <> lag(role, 1, 'system') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page_break FROM conversations WHERE role IS NOT NULL")
def page_break_flags(spark, sf_dir):
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "conversations").filter("role is not null")
    before = F.lag("role", 1, "system").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select("conv_id", "turn", "role", (before != F.col("role")).alias("page_break"))


@query("heading_parents", "SELECT p_brand, p_partkey, (SELECT max(b.p_partkey) FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey < a.p_partkey AND (b.p_size % 4) < (a.p_size % 4)) AS parent FROM part a")
def heading_parents(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 4 + 1).alias("level"))
    return windows.heading_parents(rows, "p_brand", "p_partkey", "level", 4).select("p_brand", "p_partkey", "parent")


@query("tokens_document_frequency", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ('the', 'and', 'und') GROUP BY token")
def tokens_document_frequency(spark, sf_dir):
    tokens = Tokenizer(stopwords=("the", "and", "und"), min_length=3)(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(tokens).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query("token_bigrams", f"SELECT l[i] || '_' || l[i + 1] AS bigram, count(*) AS n FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT list_filter({_TOKENS}, lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')) AS l FROM documents)) GROUP BY 1")
def token_bigrams(spark, sf_dir):
    bigrams = grams(Tokenizer(stopwords=())(F.col("text")), 2)
    return _read(spark, sf_dir, "documents").select(F.explode(bigrams).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query("phrase_normalise", "SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\\p{L}\\p{N}_])(?i:of the)($|[^\\p{L}\\p{N}_])', '\\1of_the\\2', 'g'), '(^|[^\\p{L}\\p{N}_])(?i:und die)($|[^\\p{L}\\p{N}_])', '\\1und_die\\2', 'g') AS text FROM documents")
def phrase_normalise(spark, sf_dir):
    tokenizer = Tokenizer(stopwords=(), phrases={"of the": "of_the", "und die": "und_die"})
    return _read(spark, sf_dir, "documents").select("doc_id", tokenizer.normalised(F.col("text"), apart=True).alias("text"))


_ESC = "text"
for _plain, _to in T.LATEX_ESCAPES:
    _ESC = f"replace({_ESC}, '{_plain}', '{_to}')"


@query("to_latex_escape", f"SELECT doc_id, {_ESC} AS latex FROM documents")
def to_latex_escape(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.to_latex(F.col("text")).alias("latex"))


@query("match_normalise", "SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS h FROM documents")
def match_normalise(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.match_normalise(F.col("text")).cast("binary")).alias("h"))


@query("truncate_display", "SELECT doc_id, CASE WHEN length(text) > 58 THEN left(text, 55) || '...' ELSE text END AS shown FROM documents")
def truncate_display(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.truncate_display(F.col("text"), 58).alias("shown"))


@query("text_metrics", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n_words FROM documents")
def text_metrics(spark, sf_dir):
    text = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.char_length(text).cast("long").alias("n_chars"), F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long").alias("n_words"))


@query("blank_line_limit", "SELECT doc_id, md5(regexp_replace(text, '\\n([ \\t]*\\n){2,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def blank_line_limit(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.limit_blank_lines(F.col("text")).cast("binary")).alias("h"))


@query("content_hash_dedup", "SELECT md5(text) AS h, min(doc_id) AS keeper, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))


def _case(column: str) -> str:
    key = f"trim(regexp_replace(lower({column}), '\\s+', ' ', 'g'))"
    ranked = sorted(jobs.ARCHETYPES.items(), key=lambda kv: -kv[1][0])
    tests = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(key, "|".join(f"(?:{p})" for p in ps).replace("'", "''"), kind) for kind, (_, ps) in ranked)
    return f"CASE {tests} ELSE 'other' END"


@query("archetype_priority", f"SELECT page_id, {_case('h')} AS archetype FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS h FROM pages)")
def archetype_priority(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", jobs.archetype(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("archetype"))


_HEADINGS = ("Requirements", "Nice to have", "Ideal Qualifications", "Qualifications", "Benefits", "Resource allocation", "What you'll do", "About us", "How to apply", "Notes")


@query("section_classes", "SELECT conv_id, turn, " + _case("name") + " AS archetype, list_bool_or(list_transform([" + ", ".join(f"'{b}'" for b in jobs.BOILERPLATE) + "], lambda b: contains(lower(name), b))) AS boilerplate FROM (SELECT conv_id, turn, [" + ", ".join("'" + h.replace("'", "''") + "'" for h in _HEADINGS) + "][1 + (conv_id + turn) % 10] AS name FROM conversations WHERE turn IS NOT NULL)")
def section_classes(spark, sf_dir):
    names = F.array(*map(F.lit, _HEADINGS))
    rows = _read(spark, sf_dir, "conversations").filter("turn is not null").select("conv_id", "turn", F.element_at(names, ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int")).alias("name"))
    return rows.select("conv_id", "turn", jobs.archetype(F.col("name")).alias("archetype"), jobs.is_boilerplate(F.col("name")).alias("boilerplate"))


@query("boilerplate_contains", "SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def boilerplate_contains(spark, sf_dir):
    """Documents that hold each whole benchmark item, met by a word inside the item and confirmed on the text."""
    marks = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("mark"))
    hits = _holding(_read(spark, sf_dir, "documents").select("doc_id", "text"), marks)
    return stats.counts_with_zero(marks, "item_id", hits, "item_id").withColumnRenamed("n", "n_docs")


def _holding(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """item_id, doc_id where the text holds the mark, by the longest word inside the mark as the join key.

    Inside: with a character of the mark on either side that is of no word, so that it is a whole word of every
    text that holds the mark, wherever the mark begins. Marks without such a word are sought in every text.
    """
    word = r"[\p{L}\p{N}]+"
    inner = F.regexp_extract_all("mark", F.lit(rf"(?<=[^\p{{L}}\p{{N}}]){word}(?=[^\p{{L}}\p{{N}}])"), F.lit(0))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = marks.withColumn("w", longest)
    words = docs.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("w"))
    small = keyed.select("w").distinct()
    met = words.join(small, "w", "left_semi").join(keyed, "w").select("item_id", "doc_id", "text", "mark")
    others = docs.select("doc_id", "text").crossJoin(F.broadcast(keyed.filter("w is null").drop("w"))).select("item_id", "doc_id", "text", "mark")
    return met.unionByName(others).filter(F.contains("text", F.col("mark"))).select("item_id", "doc_id").distinct()


@query("html_field_extract", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages")
def html_field_extract(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"))


@query("job_type_from_name", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS job_type FROM customer")
def job_type_from_name(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("_test_Res_"), "c_mktsegment")).otherwise(F.concat(F.lit("Res202511_"), "c_mktsegment", F.lit("_Firm")))
    return _read(spark, sf_dir, "customer").select("c_custkey", jobs.job_type(name).alias("job_type"))


@query("converted_vs_pending", "SELECT d.doc_id, l.doc_id IS NOT NULL AS converted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def converted_vs_pending(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id")
    done, open_ = docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")
    return done.withColumn("converted", F.lit(True)).unionByName(open_.withColumn("converted", F.lit(False)))


@query("roundtrip_summary", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (toxic = 0) AS perfect, CAST(sum(toxic) AS BIGINT) AS diffs, round(100.0 * count(*) FILTER (quality = 1) / count(*), 1) AS pass_rate FROM labels")
def roundtrip_summary(spark, sf_dir):
    return stats.validation_summary(_read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("quality") == 0, F.col("toxic"))
