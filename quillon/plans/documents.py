"""Registered queries that SQL cannot express: Unicode folding, stems, extraction, diffs, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex
from ..functions.tokens import Tokenizer
from ..operators import compare, documents, jobs, layout
from ..operators.extraction import Extractor, infer_section_type
from ..session import spread
from .catalog import query


def _read(spark, sf_dir, table):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


@query("nfkc_normalise")
def nfkc_normalise(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(jobs.normalise_unicode("text").cast("binary")).alias("h"))


@query("porter_stems")
def porter_stems(spark, sf_dir):
    tokens = Tokenizer(stopwords=(), stem=True)(F.col("text"))
    return _read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens)).alias("stem")).groupBy("stem").agg(F.count("*").alias("n_docs"))


@query("line_diffs")
def line_diffs(spark, sf_dir):
    """Each conversation turn against the next one of its conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = _read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn", F.row_number().over(w).alias("place")).alias("pair"), "text", F.lead("text").over(w).alias("following")).filter("following is not null and pair.conv_id is not null and pair.turn is not null")
    return compare.diff_counts(pairs.withColumn("pair", F.to_json("pair")), "pair", "text", "following")


@query("extraction_ops")
def extraction_ops(spark, sf_dir):
    """Part rows written as environments and extracted again."""
    config = {"part": {"operations": {"env": {"operation": "extract_environment", "env_name": "itemizeAcademic", "num_params": 2, "param_names": ["metadata.brand", "metadata.type"], "output_context": "body"}, "bullets": {"operation": "parse_itemize_content", "marker_pattern": r"\\itemi\s+", "source": "body", "output_path": "bullets"}}}}
    tex = F.concat(F.lit("\\begin{itemizeAcademic}{"), "p_brand", F.lit("}{"), "p_type", F.lit("}\\itemi \\textbf{"), "p_name", F.lit("} \\itemi 5\\% off\\end{itemizeAcademic}"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", tex.alias("tex"))
    return rows.select("p_partkey", Extractor(config).column("part")("tex").alias("extracted"), infer_section_type(F.col("tex"), F.lit("main_column")).alias("kind"), latex.plaintext_column("tex").alias("plain"))


@query("layout_match")
def layout_match(spark, sf_dir):
    """Conversations as documents: turns are sections of a page column laid out line by line."""
    turns = _read(spark, sf_dir, "conversations").filter("turn is not null and text is not null").select(F.col("conv_id").alias("doc"), "turn", F.concat(F.lit("Turn "), "turn").alias("name"), "text")
    want = turns.select("doc", F.col("turn").alias("section_ord"), F.lit(1).alias("page"), F.lit(0).alias("col"), "name", F.col("text").alias("content"))
    have = turns.select("doc", F.lit(1).alias("page"), F.lit(0).alias("col"), F.inline(F.array(F.struct((F.col("turn") * 2).alias("line"), F.col("name").alias("text")), F.struct((F.col("turn") * 2 + 1).alias("line"), "text"))))
    return layout.diagnose(want, have)


_TURNS = "(SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations WHERE turn IS NOT NULL AND role IS NOT NULL)"


def _turns(spark, sf_dir):
    """Turns as sections: place orders repeated turns of a conversation."""
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "conversations").filter("turn is not null and role is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


@query("table_of_contents", f"SELECT conv_id AS resume_name, place AS section_ord, printf('%2d. %-45s | page %d | %-15s | %s', place, 'Turn ' || turn, turn + 1, role, role) AS line FROM {_TURNS}")
def table_of_contents(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("resume_name"), F.col("place").cast("long").alias("section_ord"), F.concat(F.lit("Turn "), "turn").alias("section_name"), (F.col("turn") + 1).alias("page_number"), F.col("role").alias("region"), F.col("role").alias("section_type"))
    return documents.table_of_contents(rows)


@query("page_count", "SELECT c_custkey AS resume_name, coalesce(max(year(o_orderdate)), 0) AS pages FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def page_count(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resume_name"), F.year("o_orderdate").alias("page_number"))
    return documents.page_count(orders, _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_name")))


@query("get_section", "SELECT conv_id, min(place) AS place FROM " + _TURNS + " WHERE lower(role) = 'assistant' GROUP BY conv_id")
def get_section(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("resume_name"), F.col("place").cast("long").alias("section_ord"), F.col("role").alias("section_name"))
    return documents.get_section(rows, "Assistant").select(F.col("resume_name").alias("conv_id"), F.col("section_ord").alias("place"))


@query("changed_only", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND text <> upper(text)")
def changed_only(spark, sf_dir):
    """Every seventh document in upper case against the texts as they are."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")))
    return documents.changed_only(new, docs, "doc_id", "text").select("doc_id")


@query("generate_list", "SELECT p_partkey, '\\section*{' || p_brand || '}' || chr(10) || '\\begin{itemize}' || chr(10) || '    \\item ' || p_type || chr(10) || '    \\item 5\\%' || chr(10) || '\\end{itemize}' AS latex FROM (SELECT p_partkey, replace(p_brand, '#', '\\#') AS p_brand, p_type FROM part)")
def generate_list(spark, sf_dir):
    made = documents.generate_section(F.lit("custom_itemize"), F.col("p_brand"), F.array("p_type", F.lit("5%")))
    return _read(spark, sf_dir, "part").select("p_partkey", made.alias("latex"))


@query("section_sequence_diff")
def section_sequence_diff(spark, sf_dir):
    """Roles of each conversation against the alternation user, assistant: opcodes of a sequence diff, one conversation a group."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        roles = rows.sort_values("place")["role"].tolist()
        want = ["user", "assistant"] * ((len(roles) + 1) // 2)
        codes = compare.opcodes(roles, want[: len(roles)])
        return pd.DataFrame({"conv_id": [key[0]] * len(codes), "op": [c[0] for c in codes], "a0": [c[1] for c in codes], "a1": [c[2] for c in codes], "b0": [c[3] for c in codes], "b1": [c[4] for c in codes]})

    return _turns(spark, sf_dir).select("conv_id", "place", "role").groupBy("conv_id").applyInPandas(run, "conv_id long, op string, a0 long, a1 long, b0 long, b1 long")
