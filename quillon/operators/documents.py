"""Structured documents: LaTeX pages, regions and sections, markdown trees, views and generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import heading_parents, islands

_DISPLAY_LEFT = " (Left Column)"


def pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    r"""key, page_number (from 1), content, has_clearpage_after: texts cut at \clearpage; empty pages go."""
    parts = docs.select(key, F.size(F.split(text, r"\\clearpage", -1)).alias("n"), F.posexplode(F.split(text, r"\\clearpage", -1)).alias("p", "content"))
    rows = parts.filter(T.strip(F.col("content")) != "").withColumn("has_clearpage_after", F.col("p") < F.col("n") - 1)
    return rows.select(key, (F.col("p") + 1).alias("page_number"), "content", "has_clearpage_after")


def regions(page_rows: DataFrame, key: str) -> DataFrame:
    r"""key, page_number, region, content: left and main column cut at the first \switchcolumn; without one all is main column."""
    halves = F.split("content", r"\\switchcolumn", 2)
    two = F.size(halves) == 2
    named = F.when(two, F.array(F.struct(F.lit("left_column").alias("region"), F.element_at(halves, 1).alias("content")), F.struct(F.lit("main_column").alias("region"), F.element_at(halves, -1).alias("content"))))
    return page_rows.select(key, "page_number", F.inline(F.coalesce(named, F.array(F.struct(F.lit("main_column").alias("region"), F.col("content"))))))


def section_segments(region_rows: DataFrame, key: str) -> DataFrame:
    r"""key, page_number, region, section_ord, name, content: from each \section*{name} to the next; text before the first goes."""
    head = r"\\section\*\{([^}]*)\}"
    names = F.regexp_extract_all("content", F.lit(head), F.lit(1))
    bodies = F.slice(F.split("content", head, -1), F.lit(2), F.size(names) + 1)
    zipped = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), T.strip(b).alias("content")))
    return region_rows.select(key, "page_number", "region", F.posexplode(zipped).alias("section_ord", "s")).select(key, "page_number", "region", "section_ord", "s.name", "s.content")


def preamble(text: Column) -> Column:
    r"""map of what stands before \begin{document}: renewed commands, lengths, colours by name, toggles, and packages joined by commas."""
    head = F.element_at(F.split(text, r"\\begin\{document\}", 2), 1)

    def pairs(prefix: str, pattern: str) -> Column:
        keys, values = F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), F.regexp_extract_all(head, F.lit(pattern), F.lit(2))
        return F.zip_with(keys, values, lambda k, v: F.struct(F.concat(F.lit(prefix), k).alias("k"), v.alias("v")))

    found = F.concat(
        pairs("", r"\\renewcommand\{\\(\w+)\}\{([^{}]*)\}"),
        pairs("length.", r"\\(?:setlength|deflen)\{\\?(\w+)\}\{([^{}]*)\}"),
        pairs("color.", r"\\definecolor\{(\w+)\}\{(\w+\}\{[^{}]*)\}"),
        pairs("toggle.", r"\\toggle(?=true|false)(?:true|false)?\{?(\w*)\}?()"),
    )
    packages = F.array_join(F.regexp_extract_all(head, F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1)), ",")
    last = F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.map_concat(last, F.create_map(F.lit("packages"), packages))


def overrides(values: Column, defaults: dict[str, str]) -> Column:
    """Only the entries that differ from the defaults."""
    table = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_filter(values, lambda k, v: ~v.eqNullSafe(F.try_element_at(table, k)))


def display_name(name: Column, region: Column) -> Column:
    return F.when(region == "left_column", F.concat(name, F.lit(_DISPLAY_LEFT))).otherwise(name)


def table_of_contents(sections: DataFrame) -> DataFrame:
    """resume_name, section_ord, line: one formatted line a section (columns resume_name, section_ord, section_name, page_number, region, section_type)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("resume_name").orderBy("section_ord"))
    line = F.format_string("%2d. %-45s | page %d | %-15s | %s", place, "section_name", "page_number", "region", "section_type")
    return sections.select("resume_name", "section_ord", line.alias("line"))


def get_section(sections: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    """First section of the name in each document; no row where there is none."""
    match = F.col("section_name") == name if case_sensitive else F.lower("section_name") == name.lower()
    first = sections.filter(match).groupBy("resume_name").agg(F.min("section_ord").alias("section_ord"))
    return sections.join(first, ["resume_name", "section_ord"], "left_semi")


def all_text(sections: DataFrame) -> DataFrame:
    """resume_name, text: headed sections with their items, in order."""
    body = F.concat_ws("\n", F.concat(F.lit("## "), "section_name"), F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda i: F.concat(F.lit("- "), i)))
    parts = sections.select("resume_name", "section_ord", body.alias("t"))
    return parts.groupBy("resume_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_ord", "t"))), lambda s: s["t"]), "\n\n").alias("text"))


def page_count(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """resume_name, pages: highest page number, 0 for a document without sections."""
    n = sections.groupBy("resume_name").agg(F.max("page_number").alias("p"))
    return docs.select("resume_name").join(n, "resume_name", "left").select("resume_name", F.coalesce("p", F.lit(0)).cast("long").alias("pages"))


def list_environment(items: Column, environment: str, marker: str = "\\item", arguments: list[Column] | None = None) -> Column:
    """LaTeX of an item list: the environment, its escaped arguments, a marked line an item."""
    args = [F.concat(F.lit("{"), T.to_latex(a), F.lit("}")) for a in arguments or []]
    lines = F.array_join(F.transform(items, lambda i: F.concat(F.lit(f"    {marker} "), T.to_latex(i))), "\n")
    return F.concat(F.lit(f"\\begin{{{environment}}}"), *args, F.lit("\n"), lines, F.lit(f"\n\\end{{{environment}}}"))


def generate_section(section_type: Column, name: Column, items: Column) -> Column:
    """LaTeX of a leaf section by its type."""
    head = F.concat(F.lit("\\section*{"), T.to_latex(name), F.lit("}\n"))
    caps = F.concat(F.lit("{\\scshape "), F.array_join(F.transform(items, T.to_latex), " \\\\ "), F.lit("}"))
    pipes = F.array_join(F.transform(items, T.to_latex), " | ")
    return F.concat(head, F.when(section_type == "skill_list_caps", caps).when(section_type == "skill_list_pipes", pipes).otherwise(list_environment(items, "itemize")))


def markdown_tree(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, node_id (line of the heading), parent_id, level, title, content: an adjacency list of # headings.

    Content is what stands between a heading and the next one; list markers become `* `.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    hashes = F.regexp_extract("raw", r"^(#{1,6})\s+\S", 1)
    marked = islands(lines.withColumn("level", F.nullif(F.char_length(hashes), F.lit(0))), key, "line", F.char_length(hashes) > 0).filter("island > 0")
    shown = F.regexp_replace("raw", r"^\s*[-*+]\s+", "* ")
    body = F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("line", shown.alias("s")))))
    nodes = marked.groupBy(key, "island").agg(F.min("line").alias("node_id"), F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.regexp_replace("raw", r"^#{1,6}\s+|\s*#*\s*$", ""))).alias("title"), body.alias("b"))
    nodes = nodes.withColumn("content", T.strip(F.array_join(F.transform("b", lambda x: x["s"]), "\n")))
    return heading_parents(nodes, key, "node_id", "level").select(key, "node_id", F.col("parent").alias("parent_id"), "level", "title", "content")


def flatten_tree(tree: DataFrame, key: str) -> DataFrame:
    """key, title, content: each node with its children's content appended; of equal titles the last stays, metadata goes."""
    children = tree.filter("parent_id is not null").select(key, F.col("parent_id").alias("node_id"), F.struct(F.col("node_id").alias("o"), "title", "content").alias("c"))
    grouped = children.groupBy(key, "node_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    joined = tree.join(grouped, [key, "node_id"], "left")
    whole = F.concat_ws("\n\n", F.nullif("content", F.lit("")), F.transform(F.coalesce("cs", F.array().cast("array<struct<o:int,title:string,content:string>>")), lambda c: F.concat_ws("\n", c["title"], c["content"])))
    rows = joined.filter(F.lower("title") != "metadata").select(key, "node_id", "title", whole.alias("content"))
    return rows.groupBy(key, "title").agg(F.max_by("content", "node_id").alias("content"))


def parse_reply(reply: Column) -> Column:
    """map of a model's JSON reply: as it is, without code fences, or its first {...}; values that mean nothing become null."""
    kind = "map<string,string>"
    unfenced = F.regexp_replace(reply, r"(?s)^\s*```\w*\s*|\s*```\s*$", "")
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(*[F.from_json(x, kind) for x in (reply, unfenced, inner)])
    return F.transform_values(parsed, lambda _, v: F.when(~F.lower(T.strip(v)).isin("null", "none", "n/a", "unknown", "not specified", ""), T.strip(v)))


def parse_array_reply(reply: Column) -> Column:
    """array<string> of a reply: JSON, or its numbered or bulleted lines."""
    parsed = F.coalesce(F.from_json(reply, "array<string>"), F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>"))
    lines = F.regexp_extract_all(reply, F.lit(r"(?m)^\s*(?:[-*]|[0-9]+[.)])\s+(.+?)\s*$"), F.lit(1))
    return F.coalesce(parsed, lines)


def changed_only(new: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text differs from what is stored, by content hash: only these need writing."""
    have = stored.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h"))
    return new.withColumn("_h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(have, [key, "_h"], "left_anti").drop("_h")
