"""Ordered items of nested documents: flattening, row ids and a parameterised SQL facade."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fixed

#: One row a section; sections are polymorphic, so the parts that a type lacks are null.
SECTION_SCHEMA = """resume_name string, resume_ord long, path string, section_ord long, section_name string, section_type string,
 items array<string>, subsections array<struct<type:string,name:string,company:string,title:string,dates:string,items:array<string>,
 projects:array<struct<name:string,items:array<string>>>>>"""
#: Section types by their shape.
LEAVES = ("skill_list_caps", "skill_list_pipes", "personality_alias_array", "personality_bottom_bar")
BRANCHES = ("skill_categories", "projects")
HISTORY = "work_history"
SKILLS = ("skill_list_caps", "skill_list_pipes", "skill_category", "skill_categories")
BULLETS = ("work_history", "projects", "work_experience", "project")

#: A ? outside quotes, or a quoted text.
_MARKER = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|\?")
_COLUMNS = ("resume_name", "path", "section_name", "section_type", "subsection_name", "subsection_type", "item_text", "item_order", "company", "job_title", "dates", "project_name")
_ORDER = ("resume_ord", "section_ord", "sub_ord", "proj_ord", "item_order")


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, item_order (from 0), item_text: the lines of a text as its items."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("item_order", "item_text")).withColumn("item_order", F.col("item_order").cast("long"))


def flatten(sections: DataFrame) -> DataFrame:
    """Items of SECTION_SCHEMA rows in document order, without ids; types that hold no items are left out."""
    base = sections.select("resume_name", "resume_ord", "path", "section_ord", "section_name", "section_type", "items", "subsections")
    none = F.lit(None).cast("string")

    def shaped(rows: DataFrame, **given) -> DataFrame:
        fill = {"subsection_name": none, "subsection_type": none, "company": none, "job_title": none, "dates": none, "project_name": none, "sub_ord": F.lit(-1), "proj_ord": F.lit(-1)}
        return rows.withColumns(fill | given).select(*_ORDER[:4], *_COLUMNS)

    item = lambda array: F.posexplode(array).alias("item_order", "item_text")
    own = ("resume_name", "resume_ord", "path", "section_ord", "section_name", "section_type")
    leaf = shaped(base.filter(F.col("section_type").isin(*LEAVES)).select(*own, item("items")))
    sub = base.filter(F.col("section_type").isin(HISTORY, *BRANCHES)).select(*own, F.posexplode("subsections").alias("sub_ord", "s"))
    branch_rows = sub.filter(F.col("section_type") != HISTORY).select(*own, "sub_ord", "s", item("s.items"))
    branch = shaped(branch_rows, sub_ord=F.col("sub_ord"), subsection_name=F.col("s.name"), subsection_type=F.col("s.type"), project_name=F.when(F.col("s.type") == "project", F.col("s.name")))
    job = {"sub_ord": F.col("sub_ord"), "subsection_name": F.col("s.company"), "company": F.col("s.company"), "job_title": F.col("s.title"), "dates": F.col("s.dates")}
    history = sub.filter(F.col("section_type") == HISTORY)
    duties = shaped(history.select(*own, "sub_ord", "s", item("s.items")), **job, subsection_type=F.lit("work_experience"))
    inner = history.select(*own, "sub_ord", "s", F.posexplode("s.projects").alias("proj_ord", "p")).select(*own, "sub_ord", "proj_ord", "s", "p", item("p.items"))
    projects = shaped(inner, **job, proj_ord=F.col("proj_ord"), subsection_type=F.lit("project"), project_name=F.col("p.name"))
    return leaf.unionByName(branch).unionByName(duties).unionByName(projects)


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """`rows` with consecutive ids from 1 by `order`, without a single-partition window.

    Rows are range-partitioned and sorted; each partition's row count, one row
    a partition, gives the offsets. The partitioning, which hangs on a sample,
    is written first, so that a partition computed again has the same rows.
    """
    dealt = fixed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}))
    counts = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total)]
        total += n
    if not offsets:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_part", "_mono")
    place = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(F.create_map(*offsets), F.col("_part")) + 1
    return dealt.withColumn(name, place.cast("long")).drop("_part", "_mono")


class ItemStore:
    """The flat `items` table with SQL over it."""

    def __init__(self, items: DataFrame):
        self.items, self.spark = items, items.sparkSession

    @classmethod
    def build(cls, sections: DataFrame, path: str) -> ItemStore:
        """Write the whole table anew, partitioned by section type, and open it."""
        flat = numbered(flatten(sections), list(_ORDER)).select("id", *_COLUMNS)
        flat.write.mode("overwrite").partitionBy("section_type").parquet(path)
        return cls.open(sections.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ItemStore:
        """FileNotFoundError where there is no store."""
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(path)
        return cls(spark.read.parquet(path))

    def query(self, sql: str, params: list | tuple = ()) -> DataFrame:
        """Any SELECT over `items`, with ? parameters. LIKE is case-sensitive here; use ILIKE for the other kind."""
        self.items.createOrReplaceTempView("items")
        if not params:
            return self.spark.sql(sql)
        numbers = iter(range(len(params)))  # named markers: positional ones are bound in plan order, not text order
        named = _MARKER.sub(lambda m: f":p{next(numbers)}" if m[0] == "?" else m[0], sql)
        return self.spark.sql(named, args={f"p{k}": v for k, v in enumerate(params)})

    def by_section_type(self, *types: str) -> DataFrame:
        """Items of the given types; none given, none found."""
        return self.items.filter(F.col("section_type").isin(*types)) if types else self.items.limit(0)

    def skills(self) -> DataFrame:
        return self.by_section_type(*SKILLS)

    def bullets(self) -> DataFrame:
        return self.by_section_type(*BULLETS)
