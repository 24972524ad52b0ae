"""Readers and writers of the document stores' formats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import shown

REGISTRY_SCHEMA = "resume_name string, resume_type string, status string, last_updated string"
#: Columns of the job registry.
JOB_REGISTRY_COLUMNS = ("Job Identifier", "Company", "Role", "Location", "Salary", "Work Mode", "Job ID", "Source", "URL", "Clearance", "List Date")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The CSV registry."""
    return spark.read.csv(path, schema=REGISTRY_SCHEMA, header=True)


def job_registry(spark: SparkSession, path: str) -> DataFrame:
    """The all-quoted CSV of jobs; every column is text."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def events(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON Lines events with their extras as a map; malformed lines are left out. log_order is the line's place in its file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("log_order"), "value", F.from_json("value", "map<string,string>").alias("m"))
    good = lines.filter(F.col("m").isNotNull() & F.map_contains_key("m", F.lit("event_type")))
    fixed = ("timestamp", "event_type", "resume_name", "source", "resume_type", "status", "old_status", "new_status")
    extras = F.map_filter("m", lambda k, _: ~k.isin(*fixed))
    return good.select("log_order", *[F.try_element_at("m", F.lit(c)).alias(c) for c in fixed], extras.alias("extras"))


def append_events(rows: DataFrame, path: str) -> None:
    """Append rows as JSON Lines."""
    rows.write.mode("append").json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, name (file stem), text of whole files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("name", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))


def interpolated(data, root=None):
    """Nested data with each ${dotted.path} replaced by what stands there; a text that is one reference alone keeps the value's kind. KeyError where there is nothing."""
    root = data if root is None else root

    def value(path: str):
        out = root
        for step in path.split("."):
            out = out[int(step)] if isinstance(out, list) else out[step]
        return interpolated(out, root)

    if isinstance(data, dict):
        return {k: interpolated(v, root) for k, v in data.items()}
    if isinstance(data, list):
        return [interpolated(v, root) for v in data]
    if isinstance(data, str) and "${" in data:
        whole = re.fullmatch(r"\$\{([^${}]+)\}", data)
        return value(whole[1]) if whole else re.sub(r"\$\{([^${}]+)\}", lambda m: str(value(m[1])), data)
    return data


def error_summary(documents: DataFrame, limit: int = 10) -> DataFrame:
    """n_errors, messages: the first errors of a tolerant read by path, and how many more there are."""
    told = F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("path", "error")))), lambda e: F.concat_ws(": ", e["path"], e["error"]))
    return documents.agg(told.alias("_m")).select(F.size("_m").alias("n_errors"), shown(F.col("_m"), limit).alias("messages"))


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, name, json, error: YAML files as JSON text; a file that fails keeps its error instead of ending the read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for p, n, t in zip(pdf["path"], pdf["name"], pdf["text"], strict=True):
                try:
                    data = interpolated(yaml.safe_load(t))
                    bad = None if isinstance(data, dict) and "document" in data else "no document"
                    out.append((p, n, None if bad else json.dumps(data, default=str), bad))
                except (yaml.YAMLError, KeyError, IndexError, TypeError, ValueError, RecursionError) as e:
                    out.append((p, n, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "name", "json", "error"])

    return texts(spark, path).select("path", "name", "text").mapInPandas(run, "path string, name string, json string, error string")


_ITEM = "struct<plaintext:string,latex_raw:string,text:string>"
_CONTENT = f"struct<items:array<{_ITEM}>,bullets:array<{_ITEM}>,projects:array<struct<metadata:map<string,string>,content:struct<bullets:array<{_ITEM}>>,bullets:array<{_ITEM}>>>>"
_SUB = f"struct<type:string,metadata:map<string,string>,content:{_CONTENT}>"
_SECTION = f"struct<type:string,metadata:map<string,string>,content:{_CONTENT},subsections:array<{_SUB}>>"
DOCUMENT_SCHEMA = f"struct<document:struct<metadata:map<string,string>,pages:array<struct<page_number:int,regions:map<string,struct<sections:array<{_SECTION}>>>>>>>"


def sections(documents: DataFrame) -> DataFrame:
    """Sections of `yaml_documents` rows in page, region and section order, in the shape that items are flattened from."""
    d = documents.filter("error is null").withColumn("d", F.from_json("json", DOCUMENT_SCHEMA))
    pages = d.select("name", "path", F.posexplode("d.document.pages").alias("page", "p"))
    regions = pages.select("name", "path", "page", F.posexplode(F.map_entries("p.regions")).alias("r", "e"))
    rows = regions.select("name", "path", "page", "r", F.col("e.key").alias("region"), F.posexplode("e.value.sections").alias("s_ord", "s"))
    text = lambda x: F.coalesce(x["plaintext"], x["text"], x["latex_raw"])
    plain = lambda c: F.transform(F.coalesce(c["items"], c["bullets"]), text)
    pick = lambda m, k: F.try_element_at(m, F.lit(k))

    def project(p):
        return F.struct(pick(p["metadata"], "name").alias("name"), F.transform(F.coalesce(p["content"]["bullets"], p["bullets"]), text).alias("items"))

    def sub(x):
        m = x["metadata"]
        return F.struct(x["type"].alias("type"), pick(m, "name").alias("name"), pick(m, "company").alias("company"), pick(m, "title").alias("title"), pick(m, "dates").alias("dates"), plain(x["content"]).alias("items"), F.transform(x["content"]["projects"], project).alias("projects"))

    order = (F.col("page") * 1_000_000 + F.col("r") * 1_000 + F.col("s_ord")).cast("long")
    return rows.select(F.col("name").alias("resume_name"), F.xxhash64("path").alias("resume_ord"), "path", order.alias("section_ord"), (F.col("page") + 1).alias("page_number"), "region", pick(F.col("s.metadata"), "name").alias("section_name"), F.col("s.type").alias("section_type"), plain(F.col("s.content")).alias("items"), F.transform("s.subsections", sub).alias("subsections"))


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, cell, cell_type, source of notebooks; cells of white space are left out."""
    raw = texts(spark, path).withColumn("nb", F.from_json("text", "struct<cells:array<struct<cell_type:string,source:string>>>"))
    cells = raw.select("path", F.posexplode("nb.cells").alias("cell", "c")).withColumn("s", F.from_json("c.source", "array<string>"))
    joined = F.when(F.startswith("c.source", F.lit("[")) & F.col("s").isNotNull(), F.array_join("s", "")).otherwise(F.col("c.source"))
    return cells.select("path", "cell", F.col("c.cell_type").alias("cell_type"), joined.alias("source")).filter(F.col("source").rlike(r"\S"))


def file_path(base: str, resume_type, name, kind: str):
    """Column: where a document's file of a kind (tex, pdf, yaml, raw) lies."""
    folder = {"tex": "", "pdf": "compiled/", "yaml": "structured/", "raw": "raw/"}[kind]
    return F.concat(F.lit(base.rstrip("/") + "/"), resume_type, F.lit(f"/{folder}"), name, F.lit({"raw": ".tex"}.get(kind, f".{kind}")))


def presets(config: dict[str, dict[str, dict]]) -> dict[str, dict]:
    """Two levels of presets as category_name -> settings."""
    return {f"{category}_{name}": dict(settings) for category, own in config.items() for name, settings in own.items()}


def apply_presets(config: dict, table: dict[str, dict], names: list[str]) -> dict:
    """Shallow updates in order, later ones winning; ValueError for an unknown preset."""
    out = dict(config)
    for n in names:
        if n not in table:
            raise ValueError(f"unknown preset {n}")
        out |= table[n]
    return out


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ensure_registry(spark: SparkSession, path: str, schema: str = REGISTRY_SCHEMA) -> DataFrame:
    """The CSV registry at `path`; an empty one is written first where there is none."""
    if not _there(spark, path):
        spark.createDataFrame([], schema).write.csv(path, header=True)
    return spark.read.csv(path, schema=schema, header=True)


def write_reconstruction(registry_rows: DataFrame, path: str) -> None:
    """A registry rebuilt from its log, as CSV; FileExistsError where something is already there."""
    if _there(registry_rows.sparkSession, path):
        raise FileExistsError(path)
    registry_rows.coalesce(1).write.mode("error").csv(path, header=True)


def find_text(rows: DataFrame, name: str) -> DataFrame:
    """The row of `texts` with the stem `name`, else the first by name that equals it but for case, or none."""
    own = rows.filter(F.lower("name") == name.lower())
    return own.orderBy(F.col("name") != name, "name").limit(1)


def write_yaml(documents: DataFrame, json_column: str):
    """`documents` with column yaml: the JSON column as YAML text that ends in one line break."""
    import yaml

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else yaml.safe_dump(json.loads(t), sort_keys=False, allow_unicode=True).rstrip() + "\n")

    return documents.withColumn("yaml", F.pandas_udf(run, "string")(json_column))
