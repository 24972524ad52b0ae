"""Small relational operators over registries, archives and item tables: lookups, misses, gates, sets and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses in which a type's documents may be acted on; a type that is not named may not, test documents always.
GATES = {
    "parse": {"historical": ("normalized", "parsing_failed")},
    "generate": {"experimental": ("drafting_completed",), "generated": ("targeting_completed", "templating_failed")},
    "normalise": {"historical": ("raw",)},
}
#: Types that an action without a status gate refuses.
REFUSED = {"validate": ("historical",)}
#: The statuses that an action sets when it ends well and when it fails (none: the status stays).
OUTCOMES = {
    "parse": ("parsed", "parsing_failed"),
    "generate": ("templating_completed", "templating_failed"),
    "normalise": ("normalized", None),
    "compile": ("compiling_completed", "compiling_failed"),
    "validate": ("validating_completed", "validating_failed"),
    "approve": ("approved", None),
}


def lookup(rows: DataFrame, **equal) -> DataFrame:
    """The first row with the given values, or none."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    return rows.limit(1)


def exists(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`keys` with boolean found: whether `rows` has the key."""
    return keys.join(rows.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def resolved(registry: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(registry rows with their file, keys without one)."""
    return registry.join(files, key), registry.join(files, key, "left_anti").select(key)


def archive_status(names: DataFrame, yaml: DataFrame, tex: DataFrame, key: str) -> DataFrame:
    """key, status: parsed where there is a structured file, else normalized where there is a LaTeX file, else raw."""
    has = lambda files, name: files.select(key).distinct().withColumn(name, F.lit(True))
    rows = names.select(key).join(has(yaml, "_y"), key, "left").join(has(tex, "_t"), key, "left")
    return rows.select(key, F.when(F.col("_y"), "parsed").when(F.col("_t"), "normalized").otherwise("raw").alias("status"))


def may(action: Column, kind: Column, status: Column) -> Column:
    """Whether a document of a type and status may be acted on."""
    out = ~action.isin(*GATES)
    for name, types in REFUSED.items():
        out = out & ~((action == name) & kind.isin(*types))
    for name, gates in GATES.items():
        for own, allowed in gates.items():
            out = out | ((action == name) & (kind == own) & status.isin(*allowed))
    return F.coalesce(out | (kind == "test"), F.lit(False))


def advance(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """resume_name, action, allowed, status: the status after each request (resume_name, action, ok), one a resume.

    A request that its gate refuses changes nothing, nor does one for a resume
    that is not registered (null status); compiling a historical document is
    only logged.
    """
    rows = requests.join(registry.select("resume_name", "resume_type", F.col("status").alias("_s")), "resume_name", "left")
    rows = rows.withColumn("allowed", may(F.col("action"), F.col("resume_type"), F.col("_s")) & F.col("_s").isNotNull())
    done = F.lit(None).cast("string")
    for name, (well, badly) in OUTCOMES.items():
        done = F.when(F.col("action") == name, F.when(F.col("ok"), F.lit(well)).otherwise(F.lit(badly).cast("string"))).otherwise(done)
    logged = (F.col("action") == "compile") & (F.col("resume_type") == "historical")
    return rows.select("resume_name", "action", "allowed", F.when(F.col("allowed") & ~logged, F.coalesce(done, "_s")).otherwise(F.col("_s")).alias("status"))


def grouped(rows: DataFrame, key: Column, order: str, value: str) -> DataFrame:
    """group, members: values by key in their order; null and empty keys go."""
    named = rows.select(key.cast("string").alias("group"), F.col(order).alias("_o"), F.col(value).alias("_v")).filter("group <> ''")
    return named.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("members"))


def items_by_section(items: DataFrame, names: list[str], case_sensitive: bool = False) -> DataFrame:
    """resume_name, section_name, items: a section's item texts in order, for the named sections."""
    own = F.col("section_name") if case_sensitive else F.lower("section_name")
    wanted = names if case_sensitive else [n.lower() for n in names]
    found = items.filter(own.isin(*wanted))
    return found.groupBy("resume_name", "section_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "item_text"))), lambda x: x["item_text"]).alias("items"))


def without_lines(lines: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text a pattern does not match; null texts stay."""
    return lines.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def first_contained(text: Column, table: dict[str, str]) -> Column:
    """Value of the first listed key that the text contains, else null."""
    out = F.lit(None).cast("string")
    for key, value in reversed(table.items()):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def without_nulls(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def only(values: Column, keys: tuple[str, ...]) -> Column:
    """The entries of a map under the given keys."""
    return F.map_filter(values, lambda k, _: k.isin(*keys))


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def shown(messages: Column, limit: int) -> Column:
    """The first messages, and how many more there are."""
    more = F.array(F.concat(F.lit("... and "), (F.size(messages) - limit).cast("string"), F.lit(" more")))
    return F.when(F.size(messages) > limit, F.concat(F.slice(messages, 1, limit), more)).otherwise(messages)


def preview(text: Column, max_lines: int = 5) -> Column:
    """The first lines of a text, and ... where there are more."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.when(F.size(lines) > max_lines, F.concat(F.slice(lines, 1, max_lines), F.array(F.lit("...")))).otherwise(lines), "\n")
