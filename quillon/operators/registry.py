"""Registries kept as tables: registration, updates, counts, gates and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex

#: Statuses by resume type.
CROSS_CUTTING = ("review", "archived", "cancelled")
_COMPILE = ("templating", "templating_failed", "templating_completed", "compiling", "compiling_failed", "compiling_completed", "validating", "validating_failed", "validating_completed", "approved")
HISTORICAL = ("raw", "normalized", "parsed", "parsing_failed", *CROSS_CUTTING)
GENERATED = ("pending", "targeting", "targeting_failed", "targeting_completed", *_COMPILE, *CROSS_CUTTING)
EXPERIMENTAL = ("drafting", "drafting_completed", *_COMPILE, *CROSS_CUTTING)
ALLOWED = {"historical": HISTORICAL, "generated": GENERATED, "experimental": EXPERIMENTAL, "test": tuple(dict.fromkeys((*HISTORICAL, *GENERATED, *EXPERIMENTAL)))}
#: Statuses with which a type's documents are loaded; other types are loaded with any.
LOAD_GATES = {"historical": ("parsed",), "experimental": ("approved",)}


def register_new(existing: DataFrame, batch: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows to add, one row added/skipped): first of each new non-empty key in batch order."""
    first = batch.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.min(F.struct(order, *[c for c in batch.columns if c not in (order, key)])).alias("_r"))
    fresh = first.join(existing.select(key).distinct(), key, "left_anti").select(key, "_r.*").select(*batch.columns)
    summary = batch.agg(F.count("*").alias("total")).crossJoin(fresh.agg(F.count("*").alias("added"))).select("added", (F.col("total") - F.col("added")).alias("skipped"))
    return fresh, summary


def update_status(registry: DataFrame, updates: DataFrame, key: str, now) -> tuple[DataFrame, DataFrame]:
    """(registry with new statuses, key and found for each update): `updates` has key and status, one row a key."""
    new = updates.select(key, F.col("status").alias("_new"))
    out = registry.join(new, key, "left").withColumn("last_updated", F.when(F.col("_new").isNotNull(), now).otherwise(F.col("last_updated"))).withColumn("status", F.coalesce("_new", "status"))
    found = new.join(registry.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").select(key, F.coalesce("_f", F.lit(False)).alias("found"))
    return out.select(*registry.columns), found


def counts(registry: DataFrame, *columns: str) -> DataFrame:
    """Total and counts by each column: one grouping-sets aggregation; `by` names the column, null for the total."""
    sets = [[], *[[F.col(c)] for c in columns]]
    rows = registry.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(columns)) - 1
    by = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for k, c in enumerate(columns):
        mine = F.col("g") == full - (1 << (len(columns) - 1 - k))
        by, value = F.when(mine, F.lit(c)).otherwise(by), F.when(mine, F.col(c).cast("string")).otherwise(value)
    return rows.select(by.alias("by"), value.alias("value"), "n")


def gated(registry: DataFrame, gates: dict[str, tuple[str, ...]], kind: str, status: str) -> DataFrame:
    """Rows whose status their type's gate lets through; types without a gate pass."""
    ok = ~F.col(kind).isin(*gates) if gates else F.lit(True)
    for name, allowed in gates.items():
        ok = ok | ((F.col(kind) == name) & F.col(status).isin(*allowed))
    return registry.filter(F.coalesce(ok, F.lit(True)))


def search_names(registry: DataFrame, name: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Substring search, or a whole-name match for a pattern with * ? or [set]."""
    column = F.lower(name) if ignore_case else F.col(name)
    pattern = pattern.lower() if ignore_case else pattern
    return registry.filter(column.rlike(glob_to_regex(pattern)) if set("*?[") & set(pattern) else F.contains(column, F.lit(pattern)))


def most_recent(registry: DataFrame, status: str, name: str, updated: str) -> DataFrame:
    """The entry of a status with the greatest update time; ties by name."""
    return registry.filter(F.col("status") == status).orderBy(F.desc(updated), name).limit(1)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right of the values whose counts differ."""
    a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_left", "n_right")])
    return both.filter("n_left <> n_right")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
