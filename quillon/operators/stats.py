"""Corpus statistics over (document, position, name) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def prevalence(rows: DataFrame, doc: str, name: str) -> DataFrame:
    """name, n_docs: documents that hold each name at least once."""
    return rows.select(doc, name).distinct().groupBy(name).agg(F.count("*").alias("n_docs"))


def distribution(rows: DataFrame, name: str) -> DataFrame:
    """name, n: rows of each value."""
    return rows.groupBy(name).agg(F.count("*").alias("n"))


def co_occurrence(rows: DataFrame, doc: str, position: str, name: str) -> DataFrame:
    """name_a, name_b, n: ordered pairs of different positions of a document; a repeated name pairs with itself.

    Counted from each document's count of each name, na * nb pairs or na * (na - 1)
    with itself, so the join is on distinct names and positions are never paired.
    """
    counts = rows.groupBy(doc, name).agg(F.count(position).alias("c"))
    left, right = (counts.select(doc, F.col(name).alias(f"name_{k}"), F.col("c").alias(f"c{k}")) for k in "ab")
    pairs = left.join(right, doc).withColumn("p", F.when(F.col("name_a") == F.col("name_b"), F.col("ca") * (F.col("ca") - 1)).otherwise(F.col("ca") * F.col("cb")))
    return pairs.filter("p > 0").groupBy("name_a", "name_b").agg(F.sum("p").alias("n"))


def top_partners(pairs: DataFrame, names: int, partners: int) -> DataFrame:
    """The most frequent names and, for each, its most frequent partners; ties by name. One pass over the pairs."""
    own = Window.partitionBy("name_a")
    ranked = pairs.withColumns({"total": F.sum("n").over(own), "place": F.row_number().over(own.orderBy(F.desc("n"), "name_b")).cast("long")})
    order = [F.desc("total"), "name_a"]
    # A name has at most `partners` rows, so the first names' rows are among so many.
    head = ranked.filter(F.col("place") <= partners).orderBy(*order, "place").limit(names * partners)
    return head.withColumn("_r", F.dense_rank().over(Window.orderBy(*order))).filter(F.col("_r") <= names).drop("_r")


def title_components(titles: DataFrame, doc: str, title: str, separator: str) -> DataFrame:
    """doc, position, component: parts of a title in order, stripped, empty ones dropped."""
    parts = F.filter(F.transform(F.split(F.col(title), separator, -1), T.strip), lambda x: x != "")
    return titles.select(doc, F.posexplode(parts).alias("position", "component"))


def counts_with_zero(parents: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """key, n: children of each parent, 0 kept."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("n"))
    return parents.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keyword_counts(docs: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """keyword, n_docs, n_occurrences, n_chars: one pass over the texts; keywords found nowhere are kept with 0.

    n_docs counts texts that contain the keyword in any case, n_chars their length.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    parts = []
    for k, word in enumerate(keywords):
        has = F.contains(low, F.lit(word.lower()))
        parts += [F.sum(has.cast("long")).alias(f"d{k}"), F.sum(T.occurrences(low, F.lit(word.lower()))).alias(f"o{k}"), F.sum(F.when(has, F.char_length(F.col(text))).otherwise(0)).cast("long").alias(f"c{k}")]
    wide = docs.agg(*parts)
    rows = [F.struct(F.lit(w).alias("keyword"), *(F.coalesce(F.col(f"{a}{k}"), F.lit(0)).cast("long").alias(n) for a, n in (("d", "n_docs"), ("o", "n_occurrences"), ("c", "n_chars")))) for k, w in enumerate(keywords)]
    return wide.select(F.inline(F.array(*rows)))


def contains_text(column: Column, word: str, case_sensitive: bool = False) -> Column:
    """Literal substring test; null texts do not match."""
    return F.coalesce(F.contains(column, F.lit(word)) if case_sensitive else F.contains(F.lower(column), F.lit(word.lower())), F.lit(False))


def search_field(rows: DataFrame, field: str, patterns: list[str], matches: bool = False, case_sensitive: bool = False) -> DataFrame:
    """pattern, n (every pattern kept), or with `matches` pattern and row for each hit."""
    hit = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), contains_text(F.col(field), p, case_sensitive).alias("hit")) for p in patterns]))
    found = rows.withColumn("_p", hit).withColumn("pattern", F.col("_p.pattern"))
    if matches:
        return found.filter("_p.hit").drop("_p")
    return found.groupBy("pattern").agg(F.sum(F.col("_p.hit").cast("long")).alias("n"))


def percent_of_total(counts: DataFrame, n: str = "n", digits: int = 1) -> DataFrame:
    """counts with percent; a total of 0 gives 0."""
    total = counts.agg(F.sum(n).alias("_total"))
    share = F.when(F.col("_total") > 0, F.round(100.0 * F.col(n) / F.col("_total"), digits)).otherwise(F.lit(0.0))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", share).drop("_total")


def field_values(rows: DataFrame, fields: Column) -> DataFrame:
    """field, value, n of a map column."""
    return rows.select(F.explode(fields).alias("field", "value")).groupBy("field", "value").agg(F.count("*").alias("n"))


def validation_summary(results: DataFrame, passed: Column, failed: Column, diffs: Column) -> DataFrame:
    """One row: total, passed, failed, perfect (no differences), differences and pass rate."""
    return results.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(failed).alias("failed"), F.count_if(diffs == 0).alias("perfect"), F.sum(diffs).cast("long").alias("diffs"), F.round(100.0 * F.count_if(passed) / F.count("*"), 1).alias("pass_rate"))


def sorted_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, n by key."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).orderBy("key")
