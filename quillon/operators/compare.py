"""Comparison of documents: canonical hashes, meaningful diffs, sequence diffs."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def meaningful_diff(before: str, after: str, context: int = 3) -> tuple[list[str], int]:
    """Unified diff of the non-blank lines and its number of changed lines."""
    a, b = ([x for x in t.split("\n") if x.strip()] for t in (before or "", after or ""))
    lines = list(difflib.unified_diff(a, b, lineterm="", n=context))
    return lines, sum(x[:1] in "+-" and x[:3] not in ("+++", "---") for x in lines)


def diff_counts(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, n_diffs of each pair of texts, row by row in Arrow batches."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf["k"], "n_diffs": [meaningful_diff(a, b)[1] for a, b in zip(pdf["a"], pdf["b"], strict=True)]})

    return pairs.select(F.col(key).alias("k"), F.col(before).alias("a"), F.col(after).alias("b")).mapInPandas(run, f"{key} {kind}, n_diffs long")


def opcodes(before: list[str], after: list[str]) -> list[tuple[str, int, int, int, int]]:
    """equal, replace, delete and insert blocks between two sequences of cells."""
    return difflib.SequenceMatcher(a=before, b=after, autojunk=False).get_opcodes()


def canonical_json(text: Column) -> Column:
    """JSON with recursively sorted keys, so that equal documents have equal text; unparsable text stays."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return t

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, StringType())(text)


def changed(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, change (added, removed, changed) between two tables, by content hash."""
    a, b = (d.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(h)) for d, h in ((left, "_a"), (right, "_b")))
    both = a.join(b, key, "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, kind.alias("change")).filter("change is not null")


def fill_defaults(actual: Column, defaults: Column) -> Column:
    """Map with defaults for the keys it lacks."""
    return F.map_zip_with(defaults, actual, lambda _, d, a: F.coalesce(a, d))


def count_new_fields(before, after) -> int:
    """Fields of nested dictionaries and lists that only `after` has."""
    if isinstance(after, dict):
        old = before if isinstance(before, dict) else {}
        return sum((0 if k in old else 1) + count_new_fields(old.get(k), v) for k, v in after.items())
    if isinstance(after, list):
        old = before if isinstance(before, list) else []
        return sum(count_new_fields(old[k] if k < len(old) else None, v) for k, v in enumerate(after))
    return 0


def document_diff(before: dict, after: dict, context: int = 3) -> tuple[list[str], int]:
    """`meaningful_diff` of two nested documents, written with sorted keys, a value a line."""
    a, b = (json.dumps(d, sort_keys=True, indent=1, ensure_ascii=False) for d in (before, after))
    return meaningful_diff(a, b, context)
