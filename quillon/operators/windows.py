"""Order-dependent operators: islands, extents, anchored clusters, page breaks, heading trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_breaks(rows: DataFrame, doc: str, order: str, page: str, first: int = 1) -> DataFrame:
    """rows with page_break: whether the page differs from the row's before, page `first` standing before a document."""
    before = F.lag(page, 1, first).over(Window.partitionBy(doc).orderBy(order))
    return rows.withColumn("page_break", before != F.col(page))


def extents(markers: DataFrame, doc: str, start: str, end_of_doc: str) -> DataFrame:
    """markers with extent_end: where the next marker of the document starts, else the document's end."""
    following = F.lead(start).over(Window.partitionBy(doc).orderBy(start))
    return markers.withColumn("extent_end", F.coalesce(following, F.col(end_of_doc)))


def islands(lines: DataFrame, doc: str, order: str, is_header: Column) -> DataFrame:
    """lines with island: 0 before the first header, then counting headers."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("island", F.sum(F.when(is_header, 1).otherwise(0)).over(w).cast("long"))


def anchored_clusters(values: Column, tolerance: float) -> Column:
    """Cluster number of each element of a sorted array: a new cluster starts where a value is beyond `tolerance` of its cluster's first.

    One pass an array in Arrow batches: a built-in fold would copy what it has gathered at every element.
    """

    @F.pandas_udf("array<int>")
    def numbers(arrays: pd.Series) -> pd.Series:
        def one(own) -> list[int] | None:
            if own is None:
                return None
            out, anchor, n = [], None, -1
            for v in own:
                if anchor is None or abs(v - anchor) > tolerance:
                    anchor, n = v, n + 1
                out.append(n)
            return out

        return arrays.map(one)

    return numbers(values)


def heading_parents(headings: DataFrame, doc: str, order: str, level: str, deepest: int = 6) -> DataFrame:
    """headings with parent: order of the last earlier heading of a smaller level that no heading between closes."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = headings.withColumns({f"_l{k}": F.max(F.when(F.col(level) == k, F.col(order))).over(w) for k in range(1, deepest + 1)})
    smaller = [F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, deepest + 1)]
    return marked.withColumn("parent", F.greatest(*smaller)).drop(*[f"_l{k}" for k in range(1, deepest + 1)])
