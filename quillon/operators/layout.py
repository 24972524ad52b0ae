"""Layout: characters to lines, and sections matched against page columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import anchored_clusters

MATCH = 30


def lines(chars: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc, page, col, line, text from characters (doc, page, col, x0, top, text): a line holds what lies within `tolerance` of its first character."""
    page = chars.groupBy("doc", "page", "col").agg(F.sort_array(F.collect_list(F.struct("top", "x0", "text"))).alias("c"))
    numbered = page.withColumn("n", anchored_clusters(F.transform("c", lambda c: c["top"].cast("double")), tolerance))
    rows = numbered.select("doc", "page", "col", F.inline(F.zip_with("c", "n", lambda c, n: F.struct(n.alias("line"), c["x0"].alias("x0"), c["text"].alias("t")))))
    return rows.groupBy("doc", "page", "col", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "t"))), lambda c: c["t"]), "").alias("text"))


def text_fonts(chars: DataFrame, font: str, allowed: list[str]) -> DataFrame:
    """Characters whose font, without its subset prefix, contains an allowed name."""
    name = F.regexp_replace(font, "^[A-Z]{6}\\+", "")
    return chars.filter(F.exists(F.array(*map(F.lit, allowed)), lambda a: F.contains(name, a)))


def normalised(text: str | None) -> str:
    return re.sub(r"[\W_]", "", (text or "").lower())


def diagnose(sections: DataFrame, page_lines: DataFrame) -> DataFrame:
    """doc, section_ord, name, expected_page, found_page, end_page, overflow, issue: one document at a time.

    sections: doc, section_ord, page, col, name, content. A section begins where
    its name is a whole line and its first MATCH characters follow in the
    column, on the page it is expected on or the next; it ends on the first page
    that holds its last MATCH characters. Within a column, a section found a
    page late or running over pushes the later ones back; the most that any
    column of a page was pushed pushes all later pages. A section expected
    beyond the last page is missing.
    """

    def match(key: tuple, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        streams, headers = {}, {}
        for (page, col), part in have.sort_values("line").groupby(["page", "col"]):
            streams[page, col] = "".join(map(normalised, part["text"]))
            headers[page, col] = {normalised(t) for t in part["text"]}
        last = max((p for p, _ in streams), default=0)

        def begins(page: int, col: int, name: str, stream: str) -> int:
            return streams.get((page, col), "").find(stream[:MATCH]) if normalised(name) in headers.get((page, col), ()) else -1

        out, before = [], 0
        for page, on_page in want.sort_values("section_ord").groupby("page"):
            pushed = 0
            for col, column in on_page.groupby("col"):
                late = 0
                for r in column.itertuples():
                    stream, due = normalised(r.content), page + before + late
                    tries = [(p, begins(p, col, r.name, stream)) for p in (due, due + 1) if p <= last]
                    found, at = next(((p, a) for p, a in tries if a >= 0), (None, -1))
                    end = None
                    if found is not None:
                        text = ""
                        for p in range(found, last + 1):
                            text += streams.get((p, col), "")[at if p == found else 0 :]
                            if stream[-MATCH:] in text:
                                end = p
                                break
                        late += (found - due) + (end - found if end is not None else 0)
                    over = 0 if end is None else end - due
                    issue = "missing" if found is None else "unfinished" if end is None else "overflow" if end > found else "bumped" if found > due else None
                    out.append((key[0], r.section_ord, r.name, due if due <= last else None, found, end, over, issue))
                pushed = max(pushed, late)
            before += pushed
        pages = ["expected_page", "found_page", "end_page"]
        return pd.DataFrame(out, columns=["doc", "section_ord", "name", *pages, "overflow", "issue"]).astype(dict.fromkeys(pages, "Int64"))

    kind = sections.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, section_ord long, name string, expected_page long, found_page long, end_page long, overflow long, issue string"
    return sections.groupBy("doc").cogroup(page_lines.groupBy("doc")).applyInPandas(match, schema)


def issues(diagnosed: DataFrame) -> DataFrame:
    """doc, n_issues, is_valid, issues: what sections report, rolled up in document order."""
    told = F.sort_array(F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("section_ord", F.concat_ws(": ", "name", "issue").alias("t")))))
    rows = diagnosed.groupBy("doc").agg(told.alias("_t"))
    return rows.select("doc", F.size("_t").cast("long").alias("n_issues"), (F.size("_t") == 0).alias("is_valid"), F.transform("_t", lambda x: x["t"]).alias("issues"))


def find_all(page_lines: DataFrame, text: str, whole_line: bool = False, column: int | None = None, limit: int | None = None) -> DataFrame:
    """Lines that hold the text, letters, digits and case alone counting, or are it, by page, column and line; the first `limit` if given."""
    key, want = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", ""), normalised(text)
    found = page_lines.filter(key == want if whole_line else F.contains(key, F.lit(want)))
    found = found if column is None else found.filter(F.col("col") == column)
    return found if limit is None else found.orderBy("page", "col", "line").limit(limit)
