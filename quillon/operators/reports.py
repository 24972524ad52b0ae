"""Text tables from small result frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Column:
    title: str
    width: int
    right: bool = False

    def cell(self, value: object) -> str:
        text = "" if value is None else str(value)
        text = text if len(text) <= self.width else text[: self.width - 3] + "..."
        return text.rjust(self.width) if self.right else text.ljust(self.width)


def table(columns: list[Column], rows: list[tuple], title: str = "") -> str:
    """A fixed-width table; ValueError for a row of another length."""
    head = " ".join(c.cell(c.title) for c in columns).rstrip()
    out = [title, "=" * len(title)] if title else []
    out += [head, "-" * len(head)]
    for row in rows:
        if len(row) != len(columns):
            raise ValueError(f"{len(row)} cells for {len(columns)} columns")
        out.append(" ".join(c.cell(v) for c, v in zip(columns, row, strict=True)).rstrip())
    return "\n".join(out) + "\n"


def percentage(count: int, total: int, digits: int = 1) -> str:
    return f"{100 * count / total if total else 0:.{digits}f}%"


def frequency_report(counts: DataFrame, name: str, n: str, total: int, title: str, top: int = 20, width: int = 58) -> str:
    """The `top` most frequent values with their share of `total`; ties by name."""
    rows = [(r[name], r[n], percentage(r[n], total)) for r in counts.orderBy(F.desc(n), name).limit(top).collect()]
    return table([Column(name, width), Column("count", 8, True), Column("share", 8, True)], rows, title)


def cell(value: Expression, width: int, right: bool = False) -> Expression:
    """A value as text of a fixed width: longer ones end in ..., shorter ones are padded."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    shown = F.when(F.char_length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)
    return F.lpad(shown, width, " ") if right else F.rpad(shown, width, " ")


def count_lines(counts: DataFrame, name: str, n: str, top: int, width: int) -> DataFrame:
    """place, line: the `top` most frequent values, their counts and their share of all, a line each; ties by name. 0 gives all."""
    total = counts.agg(F.sum(n).alias("_total"))
    ranked = counts.orderBy(F.desc(n), name)
    ranked = (ranked.limit(top) if top else ranked).join(F.broadcast(total))  # one row
    place = F.row_number().over(Window.orderBy(F.desc(n), name))
    share = F.format_string("%.1f%%", F.col(n) * 100.0 / F.col("_total"))
    return ranked.select(place.alias("place"), F.rtrim(F.concat_ws(" ", cell(F.col(name), width), cell(F.col(n), 8, True), cell(share, 8, True))).alias("line"))


def partner_lines(partners: DataFrame, width: int = 58) -> DataFrame:
    """name_a, place, line of the most frequent partners of each name."""
    return partners.select("name_a", "place", F.concat(F.lit("  "), cell(F.col("name_b"), width), F.lit(" "), cell(F.col("n"), 8, True)).alias("line"))


def timeline_lines(events: DataFrame, key: str) -> DataFrame:
    """key, place, line of each status change (place, timestamp, previous_state, state): the first has no state before."""
    before = F.coalesce("previous_state", F.lit("(none)"))
    return events.select(key, "place", F.concat(F.col("timestamp").cast("string"), F.lit("  "), before, F.lit(" -> "), "state").alias("line"))


def layout_feedback(diagnosed: DataFrame) -> DataFrame:
    """doc, place, line: missing sections first, numbered, then those that run over."""
    told = diagnosed.filter(F.col("issue").isin("missing", "overflow", "unfinished"))
    rank = F.when(F.col("issue") == "missing", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("doc").orderBy(rank, "section_ord"))
    text = F.when(F.col("issue") == "missing", F.concat("name", F.lit(" is missing"))).when(F.col("issue") == "unfinished", F.concat("name", F.lit(" does not end"))).otherwise(F.concat("name", F.lit(" runs over to page "), F.col("end_page").cast("string")))
    return told.select("doc", place.alias("place"), F.concat(place.cast("string"), F.lit(". "), text).alias("line"))


def tree_lines(tree: DataFrame, key: str) -> DataFrame:
    """key, node_id, line: headings indented by their level, with the length of their content."""
    return tree.select(key, "node_id", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "title", F.lit(" ("), F.char_length("content").cast("string"), F.lit(")")).alias("line"))


def checklist(fields: Expression, names: tuple[str, ...]) -> Expression:
    """array of lines: each field with its value, or marked as missing."""
    return F.array(*[F.when(F.try_element_at(fields, F.lit(n)).isNotNull(), F.concat(F.lit(f"[x] {n}: "), F.try_element_at(fields, F.lit(n)))).otherwise(F.lit(f"[ ] {n}")) for n in names])
