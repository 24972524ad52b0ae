"""Append-only event logs: tails, registry reconstruction, timelines and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_of() -> Column:
    """Status that a mutative event sets, null for the others."""
    return F.when(F.col("event_type") == "registration", F.col("status")).when(F.col("event_type") == "status_change", F.col("new_status"))


def recent(events: DataFrame, order: list[str], n: int, **equal: str | None) -> DataFrame:
    """The last n events (all for 0) in their order; a filter that is empty or None filters nothing."""
    for column, value in equal.items():
        if value:
            events = events.filter(F.col(column) == value)
    if n == 0:
        return events.orderBy(*order)
    return events.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and `columns` of each key's last event. A maximum of structs, so a hot key is pre-aggregated and never sorted."""
    top = events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_top"))
    return top.select(key, *[F.col(f"_top.{c}").alias(c) for c in columns])


def chronology_violations(events: DataFrame, key: str, order: str, ts: str, descending: bool = False) -> DataFrame:
    """Events whose time goes against their key's order, with the time before."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(order))
    wrong = (F.col(ts) > F.col("previous")) if descending else (F.col(ts) < F.col("previous"))
    return events.withColumn("previous", before).filter(wrong)


def reconstruct(events: DataFrame, order: str = "log_order", descending: bool = False) -> DataFrame:
    """resume_name, resume_type, status, last_updated in log order: one row a registration, with the last mutative event's state.

    ValueError if a resume's mutative events are out of order.
    """
    mutative = events.filter(F.col("event_type").isin("registration", "status_change")).withColumn("_status", status_of())
    if not chronology_violations(mutative, "resume_name", order, "timestamp", descending).isEmpty():
        raise ValueError("events out of chronological order")
    sign = -F.col(order) if descending else F.col(order)
    last = mutative.groupBy("resume_name").agg(F.max_by(F.struct("_status", "timestamp"), sign).alias("_last"))
    rows = events.filter("event_type = 'registration'").select(order, "resume_name", "resume_type").join(last, "resume_name")
    return rows.select(order, "resume_name", "resume_type", F.col("_last._status").alias("status"), F.col("_last.timestamp").alias("last_updated")).orderBy(order)


def timeline(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Each event with its key's previous state and 0-based place."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumns({"previous_state": F.lag(state).over(w), "place": (F.row_number().over(w) - 1).cast("long")})


def discontinuities(changes: DataFrame, key: str, order: str, old: str = "old_status", new: str = "new_status") -> DataFrame:
    """Changes whose old status is not the new status before, with their 0-based place."""
    w = Window.partitionBy(key).orderBy(order)
    rows = changes.withColumns({"expected": F.lag(new).over(w), "place": (F.row_number().over(w) - 1).cast("long")})
    return rows.filter((F.col("place") > 0) & ~F.col("expected").eqNullSafe(F.col(old)))


def route_compile_event(resume_type: Column) -> Column:
    """Historical resumes only log activity; the others change status."""
    return F.when(resume_type == "historical", F.lit("logged_activity")).otherwise(F.lit("status_change"))
