"""Registry state from a stream of events (an extension: batch reconstruction is in operators.events)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "resume_name string, status string, last_ts timestamp, n_events long, violations long"


def registry_updates(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Latest status a resume, updated with each batch; an event older than the state counts as a violation and changes nothing.

    events: resume_name, ts, event_type, status. State is one small row a resume.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last, n, bad = state.get if state.exists else (None, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in rows.itertuples():
            at = r.ts.to_pydatetime()
            if last is not None and at < last:
                bad += 1
                continue
            n, last = n + 1, at
            if r.event_type in ("registration", "status_change"):
                status = r.status
        state.update((status, last, n, bad))
        yield pd.DataFrame({"resume_name": [key[0]], "status": [status], "last_ts": [last], "n_events": [n], "violations": [bad]})

    kept = events.withWatermark("ts", watermark).select("resume_name", "ts", "event_type", "status")
    return kept.groupBy("resume_name").applyInPandasWithState(step, OUTPUT, "status string, last_ts timestamp, n long, bad long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Events a window and type; windows close at the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
