"""Live views of runs by Structured Streaming: sessions, latest states and throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THROTTLE_MS, THROTTLE_STEP = 400, 0.01


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): sessions ended by a gap; rows later than ``late`` fall out."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def hopping_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """(event_type, start, n): 12-hour windows every 10 hours."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("event_type", F.window("ts", "12 hours", "10 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("event_type", F.col("w.start").alias("start"), "n")


def throttled(progress: DataFrame) -> DataFrame:
    """A stream of (run, at_ms, fraction) with what comes less than 400 ms or 1 % after the last one left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, fraction = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("at_ms")
        keep = []
        for t, x in zip(rows["at_ms"], rows["fraction"]):
            if at is None or (t - at >= THROTTLE_MS and abs(x - fraction) >= THROTTLE_STEP):
                at, fraction = int(t), float(x)
                keep.append((key[0], at, fraction))
        if at is not None:
            state.update((at, fraction))
        yield pd.DataFrame(keep, columns=["run", "at_ms", "fraction"])

    kind = progress.schema["run"].dataType.simpleString()
    return progress.groupBy("run").applyInPandasWithState(
        step, f"run {kind}, at_ms long, fraction double", "at_ms long, fraction double", "append", "NoTimeout"
    )


def lease_stream(requests: DataFrame) -> DataFrame:
    """A stream of (project_id, seq, kind, generation) as (project_id, seq, kind, generation, granted), by the
    rules of ``operators.runs.leases``; a batch's requests of a project are taken by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, active = state.get if state.exists else (0, 0)  # no run is generation 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, kind, asked in zip(rows["seq"], rows["kind"], rows["generation"]):
            shown, granted = (None if pd.isna(asked) else int(asked)), False
            if kind == "start" and not active:
                last = active = last + 1
                shown, granted = active, True
            elif kind == "cancel" and active:
                shown, granted = active, True
            elif kind == "finish" and active and shown == active:
                active, granted = 0, True
            out.append((key[0], int(seq), kind, shown, granted))
        state.update((last, active))
        yield pd.DataFrame(out, columns=["project_id", "seq", "kind", "generation", "granted"]).astype({"generation": "Int64"})

    kind = requests.schema["project_id"].dataType.simpleString()
    return requests.groupBy("project_id").applyInPandasWithState(
        step, f"project_id {kind}, seq long, kind string, generation long, granted boolean", "last long, active long", "append", "NoTimeout"
    )
