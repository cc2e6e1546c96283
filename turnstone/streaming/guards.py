"""Structured Streaming operators: repetition guard, duplicate drop, sessions, metric windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S, TRIP_AT = 120.0, 10


def guard_step(times: list[float], now: float, window: float = WINDOW_S, trip_at: int = TRIP_AT) -> tuple[list[float], bool]:
    """The calls kept after one more at now, and whether it trips; a tripped call is not recorded."""
    times = [t for t in times if now - t < window]
    if len(times) >= trip_at:
        return times, True
    return [*times, now], False


def repetition_guard(calls: DataFrame, window: float = WINDOW_S, trip_at: int = TRIP_AT) -> DataFrame:
    """calls (key, at double, call_id) -> (key, call_id, tripped), statefully for each key; state is at most trip_at times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "call_id"])
        out = []
        for at, call in zip(rows["at"], rows["call_id"], strict=True):
            times, tripped = guard_step(times, float(at), window, trip_at)
            out.append((key[0], int(call), tripped))
        state.update((times,))
        yield pd.DataFrame(out, columns=["key", "call_id", "tripped"])

    return calls.groupBy("key").applyInPandasWithState(run, "key long, call_id long, tripped boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def drop_resent(events: DataFrame, rest: str, seconds: float = 600.0) -> DataFrame:
    """events (key, at double, and the columns of rest, event_id first) without those whose key was seen so recently.

    A dropped event counts as seen, too. State is the time of a key's last event.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        before = rows["at"].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((float(rows["at"].iloc[-1]),))
        yield rows[before.isna() | (rows["at"] - before > seconds)].drop(columns=["key", "at"])

    return events.groupBy("key").applyInPandasWithState(run, rest, "at double", "append", GroupStateTimeout.NoTimeout)


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def metric_windows(events: DataFrame, kind: str, ts: str, width: str = "1 hour", late: str = "24 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(kind, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(kind, F.col("w.start").alias("starts"), "n")
