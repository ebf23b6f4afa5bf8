"""Streaming forms: windowed features and a Kalman filter per key."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType


def watermarked(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """events with a watermark; an event time without a zone is one of the session's zone."""
    if isinstance(events.schema[ts].dataType, TimestampNTZType):
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows, batch or stream."""
    if late:
        events = watermarked(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user: a gap ends one."""
    if late:
        events = watermarked(events, late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def kalman_stream(events: DataFrame, q: float = 1e-2, r: float = 1.0, late: str = "1 hour") -> DataFrame:
    """(user_id, n, x, p): the filtered level of each user's values as rows come.

    The rows of a micro-batch are put in order; rows that are older than the
    last one filtered can't be merged and are counted as late.
    """

    def step(key, batches, state: GroupState):
        n, x, p, last, dropped = json.loads(state.get[0]) if state.exists else (0, 0.0, 1e6, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, z in zip(rows["ts"], rows["value"]):
            at = ts.value
            if last is not None and at < last:
                dropped += 1
                continue
            p += q
            g = p / (p + r)
            x, p, n, last = x + g * (float(z) - x), (1 - g) * p, n + 1, at
        state.update((json.dumps([n, x, p, last, dropped]),))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "x": [x], "p": [p], "late": [dropped]})

    return watermarked(events, late).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, x double, p double, late long", "state string", "update", GroupStateTimeout.NoTimeout)


def kalman_batch(values: np.ndarray, q: float = 1e-2, r: float = 1.0) -> tuple[float, float]:
    x, p = 0.0, 1e6
    for z in values:
        p += q
        g = p / (p + r)
        x, p = x + g * (z - x), (1 - g) * p
    return x, p
