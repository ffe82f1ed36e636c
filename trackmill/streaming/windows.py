"""Event-time windows and per-track state over streams of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "misses long, frame long, trajectory long"
OUT = "TrackID long, TrajectoryID long, FrameID long, State string, Misses long"


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): per window and type. On a stream, rows later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "3 hours", late: str = "6 hours") -> DataFrame:
    """(user_id, start, end, n): runs of events of a user with no pause of ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def slot_states(detections: DataFrame, lost_after: int = 5) -> DataFrame:
    """Each slot's state from a stream of (TrackID, FrameID, Matched).

    A match makes the slot active and clears its misses; a miss makes it occluded and, from ``lost_after`` on,
    lost. A match after that begins a new trajectory. Frames at or before the last one seen are late and
    dropped.
    """

    def advance(key, batches, state: GroupState):
        misses, last, trajectory = state.get if state.exists else (0, -1, 0)
        out = []
        for frame, matched in sorted((int(f), bool(m)) for part in batches for f, m in zip(part["FrameID"], part["Matched"], strict=True)):
            if frame <= last:
                continue
            if matched and misses >= lost_after:
                trajectory += 1
            misses, last = 0 if matched else misses + 1, frame
            out.append((key[0], trajectory, frame, "active" if matched else "lost" if misses >= lost_after else "occluded", misses))
        state.update((misses, last, trajectory))
        yield pd.DataFrame(out, columns=["TrackID", "TrajectoryID", "FrameID", "State", "Misses"])

    return detections.groupBy("TrackID").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
