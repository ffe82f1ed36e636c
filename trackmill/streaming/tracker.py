"""The tracker over a stream of detections: one state for each video, frames in event time.

A frame is followed once the watermark has passed it, for then no detection of it can come any more; so what comes
out doesn't depend on how detections fall into micro-batches. State holds the tracker and the detections
that wait, and goes when a video has been silent for a while.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackmill.operators import association
from trackmill.operators.kernels import FEATURES, TRACKED, Tracker, follow
from trackmill.operators.sequences import FRAME

_STATE = "tracker binary, waiting binary, last long, heard long"
_COLUMNS = ["VideoID", FRAME, "DetectionID", "X", "Y", "Theta"]


def with_tags(detections: DataFrame, tags: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Detections with TagID, from a stream of tags(VideoID, FrameID, DetectionID, TagID, ts) of the same event times; -1 without one.

    A detection waits for its tag until the watermark has passed its frame. Of several tags of a detection the
    least should be chosen before; here each would make a row.
    """
    a = detections.withWatermark("ts", late).alias("a")
    b = tags.select("VideoID", FRAME, "DetectionID", F.col("TagID").alias("_tag"), F.col("ts")).withWatermark("ts", late).alias("b")
    same = (F.col("a.VideoID") == F.col("b.VideoID")) & (F.col(f"a.{FRAME}") == F.col(f"b.{FRAME}")) & (F.col("a.DetectionID") == F.col("b.DetectionID")) & (F.col("a.ts") == F.col("b.ts"))
    return a.join(b, same, "left_outer").select("a.*", F.coalesce("_tag", F.lit(-1)).alias("TagID"))


def track_stream(detections: DataFrame, slots: int = 8, reach: float = 50.0, lost_after: int = 5, late: str | None = "10 seconds", idle: int = 60_000, **rules) -> DataFrame:
    """Tracks of a stream of detections(VideoID, FrameID, DetectionID, X, Y, Theta, ts), as ``kernels.track_videos`` gives them.

    ts is the time of the frame and grows with it. Detections come within ``late`` of the latest one (None: the stream
    has its watermark already); later ones are dropped. Rows without a place, video or frame are left out. A video
    that is silent for ``idle`` milliseconds of event time is finished: its state goes, and rows that come then begin anew.
    """
    how = association.Rules(reach=reach, **rules)

    def advance(key, batches, state: GroupState):
        tracker, waiting, last, heard = state.get if state.exists else (None, None, None, 0)
        tracker = pickle.loads(tracker) if tracker else Tracker(slots, lost_after, how)
        parts = [pickle.loads(waiting)] if waiting else []
        if not state.hasTimedOut:
            parts += list(batches)
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*_COLUMNS, "_ms"])
        if last is not None:
            rows = rows[rows[FRAME] > last]
        now = state.getCurrentWatermarkMs()
        ready = rows[rows["_ms"] < now]
        heard = int(max(heard, rows["_ms"].max())) if len(rows) else heard
        out = []
        if len(ready):
            first = int(ready[FRAME].min()) if last is None else last + 1
            last = int(ready[FRAME].max())
            out = follow(tracker, ready.sort_values([FRAME, "DetectionID"], kind="stable"), list(range(first, last + 1)))
            rows = rows[rows["_ms"] >= now]
        if not len(rows) and heard + idle < now:
            state.remove()
        else:
            state.update((pickle.dumps(tracker), pickle.dumps(rows) if len(rows) else None, last, heard))
            state.setTimeoutTimestamp(max(now + 1, int(rows["_ms"].min()) if len(rows) else heard + idle))
        found = pd.DataFrame(out, columns=[FRAME, "TrajectoryID", "X", "Y", "Theta", "State", "DetectionID"]).astype({"DetectionID": "Int64"})
        found.insert(0, "VideoID", key[0])
        yield found

    known = detections.where(f"X is not null and Y is not null and not isnan(X) and not isnan(Y) and VideoID is not null and {FRAME} is not null")
    timed = known if late is None else known.withWatermark("ts", late)
    rows = timed.select(*_COLUMNS[:5], F.coalesce("Theta", F.lit(0.0)).alias("Theta"), *[c for c in FEATURES if c in detections.columns], F.unix_millis("ts").alias("_ms"), "ts")
    return rows.groupBy("VideoID").applyInPandasWithState(advance, TRACKED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
