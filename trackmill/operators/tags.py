"""Tag identity: segments of observations, tag-only tracks, swap streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators.pairs import nearest
from trackmill.operators.sequences import FRAME, TRACK, dense_ids


def merge_observations(observations: DataFrame) -> DataFrame:
    """(FrameID, TagID, CX, CY): observations of one tag in one frame averaged."""
    return observations.groupBy(FRAME, "TagID").agg(F.avg("CX").alias("CX"), F.avg("CY").alias("CY"))


def tag_segments(observations: DataFrame, max_gap: int = 5) -> DataFrame:
    """Segment of each observation of a tag, cut where the frames are more than ``max_gap`` apart."""
    order = Window.partitionBy("TagID").orderBy(FRAME)
    cut = observations.withColumn("_cut", F.coalesce((F.col(FRAME) - F.lag(FRAME).over(order) > max_gap).cast("long"), F.lit(0)))
    return cut.withColumn("Segment", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def tag_only_tracks(observations: DataFrame, least: int = 3, max_gap: int = 5) -> DataFrame:
    """(TrajectoryID, TagID, FrameID, X, Y, Interpolated): a track for each tag segment with enough observations.

    Frames between observations lie on the straight line. Ids are dense in order of tag and segment.
    """
    merged = merge_observations(observations)
    enough = merged.withColumn("_n", F.count("*").over(Window.partitionBy("TagID"))).where(F.col("_n") >= least).drop("_n")
    kept = tag_segments(enough, max_gap).withColumn("_n", F.count("*").over(Window.partitionBy("TagID", "Segment"))).where(F.col("_n") >= least).drop("_n")
    order = Window.partitionBy("TagID", "Segment").orderBy(FRAME)
    ahead = kept.withColumns({"_f": F.lead(FRAME).over(order), "_x": F.lead("CX").over(order), "_y": F.lead("CY").over(order)})
    grown = ahead.withColumn("_at", F.explode(F.sequence(F.col(FRAME), F.coalesce(F.col("_f") - 1, F.col(FRAME)))))
    share = F.coalesce((F.col("_at") - F.col(FRAME)) / (F.col("_f") - F.col(FRAME)), F.lit(0.0))
    rows = grown.select("TagID", "Segment", F.col("_at").alias(FRAME), (F.col("CX") + share * (F.coalesce("_x", "CX") - F.col("CX"))).alias("X"), (F.col("CY") + share * (F.coalesce("_y", "CY") - F.col("CY"))).alias("Y"), (F.col("_at") > F.col(FRAME)).alias("Interpolated"))
    ids = dense_ids(kept.select("TagID", "Segment").distinct(), ["TagID", "Segment"], TRACK)
    return rows.join(ids, ["TagID", "Segment"]).select(TRACK, "TagID", FRAME, "X", "Y", "Interpolated")


def tag_swaps(tracks: DataFrame, observations: DataFrame, radius: float = 50.0, streak: int = 3) -> DataFrame:
    """(TagID, FromID, ToID, FrameID, Confidence): a tag's nearest track changes after a streak of the old one."""
    merged = merge_observations(observations)
    seen = nearest(merged, tracks.select(FRAME, TRACK, "X", "Y"), ["TagID", FRAME], TRACK, radius, ("CX", "CY"), ("X", "Y"))
    order = Window.partitionBy("TagID").orderBy(FRAME)
    turns = seen.withColumn("_prior", F.lag(TRACK).over(order)).withColumn("_turn", F.coalesce((F.col("_prior") != F.col(TRACK)).cast("long"), F.lit(0)))
    runs = turns.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.groupBy("TagID", "_run").agg(F.count("*").alias("_n"), F.min(FRAME).alias("_start"), F.first(TRACK).alias("_id"))
    by_run = Window.partitionBy("TagID").orderBy("_run")
    joined = sized.withColumns({"_before": F.lag("_n").over(by_run), "FromID": F.lag("_id").over(by_run)}).where(F.col("_before") >= streak)
    return joined.select("TagID", "FromID", F.col("_id").alias("ToID"), F.col("_start").alias(FRAME), F.least(F.lit(1.0), F.col("_before") / (2.0 * streak)).alias("Confidence"))
