"""The driver's tables seen as trajectory, tag and embedding tables, in DataFrame code and in SQL.

Both sides derive the same rows: a track for each user of ``events``, one row for each event, and
frames either dense (order of events) or by the hour, which leaves gaps and repeated frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tracks(events: DataFrame, frame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    state = F.when(F.col("event_type") == "error", "occluded").when(F.col("event_type") == "signup", "lost").otherwise("active")
    return events.select(
        F.col("user_id").alias("TrajectoryID"), frame.cast("long").alias("FrameID"), F.col("value").alias("X"), k.alias("Y"),
        (F.col("value") - F.floor(F.col("value") / TWO_PI) * TWO_PI).alias("Theta"), state.alias("State"),
        F.col("event_id").alias("DetectionID"), (k / 100.0).alias("DetectionConfidence"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track and frame, frames 0, 1, 2, ... within a track."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _tracks(table(spark, sf_dir, "events"), F.row_number().over(order) - 1)


def hourly_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with hours as frames: gaps, and several rows for one track and frame."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return _tracks(table(spark, sf_dir, "events"), F.floor(seconds / 3600))


def forward_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).where("DetectionID % 7 <> 0")


def backward_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).withColumn("X", F.col("X") + (F.col("DetectionID") % 5) - 2).where("DetectionID % 11 <> 0")


def tag_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(FrameID, TagID, CX, CY) from click events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("FrameID", (F.row_number().over(order) - 1).cast("long"))
    return rows.where("event_type = 'click'").select("FrameID", (F.col("event_id") % 13).alias("TagID"), F.col("value").alias("CX"), F.get_json_object("props", "$.k").cast("double").alias("CY"), F.col("event_id").alias("ObsID"))


def _tracks_sql(frame: str) -> str:
    k = "json_extract_string(props, '$.k')::DOUBLE"
    return (
        f"SELECT user_id AS \"TrajectoryID\", ({frame})::BIGINT AS \"FrameID\", value AS \"X\", {k} AS \"Y\", "
        f"value - floor(value / {TWO_PI}) * {TWO_PI} AS \"Theta\", "
        "CASE event_type WHEN 'error' THEN 'occluded' WHEN 'signup' THEN 'lost' ELSE 'active' END AS \"State\", "
        f"event_id AS \"DetectionID\", {k} / 100.0 AS \"DetectionConfidence\" FROM events"
    )


#: Common table expressions of the same rows: tracks, hourly, fwd, bwd, tags.
SQL = {
    "tracks": _tracks_sql("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"),
    "hourly": _tracks_sql("floor(epoch(ts) / 3600)"),
    "fwd": 'SELECT * FROM tracks WHERE "DetectionID" % 7 <> 0',
    "bwd": 'SELECT * REPLACE ("X" + ("DetectionID" % 5) - 2 AS "X") FROM tracks WHERE "DetectionID" % 11 <> 0',
    "tags": 'SELECT "FrameID", event_id % 13 AS "TagID", value AS "CX", json_extract_string(props, \'$.k\')::DOUBLE AS "CY", event_id AS "ObsID" FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS "FrameID" FROM events) WHERE event_type = \'click\'',
}


def with_sql(names: str, query: str) -> str:
    """``query`` behind the named common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + (", " if query.lstrip().startswith("+") else " ") + query.lstrip().removeprefix("+")
