"""Queries of tags, pose, density, kernels and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.functions import pose
from trackmill.operators import density, kernels, resolve, tags
from trackmill.operators import sequences as seq
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src
from trackmill.sources.adapters import with_sql
from trackmill.streaming import windows

QUERIES, SQL, query = registry()

_MERGED = 'm AS (SELECT "FrameID", "TagID", avg("CX") AS x, avg("CY") AS y FROM tags WHERE "FrameID" % 3 <> 1 OR "TagID" < 5 GROUP BY 1, 2)'


def _observations(spark, sf):
    return src.tag_observations(spark, sf).where("FrameID % 3 <> 1 or TagID < 5")


_SEGMENTS = f"""{_MERGED}, c AS (SELECT *, CASE WHEN "FrameID" - lag("FrameID") OVER w > 2 THEN 1 ELSE 0 END AS cut FROM m WINDOW w AS (PARTITION BY "TagID" ORDER BY "FrameID")),
  s AS (SELECT *, sum(cut) OVER (PARTITION BY "TagID" ORDER BY "FrameID" ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM c)"""


@query("tag_segments", with_sql("tags", f'+{_SEGMENTS} SELECT "TagID", "FrameID", seg AS "Segment" FROM s'))
def tag_segments(spark, sf):
    return tags.tag_segments(tags.merge_observations(_observations(spark, sf)), 2).select("TagID", "FrameID", "Segment")


@query("tag_only_tracks", with_sql("tags", f"""+{_SEGMENTS}, k AS (SELECT *, count(*) OVER (PARTITION BY "TagID", seg) AS n, lead("FrameID") OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS (PARTITION BY "TagID", seg ORDER BY "FrameID")),
  g AS (SELECT *, unnest(range("FrameID", coalesce(nf, "FrameID" + 1))) AS f FROM k WHERE n >= 3)
  SELECT dense_rank() OVER (ORDER BY "TagID", seg) - 1 AS "TrajectoryID", "TagID", f AS "FrameID", {r('x + coalesce((f - "FrameID")::DOUBLE / (nf - "FrameID"), 0) * (coalesce(nx, x) - x)', "X", 5)}, {r('y + coalesce((f - "FrameID")::DOUBLE / (nf - "FrameID"), 0) * (coalesce(ny, y) - y)', "Y", 5)}, f > "FrameID" AS "Interpolated" FROM g"""))  # fmt: skip
def tag_only_tracks(spark, sf):
    return tags.tag_only_tracks(_observations(spark, sf), 3, 2).select("TrajectoryID", "TagID", "FrameID", rounded("X", 5), rounded("Y", 5), "Interpolated")


@query("tag_swaps", with_sql("tracks tags", f"""+m AS (SELECT "FrameID", "TagID", avg("CX") AS gx, avg("CY") AS gy FROM tags GROUP BY 1, 2),
  n AS (SELECT g."TagID", g."FrameID", t."TrajectoryID" // 15 AS t, sqrt(power(t."X" - gx, 2) + power(t."Y" - gy, 2)) AS d FROM m g JOIN tracks t USING ("FrameID")),
  b AS (SELECT * FROM n WHERE d <= 41.7 QUALIFY row_number() OVER (PARTITION BY "TagID", "FrameID" ORDER BY d, t) = 1),
  c AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY "TagID" ORDER BY "FrameID") <> t THEN 1 ELSE 0 END AS turn FROM b),
  e AS (SELECT *, sum(turn) OVER (PARTITION BY "TagID" ORDER BY "FrameID" ROWS UNBOUNDED PRECEDING) AS run FROM c),
  z AS (SELECT "TagID", run, count(*) AS n, min("FrameID") AS f, min(t) AS t FROM e GROUP BY 1, 2),
  y AS (SELECT *, lag(n) OVER (PARTITION BY "TagID" ORDER BY run) AS pn, lag(t) OVER (PARTITION BY "TagID" ORDER BY run) AS pt FROM z)
  SELECT "TagID", pt AS "FromID", t AS "ToID", f AS "FrameID", {r("least(1.0, pn / 4.0)", "Confidence")} FROM y WHERE pn >= 2"""))  # fmt: skip
def tag_swaps(spark, sf):
    rows = src.tracks(spark, sf).withColumn("TrajectoryID", F.floor(F.col("TrajectoryID") / 15).cast("long"))
    return tags.tag_swaps(rows, src.tag_observations(spark, sf), 41.7, 2).select("TagID", "FromID", "ToID", "FrameID", rounded("Confidence"))


def _points(spark, sf):
    """Keypoints from slices of the embeddings: x and y scaled, confidence from the third value."""
    point = lambda i: F.struct((F.get("embedding", F.lit(3 * i)).cast("double") * 10).alias("x"), (F.get("embedding", F.lit(3 * i + 1)).cast("double") * 10).alias("y"), F.abs(F.get("embedding", F.lit(3 * i + 2))).cast("double").alias("conf"))
    return src.table(spark, sf, "embeddings").select("vec_id", F.array(*[point(i) for i in range(5)]).alias("points"))


_POINTS = "p AS (SELECT vec_id, list_transform(range(0, 5), lambda i: {'x': embedding[3 * i + 1]::DOUBLE * 10, 'y': embedding[3 * i + 2]::DOUBLE * 10, 'c': abs(embedding[3 * i + 3])::DOUBLE}) AS k FROM embeddings)"
_S = "s AS (SELECT vec_id, coalesce(list_avg(list_transform(list_filter(k, lambda q: q.c >= 0.1137), lambda q: q.c)), 0.0) AS m, len(list_filter(k, lambda q: q.c >= 0.1137)) AS n FROM p)"


@query("pose_quality", f"""WITH {_POINTS}, {_S} SELECT vec_id, {r("CASE WHEN n < 3 THEN 0.0 ELSE m * n / 5.0 END", "Score", 5)}, n::INT AS "NumValid", CASE WHEN n < 3 THEN 'rejected' WHEN m * n / 5.0 < 0.2 THEN 'bad' WHEN m * n / 5.0 < 0.7 THEN 'partial' ELSE 'good' END AS "State" FROM s""")
def pose_quality(spark, sf):
    rows = _points(spark, sf).select("vec_id", pose.quality(F.col("points"), 0.1137).alias("q"), pose.summary(F.col("points"), 0.1137).alias("s"))
    return rows.select("vec_id", F.col("q.Score").alias("Score"), F.col("s.NumValid").alias("NumValid"), F.col("q.State").alias("State")).select("vec_id", rounded("Score", 5), "NumValid", "State")


@query("pose_geometry", f"""WITH {_POINTS} SELECT vec_id, {r("list_sum(list_transform(k, lambda q: q.c * q.x)) / list_sum(list_transform(k, lambda q: q.c))", "CX", 5)}, {r("sqrt(power(k[1].x - k[5].x, 2) + power(k[1].y - k[5].y, 2))", "BodyLength", 5)} FROM p""")
def pose_geometry(spark, sf):
    rows = _points(spark, sf).select("vec_id", pose.centroid(F.col("points"))["x"].alias("CX"), pose.body_length(F.col("points"), 0, 4).alias("BodyLength"))
    return rows.select("vec_id", rounded("CX", 5), rounded("BodyLength", 5))


@query("density_cells", with_sql("tracks", f"""+o AS (SELECT unnest(range(-3, 4)) AS o), s AS (SELECT "FrameID", floor("X" / 20.0)::BIGINT + a.o AS "GX", floor("Y" / 20.0)::BIGINT + b.o AS "GY", "X" / 20.0 AS x, "Y" / 20.0 AS y, 1 - "DetectionConfidence" AS w FROM tracks, o a, o b)
  SELECT "FrameID", "GX", "GY", {r('sum(w * exp(-(power("GX" + 0.5 - x, 2) + power("GY" + 0.5 - y, 2)) / 2.0))', "Density", 5)} FROM s GROUP BY 1, 2, 3"""))  # fmt: skip
def density_cells(spark, sf):
    return density.accumulate(src.tracks(spark, sf), 20.0).select("FrameID", "GX", "GY", rounded("Density", 5))


@query("density_regions")
def density_regions(spark, sf):
    return density.regions(density.above_share(density.smooth_in_time(density.accumulate(src.tracks(spark, sf), 20.0)), 0.3))


@query("heading_flips")
def heading_flips(spark, sf):
    return kernels.repair_heading_flips(src.tracks(spark, sf), 5).select("TrajectoryID", "FrameID", "Theta")


@query("fill_cubic")
def fill_cubic(spark, sf):
    return kernels.fill_cubic(seq.densify(seq.first_per_frame(src.hourly_tracks(spark, sf))), ["X", "Y"], 30).select("TrajectoryID", "FrameID", "X", "Y")


@query("replay_tracker")
def replay_tracker(spark, sf):
    rows = src.tracks(spark, sf).withColumn("VideoID", F.floor(F.col("TrajectoryID") / 10).cast("long"))
    return kernels.track_videos(rows, 8, 80.0, 5)


@query("suppress_overlaps")
def suppress_overlaps(spark, sf):
    rows = src.tracks(spark, sf).select("FrameID", "DetectionID", F.col("X").alias("CX"), F.col("Y").alias("CY"), F.lit(30.0).alias("W"), F.lit(15.0).alias("H"), "Theta", F.col("DetectionConfidence").alias("Confidence"))
    return kernels.suppress_overlaps(rows, 0.3)


@query("tumbling_windows", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, {r("sum(value)", "total", 4)} FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    return windows.tumbling_counts(src.table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("total", 4))


@query("sliding_windows", """SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP), time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1""")
def sliding_windows(spark, sf):
    return windows.sliding_counts(src.table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("session_windows", """WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def session_windows(spark, sf):
    return windows.sessions(src.table(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("clean")
def clean(spark, sf):
    return resolve.clean(src.tracks(spark, sf), 5, 250.0, 3)


@query("interpolate")
def interpolate(spark, sf):
    return resolve.interpolate(src.hourly_tracks(spark, sf), 30)


@query("resolve")
def resolve_passes(spark, sf):
    return resolve.resolve(src.forward_tracks(spark, sf), src.backward_tracks(spark, sf), 15.0, 5, 5)
