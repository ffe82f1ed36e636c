"""Queries of the sequence operators, each beside the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.functions import angles
from trackmill.operators import sequences as seq
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src
from trackmill.sources.adapters import with_sql

W = 'PARTITION BY "TrajectoryID" ORDER BY "FrameID", "DetectionID"'
LIMIT, LEAST = 311.7, 3
QUERIES, SQL, query = registry()


_STEP = f"""steps AS (SELECT *, "FrameID" - lag("FrameID") OVER w AS fd,
  sqrt(power("X" - lag("X") OVER w, 2) + power("Y" - lag("Y") OVER w, 2)) AS dd FROM {{0}} WINDOW w AS ({W})),
speeds AS (SELECT *, CASE WHEN fd = 0 THEN CASE WHEN dd > 0 THEN 'Infinity'::DOUBLE END ELSE dd / fd END AS v FROM steps)"""


def _islands(flag: str, of: str, name: str = "seg") -> str:
    return f'SELECT *, sum(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS {name} FROM {of}'


@query("track_summary", with_sql("tracks", f"""+{_STEP.format("tracks")},
  cut AS ({_islands(f"coalesce(v > {LIMIT}, false)", "speeds")}),
  kept AS (SELECT *, count(*) OVER (PARTITION BY "TrajectoryID", seg) AS n FROM cut)
  SELECT "TrajectoryID", seg AS "Segment", min("FrameID") AS "StartFrame", max("FrameID") AS "EndFrame", count(*) AS "Rows",
  {r("sum(dd)", "PathLength")}, {r("avg(v)", "MeanVelocity")}, dense_rank() OVER (ORDER BY "TrajectoryID", seg) - 1 AS "NewID"
  FROM kept WHERE n >= {LEAST} GROUP BY "TrajectoryID", seg"""))  # fmt: skip
def track_summary(spark, sf):
    cut = seq.velocity_breaks(src.tracks(spark, sf), LIMIT, LEAST)
    found = cut.groupBy("TrajectoryID", "Segment").agg(F.min("FrameID").alias("StartFrame"), F.max("FrameID").alias("EndFrame"), F.count("*").alias("Rows"), F.sum("DistDiff").alias("PathLength"), F.avg("Velocity").alias("MeanVelocity"))
    numbered = seq.renumber(found, ["TrajectoryID", "Segment"])
    return numbered.select("TrajectoryID", "Segment", "StartFrame", "EndFrame", "Rows", rounded("PathLength"), rounded("MeanVelocity"), "NewID")


@query("hide_occluded", with_sql("tracks", 'SELECT "DetectionID", CASE WHEN "State" = \'active\' THEN "X" END AS "X", CASE WHEN "State" = \'active\' THEN "Y" END AS "Y", CASE WHEN "State" = \'active\' THEN round("Theta", 6) + 0.0 END AS "Theta" FROM tracks'))
def hide_occluded(spark, sf):
    return seq.hide_occluded(src.tracks(spark, sf)).select("DetectionID", "X", "Y", rounded("Theta", 6))


@query("step_velocity", with_sql("tracks", f'+{_STEP.format("tracks")} SELECT "TrajectoryID", "FrameID", fd AS "FrameDiff", {r("dd", "DistDiff")}, {r("v", "Velocity")} FROM speeds'))
def step_velocity(spark, sf):
    return seq.step_velocity(src.tracks(spark, sf)).select("TrajectoryID", "FrameID", "FrameDiff", rounded("DistDiff"), rounded("Velocity"))


_PAST = f"OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@query("zscore_breaks", with_sql("tracks", f"""+{_STEP.format("tracks")},
  z AS (SELECT *, count(v) {_PAST} AS n, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY "TrajectoryID") AS al,
   count(CASE WHEN v >= 0.5 THEN 1 END) {_PAST} AS na, avg(v) {_PAST} AS m0, stddev_samp(v) {_PAST} AS s0,
   avg(CASE WHEN v >= 0.5 THEN v END) {_PAST} AS m1, stddev_samp(CASE WHEN v >= 0.5 THEN v END) {_PAST} AS s1 FROM speeds)
  SELECT "TrajectoryID", "FrameID", coalesce(v >= 2.0 AND (v - CASE WHEN na < 3 THEN m0 ELSE m1 END) / (CASE WHEN na < 3 THEN s0 ELSE s1 END + 0.5) > 1.937
  AND n >= 3 AND i >= 11 AND al >= 12, false) AS "IsBreak" FROM z"""))  # fmt: skip
def zscore_breaks(spark, sf):
    return seq.zscore_breaks(src.tracks(spark, sf), 1.937).select("TrajectoryID", "FrameID", "IsBreak")


@query("occlusion_splits", with_sql("tracks", f"""+a AS (SELECT *, "State" <> 'active' AS h FROM tracks),
  b AS (SELECT *, lag(h) OVER ({W}) AS p FROM a), c AS ({_islands("p IS NOT NULL AND p <> h", "b", "run")}),
  d AS (SELECT *, count(*) OVER (PARTITION BY "TrajectoryID", run) AS size FROM c),
  e AS ({_islands("h AND size > 2 AND (p IS NULL OR p <> h)", "d")})
  SELECT "TrajectoryID", "FrameID", seg AS "Segment" FROM e"""))  # fmt: skip
def occlusion_splits(spark, sf):
    return seq.occlusion_splits(src.tracks(spark, sf), 2).select("TrajectoryID", "FrameID", "Segment")


_PRIOR = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SEEN = "CASE WHEN \"State\" = 'active' THEN {0} END"


@query("spatial_jump_splits", with_sql("tracks", f"""+h AS (SELECT "TrajectoryID", "FrameID", "DetectionID", {_SEEN.format('"X"')} AS x, {_SEEN.format('"Y"')} AS y, {_SEEN.format('"FrameID"')} AS f FROM tracks),
  p AS (SELECT *, last_value(f IGNORE NULLS) {_PRIOR} AS pf, last_value(x IGNORE NULLS) {_PRIOR} AS px, last_value(y IGNORE NULLS) {_PRIOR} AS py FROM h),
  s AS ({_islands("coalesce(f - pf > 1 AND sqrt(power(x - px, 2) + power(y - py, 2)) > 57.3 * (f - pf), false)", "p")})
  SELECT "TrajectoryID", "FrameID", seg AS "Segment" FROM s"""))  # fmt: skip
def spatial_jump_splits(spark, sf):
    return seq.spatial_jump_splits(seq.hide_occluded(src.tracks(spark, sf)), 57.3).select("TrajectoryID", "FrameID", "Segment")


@query("trim_edges", with_sql("tracks", """+e AS (SELECT *, min(CASE WHEN "State" = 'active' THEN "FrameID" END) OVER t AS lo, max(CASE WHEN "State" = 'active' THEN "FrameID" END) OVER t AS hi FROM tracks WINDOW t AS (PARTITION BY "TrajectoryID"))
  SELECT "TrajectoryID", "FrameID", "State", "DetectionID" FROM (SELECT *, count(*) OVER (PARTITION BY "TrajectoryID") AS n FROM e WHERE "FrameID" BETWEEN lo AND hi) WHERE n >= 10"""))  # fmt: skip
def trim_edges(spark, sf):
    return seq.trim_edges(src.tracks(spark, sf), 10).select("TrajectoryID", "FrameID", "State", "DetectionID")


@query("gap_segments", with_sql("hourly", f"""+{_STEP.format("hourly")}, s AS ({_islands("coalesce(fd > 5 OR dd > 401.3, false)", "speeds")})
  SELECT "TrajectoryID", seg AS "Segment", min("FrameID") AS "StartFrame", max("FrameID") AS "EndFrame", count(*) AS "Rows" FROM s GROUP BY 1, 2"""))  # fmt: skip
def gap_segments(spark, sf):
    cut = seq.gap_segments(src.hourly_tracks(spark, sf), 5, 401.3)
    return cut.groupBy("TrajectoryID", "Segment").agg(F.min("FrameID").alias("StartFrame"), F.max("FrameID").alias("EndFrame"), F.count("*").alias("Rows"))


_FIRST = 'firsts AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY "TrajectoryID", "FrameID" ORDER BY "DetectionID") = 1)'
_GRID = f"""{_FIRST}, spans AS (SELECT "TrajectoryID", min("FrameID") AS lo, max("FrameID") AS hi FROM firsts GROUP BY 1),
  frames AS (SELECT "TrajectoryID", unnest(range(lo, hi + 1)) AS "FrameID" FROM spans),
  grid AS (SELECT "TrajectoryID", "FrameID", coalesce("State", 'occluded') AS "State", "X", "Y", "Theta", "DetectionID", "DetectionConfidence" FROM frames LEFT JOIN firsts USING ("TrajectoryID", "FrameID"))"""


@query("first_per_frame", with_sql("hourly", f'+{_FIRST} SELECT "TrajectoryID", "FrameID", "DetectionID" FROM firsts'))
def first_per_frame(spark, sf):
    return seq.first_per_frame(src.hourly_tracks(spark, sf)).select("TrajectoryID", "FrameID", "DetectionID")


def _grid(spark, sf):
    return seq.densify(seq.first_per_frame(src.hourly_tracks(spark, sf)))


@query("densify", with_sql("hourly", f'+{_GRID} SELECT "TrajectoryID", "FrameID", "State", "DetectionID" FROM grid'))
def densify(spark, sf):
    return _grid(spark, sf).select("TrajectoryID", "FrameID", "State", "DetectionID")


def _filled(column: str, known: str) -> str:
    up, down = 'OVER (PARTITION BY "TrajectoryID" ORDER BY "FrameID" ROWS UNBOUNDED PRECEDING)', 'OVER (PARTITION BY "TrajectoryID" ORDER BY "FrameID" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)'
    f = f'CASE WHEN {known} IS NOT NULL THEN "FrameID" END'
    f0, v0, f1, v1 = f"last_value({f} IGNORE NULLS) {up}", f"last_value({known} IGNORE NULLS) {up}", f"first_value({f} IGNORE NULLS) {down}", f"first_value({known} IGNORE NULLS) {down}"
    return f'CASE WHEN {known} IS NULL AND ({f1}) - ({f0}) - 1 <= 30 THEN ({v0}) + (({v1}) - ({v0})) * ("FrameID" - ({f0})) / nullif(({f1}) - ({f0}), 0) ELSE {known} END AS {column}'


@query("fill_linear", with_sql("hourly", f'+{_GRID}, f AS (SELECT "TrajectoryID", "FrameID", {_filled("x", chr(34) + "X" + chr(34))}, {_filled("y", chr(34) + "Y" + chr(34))} FROM grid) SELECT "TrajectoryID", "FrameID", {r("x", "X")}, {r("y", "Y")} FROM f'))
def fill_linear(spark, sf):
    return seq.fill_linear(_grid(spark, sf), ["X", "Y"], 30).select("TrajectoryID", "FrameID", rounded("X"), rounded("Y"))


@query("fill_circular", with_sql("hourly", f"""+{_GRID}, p AS (SELECT *, sin("Theta") AS s, cos("Theta") AS c FROM grid),
  f AS (SELECT "TrajectoryID", "FrameID", "Theta", {_filled("fs", "s")}, {_filled("fc", "c")} FROM p)
  SELECT "TrajectoryID", "FrameID", {r(f'coalesce("Theta", atan2(fs, fc) - floor(atan2(fs, fc) / {angles.TWO_PI}) * {angles.TWO_PI})', "Theta")} FROM f"""))  # fmt: skip
def fill_circular(spark, sf):
    return seq.fill_circular(_grid(spark, sf), "Theta", 30).select("TrajectoryID", "FrameID", rounded("Theta"))


@query("fragments", with_sql("hourly", f"""+{_FIRST}, r AS (SELECT *, "FrameID" - row_number() OVER (PARTITION BY "TrajectoryID" ORDER BY "FrameID") AS run FROM firsts)
  SELECT "TrajectoryID", min("FrameID") AS "StartFrame", max("FrameID") AS "EndFrame", count(*) AS "Rows" FROM r GROUP BY "TrajectoryID", run"""))  # fmt: skip
def fragments(spark, sf):
    return seq.fragments(seq.first_per_frame(src.hourly_tracks(spark, sf)))


@query("unseen_runs", with_sql("tracks", f"""+h AS (SELECT *, "State" <> 'active' AS lost FROM tracks),
  r AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY "TrajectoryID", lost ORDER BY "FrameID", "DetectionID") AS run FROM h)
  SELECT "TrajectoryID", min("FrameID") AS "StartFrame", max("FrameID") AS "EndFrame", count(*) AS "Rows" FROM r WHERE lost GROUP BY "TrajectoryID", run HAVING count(*) >= 3"""))  # fmt: skip
def unseen_runs(spark, sf):
    return seq.unseen_runs(seq.hide_occluded(src.tracks(spark, sf)), 3)


@query("rolling_outliers", with_sql("tracks", f"""SELECT "TrajectoryID", "FrameID", coalesce(count("X") OVER n >= 3 AND stddev_samp("X") OVER n > 0 AND abs("X" - avg("X") OVER n) > 2.1371 * stddev_samp("X") OVER n, false) AS "IsOutlier"
  FROM tracks WINDOW n AS ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"""))  # fmt: skip
def rolling_outliers(spark, sf):
    return seq.rolling_outliers(src.tracks(spark, sf), "X", 5, 2.1371).select("TrajectoryID", "FrameID", "IsOutlier")


@query("smooth_median", with_sql("tracks", f"""SELECT "TrajectoryID", "FrameID", {r(f'median("X") OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', "XSmooth")} FROM tracks"""))
def smooth_median(spark, sf):
    return seq.smooth_median(src.tracks(spark, sf), "X", 5).select("TrajectoryID", "FrameID", rounded("XSmooth"))


_PI = angles.TWO_PI / 2


@query("smooth_angle", with_sql("tracks", f"""+d AS (SELECT *, "Theta" - lag("Theta") OVER ({W}) AS t FROM tracks),
  s AS (SELECT *, sum(coalesce(t - {angles.TWO_PI} * floor((t + {_PI}) / {angles.TWO_PI}), "Theta")) OVER ({W} ROWS UNBOUNDED PRECEDING) AS flat FROM d),
  m AS (SELECT *, avg(flat) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean FROM s)
  SELECT "TrajectoryID", "FrameID", {r(f"mean - floor(mean / {angles.TWO_PI}) * {angles.TWO_PI}", "ThetaSmooth")} FROM m"""))  # fmt: skip
def smooth_angle(spark, sf):
    return seq.smooth_angle(src.tracks(spark, sf)).select("TrajectoryID", "FrameID", rounded("ThetaSmooth"))


@query("angle_functions", with_sql("tracks", f"""+n AS (SELECT "DetectionID", "Theta" AS a, radians("Y" * 3.7) AS b, "X" AS deg FROM tracks)
  SELECT "DetectionID", {r(f"abs((a - b + {_PI}) - floor((a - b + {_PI}) / {angles.TWO_PI}) * {angles.TWO_PI} - {_PI})", "Distance")},
  {r("atan2(sin(a - b), cos(a - b))", "Signed")}, {r("deg + 180.0 - floor((deg + 180.0) / 360.0) * 360.0 - 180.0", "Wrapped")} FROM n"""))  # fmt: skip
def angle_functions(spark, sf):
    rows = src.tracks(spark, sf).select("DetectionID", F.col("Theta").alias("a"), F.radians(F.col("Y") * 3.7).alias("b"), F.col("X").alias("deg"))
    out = rows.select("DetectionID", angles.circular_distance(F.col("a"), F.col("b")).alias("Distance"), angles.signed_difference(F.col("a"), F.col("b")).alias("Signed"), angles.wrap_degrees(F.col("deg")).alias("Wrapped"))
    return out.select("DetectionID", rounded("Distance"), rounded("Signed"), rounded("Wrapped"))
