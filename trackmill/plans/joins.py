"""Queries of the join operators, each beside the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.operators import pairs
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src
from trackmill.sources.adapters import with_sql

QUERIES, SQL, query = registry()

_LAST = 'SELECT * FROM {0} WHERE "X" IS NOT NULL AND "Y" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "TrajectoryID", "FrameID" ORDER BY "DetectionID" DESC) = 1'
_D = 'sqrt(power(a."X" - b."X", 2) + power(a."Y" - b."Y", 2))'
_PAIRS = f"""+fa AS ({_LAST.format("fwd")}), fb AS ({_LAST.format("bwd")}),
  cand AS (SELECT a."TrajectoryID" AS "AID", b."TrajectoryID" AS "BID", count(*) AS "Common", sum(CASE WHEN {_D} <= 15.3 THEN 1 ELSE 0 END)::BIGINT AS "Agreeing"
  FROM fa a JOIN fb b USING ("FrameID") GROUP BY 1, 2 HAVING sum(CASE WHEN {_D} <= 15.3 THEN 1 ELSE 0 END) >= 5)"""


def _candidates(spark, sf):
    return pairs.merge_candidates(src.forward_tracks(spark, sf), src.backward_tracks(spark, sf), 15.3, 5)


@query("merge_candidates", with_sql("tracks fwd bwd", f'{_PAIRS} SELECT * FROM cand'))
def merge_candidates(spark, sf):
    return _candidates(spark, sf)


@query("greedy_matches")
def greedy_matches(spark, sf):
    return pairs.match_tracks(src.forward_tracks(spark, sf), src.backward_tracks(spark, sf), 15.3, 5)


@query("redundancy", with_sql("tracks fwd bwd", f"""{_PAIRS}, size AS (SELECT "TrajectoryID" AS "BID", count(*) AS n FROM fb GROUP BY 1)
  SELECT "AID", "BID", {r('"Agreeing"::DOUBLE / n', "Ratio")}, CASE WHEN "Agreeing" >= 0.95 * n THEN 'remove' WHEN "Agreeing" >= 0.7 * n THEN 'trim' ELSE 'keep' END AS "Verdict" FROM cand JOIN size USING ("BID")"""))  # fmt: skip
def redundancy(spark, sf):
    found = pairs.agreements(src.forward_tracks(spark, sf), src.backward_tracks(spark, sf), 15.3, 5)
    verdict = F.when(F.col("Agreeing") >= 0.95 * F.col("BRows"), "remove").when(F.col("Agreeing") >= 0.7 * F.col("BRows"), "trim").otherwise("keep")
    return found.withColumn("Ratio", F.col("Agreeing") / F.col("BRows")).select("AID", "BID", rounded("Ratio"), verdict.alias("Verdict"))


_TAG_AT = 'SELECT "FrameID", "TagID", avg("CX") AS "CX", avg("CY") AS "CY" FROM tags GROUP BY 1, 2'
_TAG_NEAR = f"""+tg AS ({_TAG_AT}), near AS (SELECT t."TrajectoryID", t."FrameID", g."TagID", sqrt(power(t."X" - g."CX", 2) + power(t."Y" - g."CY", 2)) AS d FROM tracks t JOIN tg g USING ("FrameID")),
  best AS (SELECT * FROM near WHERE d <= 41.7 QUALIFY row_number() OVER (PARTITION BY "TrajectoryID", "FrameID" ORDER BY d, "TagID") = 1)"""


def _tags(spark, sf):
    return src.tag_observations(spark, sf).groupBy("FrameID", "TagID").agg(F.avg("CX").alias("CX"), F.avg("CY").alias("CY"))


@query("tag_dedupe", with_sql("tags", f'SELECT "FrameID", "TagID", {r(chr(34) + "CX" + chr(34), "CX", 5)}, {r(chr(34) + "CY" + chr(34), "CY", 5)} FROM ({_TAG_AT})'))
def tag_dedupe(spark, sf):
    return _tags(spark, sf).select("FrameID", "TagID", rounded("CX", 5), rounded("CY", 5))


def _nearest_tag(spark, sf):
    return pairs.nearest(src.tracks(spark, sf), _tags(spark, sf), ["TrajectoryID", "FrameID"], "TagID", 41.7)


@query("nearest_tag", with_sql("tracks tags", f'{_TAG_NEAR} SELECT "TrajectoryID", "FrameID", "TagID", {r("d", "Distance", 5)} FROM best'))
def nearest_tag(spark, sf):
    return _nearest_tag(spark, sf).select("TrajectoryID", "FrameID", "TagID", rounded("Distance", 5))


@query("tag_votes", with_sql("tracks tags", f"""{_TAG_NEAR}, v AS (SELECT "TrajectoryID", "TagID", count(*) AS "Votes", min("FrameID") AS seen FROM best GROUP BY 1, 2)
  SELECT "TrajectoryID", "TagID", "Votes" FROM v QUALIFY row_number() OVER (PARTITION BY "TrajectoryID" ORDER BY "Votes" DESC, seen, "TagID") = 1"""))  # fmt: skip
def tag_votes(spark, sf):
    return pairs.majority(_nearest_tag(spark, sf), ["TrajectoryID"], "TagID", "FrameID")


@query("nearest_track", with_sql("tracks tags", f"""+tg AS ({_TAG_AT}), near AS (SELECT g."TagID", g."FrameID", t."TrajectoryID", sqrt(power(t."X" - g."CX", 2) + power(t."Y" - g."CY", 2)) AS d FROM tracks t JOIN tg g USING ("FrameID"))
  SELECT "TagID", "FrameID", "TrajectoryID", {r("d", "Distance", 5)} FROM near WHERE d <= 41.7 QUALIFY row_number() OVER (PARTITION BY "TagID", "FrameID" ORDER BY d, "TrajectoryID") = 1"""))  # fmt: skip
def nearest_track(spark, sf):
    found = pairs.nearest(_tags(spark, sf), src.tracks(spark, sf).select("FrameID", "TrajectoryID", "X", "Y"), ["TagID", "FrameID"], "TrajectoryID", 41.7, ("CX", "CY"), ("X", "Y"))
    return found.select("TagID", "FrameID", "TrajectoryID", rounded("Distance", 5))


_SELF = f'+l AS ({_LAST.format("tracks")}), p AS (SELECT a."TrajectoryID" AS "AID", b."TrajectoryID" AS "BID", "FrameID", {_D} AS d FROM l a JOIN l b USING ("FrameID") WHERE a."TrajectoryID" < b."TrajectoryID")'


@query("proximity", with_sql("tracks", f"""{_SELF} SELECT "AID", "BID", count(*) AS "Common", {r("min(d)", "MinDistance", 5)}, arg_min("FrameID", (d, "FrameID")) AS "ClosestFrame" FROM p GROUP BY 1, 2 HAVING count(*) >= 3 AND min(d) < 9.7"""))
def proximity(spark, sf):
    return pairs.proximity(src.tracks(spark, sf), 9.7, 3).select("AID", "BID", "Common", rounded("MinDistance", 5), "ClosestFrame")


@query("crowding", with_sql("tracks", f'{_SELF} SELECT "FrameID", {r("sum(CASE WHEN d < 83.1 THEN 1 - d / 83.1 ELSE 0.0 END) / count(*)", "Crowding")} FROM p GROUP BY 1'))
def crowding(spark, sf):
    return pairs.crowding(src.tracks(spark, sf), 83.1).select("FrameID", rounded("Crowding"))


REGIONS = [(1, "nest", 0, 30, 0.0, 0.0, 60.0, 50.0), (2, "food", 10, 60, 40.0, 20.0, 200.0, 80.0), (3, "edge", 20, 90, 100.0, 0.0, 500.0, 99.0)]
_BOXES = "boxes(rank, label, f0, f1, x0, y0, x1, y1) AS (VALUES " + ", ".join(map(str, REGIONS)) + ")"


@query("regions", with_sql("tracks", f"""+{_BOXES}, hit AS (SELECT "DetectionID", label, "FrameID" <= f0 + 2 OR "FrameID" >= f1 - 2 AS edge FROM tracks JOIN boxes ON "FrameID" BETWEEN f0 AND f1 AND "X" BETWEEN x0 AND x1 AND "Y" BETWEEN y0 AND y1
  QUALIFY row_number() OVER (PARTITION BY "DetectionID" ORDER BY rank) = 1)
  SELECT t."DetectionID", coalesce(label, 'open_field') AS "Region", coalesce(edge, false) AS "IsBoundary" FROM tracks t LEFT JOIN hit USING ("DetectionID")"""))  # fmt: skip
def regions(spark, sf):
    boxes = spark.createDataFrame(REGIONS, "Rank int, Label string, F0 int, F1 int, X0 double, Y0 double, X1 double, Y1 double")
    return pairs.regions_of(src.tracks(spark, sf), boxes).select("DetectionID", "Region", "IsBoundary")


_SPANS = """r AS (SELECT *, row_number() OVER (PARTITION BY "TrajectoryID" ORDER BY "FrameID" DESC, "DetectionID" DESC) AS back, row_number() OVER (PARTITION BY "TrajectoryID" ORDER BY "FrameID", "DetectionID") AS fore FROM pieces WHERE "X" IS NOT NULL AND "Y" IS NOT NULL),
  n AS (SELECT "TrajectoryID", count(*) AS rows, max(fore) AS m FROM r GROUP BY 1),
  spans AS (SELECT n."TrajectoryID", b."FrameID" AS bf, b."X" AS bx, b."Y" AS by_, d."FrameID" AS df, d."X" AS dx, d."Y" AS dy,
  CASE WHEN d."FrameID" > t."FrameID" THEN (d."X" - t."X") / (d."FrameID" - t."FrameID") ELSE 0.0 END AS vx, CASE WHEN d."FrameID" > t."FrameID" THEN (d."Y" - t."Y") / (d."FrameID" - t."FrameID") ELSE 0.0 END AS vy, rows
  FROM n JOIN r b ON b."TrajectoryID" = n."TrajectoryID" AND b.fore = 1 JOIN r d ON d."TrajectoryID" = n."TrajectoryID" AND d.back = 1 JOIN r t ON t."TrajectoryID" = n."TrajectoryID" AND t.back = least(5, n.m))"""
#: Pieces of tracks: 20 rows of a track each, as tracks of their own.
_PIECES = 'pieces AS (SELECT * REPLACE ("TrajectoryID" * 1000 + "FrameID" // 20 AS "TrajectoryID") FROM tracks)'


def _spans(spark, sf):
    pieces = src.tracks(spark, sf).withColumn("TrajectoryID", (F.col("TrajectoryID") * 1000 + F.floor(F.col("FrameID") / 20)).cast("long"))
    return pairs.track_spans(pieces)


@query("track_spans", with_sql("tracks", f'+{_PIECES}, {_SPANS} SELECT "TrajectoryID", bf AS "BirthFrame", df AS "DeathFrame", bx AS "BirthX", dy AS "DeathY", {r("vx", "VX")}, {r("vy", "VY")}, rows AS "Rows" FROM spans'))
def track_spans(spark, sf):
    return _spans(spark, sf).select("TrajectoryID", "BirthFrame", "DeathFrame", "BirthX", "DeathY", rounded("VX"), rounded("VY"), "Rows")


@query("merge_hypotheses", with_sql("tracks", f"""+{_PIECES}, {_SPANS}, h AS (SELECT a."TrajectoryID" AS "SourceID", b."TrajectoryID" AS "TargetID", b.bf - a.df AS "Gap", sqrt(power(b.bx - a.dx, 2) + power(b.by_ - a.dy, 2)) AS d,
  sqrt(power(b.bx - a.dx - a.vx * (b.bf - a.df), 2) + power(b.by_ - a.dy - a.vy * (b.bf - a.df), 2)) AS p FROM spans a JOIN spans b ON b.bf BETWEEN a.df - 15 AND a.df + 60 AND a."TrajectoryID" <> b."TrajectoryID" WHERE a.df < (SELECT max(df) FROM spans))
  SELECT "SourceID", "TargetID", "Gap", {r("d", "Distance", 5)}, {r("p", "Predicted", 5)}, row_number() OVER (PARTITION BY "SourceID" ORDER BY p, "TargetID") AS "Rank" FROM h WHERE d <= 20.3"""))  # fmt: skip
def merge_hypotheses(spark, sf):
    found = pairs.merge_hypotheses(_spans(spark, sf), far=20.3)
    return found.select("SourceID", "TargetID", "Gap", rounded("Distance", 5), rounded("Predicted", 5), F.col("Rank").cast("long").alias("Rank"))


@query("stitch_links", with_sql("tracks", f"""+{_PIECES}, {_SPANS}, h AS (SELECT a."TrajectoryID" AS "SourceID", b."TrajectoryID" AS "TargetID", b.bf - a.df AS "Gap", sqrt(power(b.bx - a.dx, 2) + power(b.by_ - a.dy, 2)) AS d FROM spans a JOIN spans b ON b.bf BETWEEN a.df + 1 AND a.df + 3 AND a."TrajectoryID" <> b."TrajectoryID")
  SELECT "SourceID", "TargetID", "Gap", {r("d", "Distance", 5)} FROM h WHERE d <= 30.3 QUALIFY row_number() OVER (PARTITION BY "SourceID" ORDER BY d, "TargetID") = 1"""))  # fmt: skip
def stitch_links(spark, sf):
    return pairs.stitch_links(_spans(spark, sf), 3, 30.3).select("SourceID", "TargetID", "Gap", rounded("Distance", 5))


@query("property_join", with_sql("tracks", """+look AS (SELECT "FrameID", "DetectionID", "Y" * 2 AS "Size", "X" * 0.5 AS "PoseX" FROM tracks WHERE "DetectionID" % 3 = 0)
  SELECT t."DetectionID", "Size", "PoseX" * 4 AS "PoseX" FROM tracks t LEFT JOIN look l USING ("FrameID", "DetectionID")"""))  # fmt: skip
def property_join(spark, sf):
    rows = src.tracks(spark, sf)
    lookup = rows.where("DetectionID % 3 = 0").select("FrameID", "DetectionID", (F.col("Y") * 2).alias("Size"), (F.col("X") * 0.5).alias("PoseX"))
    return pairs.join_properties(rows, lookup, ["Size", "PoseX"], 4.0, ("PoseX",)).select("DetectionID", "Size", "PoseX")


@query("back_fill", with_sql("tracks hourly", """+own AS (SELECT "TrajectoryID", "FrameID", "DetectionID", CASE WHEN "DetectionID" % 4 <> 0 THEN "X" END AS "PoseX" FROM hourly),
  look AS (SELECT "FrameID", "TrajectoryID", "Y" AS px FROM hourly QUALIFY row_number() OVER (PARTITION BY "FrameID", "TrajectoryID" ORDER BY "DetectionID") = 1)
  SELECT "DetectionID", coalesce("PoseX", px) AS "PoseX" FROM own LEFT JOIN look USING ("FrameID", "TrajectoryID")"""))  # fmt: skip
def back_fill(spark, sf):
    rows = src.hourly_tracks(spark, sf)
    own = rows.select("TrajectoryID", "FrameID", "DetectionID", F.when(F.col("DetectionID") % 4 != 0, F.col("X")).alias("PoseX"))
    return pairs.back_fill(own, rows.select("FrameID", "TrajectoryID", "DetectionID", F.col("Y").alias("PoseX")), ["PoseX"], "DetectionID").select("DetectionID", "PoseX")


@query("missing_frames", with_sql("hourly", """SELECT f AS "FrameID" FROM (SELECT unnest(range(472000, 474001)) AS f) WHERE f NOT IN (SELECT "FrameID" FROM hourly)"""))
def missing_frames(spark, sf):
    return pairs.missing_frames(src.hourly_tracks(spark, sf), 472000, 474000)


@query("consensus", with_sql("tracks fwd bwd", """+a AS (SELECT * FROM fwd), b AS (SELECT * FROM bwd),
  j AS (SELECT "TrajectoryID", "FrameID", a."DetectionID" AS ad, b."DetectionID" AS bd, a."X" AS ax, b."X" AS bx, a."Y" AS ay, b."Y" AS by_, a."State" AS sa, b."State" AS sb FROM a FULL JOIN b USING ("TrajectoryID", "FrameID")),
  k AS (SELECT *, CASE WHEN bd IS NULL THEN 'a_only' WHEN ad IS NULL THEN 'b_only' WHEN sqrt(power(ax - bx, 2) + power(ay - by_, 2)) <= 1.5 THEN 'agree' ELSE 'disagree' END AS c FROM j)
  SELECT "TrajectoryID", "FrameID", c AS "Class", CASE c WHEN 'agree' THEN (ax + bx) / 2 WHEN 'b_only' THEN bx ELSE ax END AS "X",
  CASE c WHEN 'agree' THEN CASE WHEN 'active' IN (sa, sb) THEN 'active' ELSE sa END WHEN 'b_only' THEN sb ELSE sa END AS "State" FROM k"""))  # fmt: skip
def consensus(spark, sf):
    return pairs.consensus(src.forward_tracks(spark, sf), src.backward_tracks(spark, sf), 1.5).select("TrajectoryID", "FrameID", "Class", "X", "State")


@query("nearest_neighbours", f"""WITH q AS (SELECT vec_id AS qi, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
  d AS (SELECT qi AS "QueryID", vec_id AS "NeighbourID", list_distance(qe::DOUBLE[], embedding::DOUBLE[]) AS d FROM q, embeddings WHERE vec_id <> qi)
  SELECT "QueryID", "NeighbourID", {r("d", "Distance")}, row_number() OVER (PARTITION BY "QueryID" ORDER BY d, "NeighbourID") AS "Rank" FROM d QUALIFY "Rank" <= 5""")  # fmt: skip
def nearest_neighbours(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    return pairs.nearest_neighbours(rows.where("vec_id % 50 = 0"), rows, 5).select("QueryID", "NeighbourID", rounded("Distance"), F.col("Rank").cast("long").alias("Rank"))
