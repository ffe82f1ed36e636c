"""Queries of detection filters and selections, each beside the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.operators import detections as det
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src
from trackmill.sources.adapters import with_sql

QUERIES, SQL, query = registry()
PI = 3.141592653589793


@query("filter_raw", with_sql("tracks", f"""+d AS (SELECT "FrameID", "DetectionID", 10 + "X" / 10 AS w, 5 + "Y" / 10 AS h, "DetectionConfidence" AS c FROM tracks), a AS (SELECT *, w * h * {PI} / 4 AS area, greatest(w, h) / least(w, h) AS ratio FROM d)
  SELECT "FrameID", "DetectionID", {r("area", "Area", 4)} FROM a WHERE c >= 0.25 AND area BETWEEN 50 AND 400 AND ratio BETWEEN 1.0 AND 3.5 QUALIFY row_number() OVER (PARTITION BY "FrameID" ORDER BY area DESC, "DetectionID") <= 8"""))  # fmt: skip
def filter_raw(spark, sf):
    rows = src.tracks(spark, sf).select("FrameID", "DetectionID", (10 + F.col("X") / 10).alias("W"), (5 + F.col("Y") / 10).alias("H"), F.col("DetectionConfidence").alias("Confidence"))
    return det.filter_raw(rows, 0.25, (50.0, 400.0), (1.0, 3.5), 8).select("FrameID", "DetectionID", rounded("Area", 4))


@query("inside_mask", with_sql("tracks", """SELECT "DetectionID" FROM tracks WHERE (floor("X")::BIGINT * 7 + floor("Y")::BIGINT * 3) % 5 = 0 AND floor("X") < 100"""))
def inside_mask(spark, sf):
    grid = spark.range(100).select(F.col("id").alias("MX")).join(spark.range(100).select(F.col("id").alias("MY")), (F.col("MX") * 7 + F.col("MY") * 3) % 5 == 0)
    return det.inside_mask(src.tracks(spark, sf), grid).select("DetectionID")


@query("window_of", with_sql("tracks", """SELECT "DetectionID", "X" / 0.5 AS "X" FROM tracks WHERE "FrameID" BETWEEN 5 AND 25 AND "X" BETWEEN 10 AND 150 AND "Y" BETWEEN 20 AND 90 AND "TrajectoryID" IN (1, 2, 3, 5, 8, 13)"""))
def window_of(spark, sf):
    return det.rescale(det.window_of(src.tracks(spark, sf), 5, 25, (10.0, 20.0, 150.0, 90.0), [1, 2, 3, 5, 8, 13]), 0.5).select("DetectionID", "X")


_SCORES = """z AS (SELECT "FrameID", count(DISTINCT "TrajectoryID") AS n, count(DISTINCT CASE WHEN "State" = 'lost' THEN "TrajectoryID" END) AS l, avg("DetectionConfidence") AS c, coalesce(avg("X"), 0.0) AS a, coalesce(avg("Y"), 0.0) AS u FROM tracks GROUP BY 1),
  s AS (SELECT "FrameID", 0.4 * greatest(0.0, (0.55 - coalesce(c, 0.55)) / 0.55) + CASE WHEN n < 30 THEN 0.3 * (30 - n) / 30.0 ELSE 0.075 * least((n - 30) / 30.0, 1.0) END + 0.15 * least(a / 50, 1.0) + 0.1 * least(l / 30.0, 1.0) + 0.05 * least(u / 50, 1.0) AS s FROM z)"""


def _frame_scores(spark, sf):
    return det.frame_scores(src.tracks(spark, sf), 30, 0.55, "X", "Y")


@query("frame_scores", with_sql("tracks", f'+{_SCORES} SELECT "FrameID", {r("s", "Score")} FROM s'))
def frame_scores(spark, sf):
    return _frame_scores(spark, sf).select("FrameID", rounded("Score"))


@query("diverse_frames")
def diverse_frames(spark, sf):
    return det.diverse_frames(_frame_scores(spark, sf), 5, 4)


@query("representatives", """WITH j AS (SELECT d.doc_id, d.source, l.quality, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT source, (1 - avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END)) / (avg(n_chars) + 1e-6) AS s FROM j GROUP BY 1)
  SELECT doc_id AS id, source FROM j JOIN s USING (source) WHERE quality IS NULL ORDER BY s DESC, source, md5(doc_id::VARCHAR), doc_id LIMIT 100""")  # fmt: skip
def representatives(spark, sf):
    rows = src.table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(src.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return det.representatives(rows, "source", "quality", "n_chars", "doc_id", 100).select("id", "source")


@query("quotas", """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT *, least(20, n) AS b FROM s)
  SELECT lang, least(n, b + floor(greatest(0, 333 - (SELECT sum(b) FROM b)) * n / (SELECT sum(n) FROM b)))::BIGINT AS "Quota" FROM b""")  # fmt: skip
def quotas(spark, sf):
    sizes = src.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("Size"))
    return det.quotas(sizes, "lang", 333, 20)


@query("within_of_best", """SELECT p_partkey, p_brand FROM part QUALIFY p_retailprice <= min(p_retailprice) OVER (PARTITION BY p_brand) * 1.05""")
def within_of_best(spark, sf):
    return det.within_of_best(src.table(spark, sf, "part"), "p_brand", "p_retailprice").select("p_partkey", "p_brand")


@query("latest_valid", """SELECT user_id, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_valid(spark, sf):
    return det.latest_valid(src.table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error").select("user_id", "event_id")


@query("circle_fit", with_sql("tracks", f"""+m AS (SELECT *, "X" - avg("X") OVER t AS u, "Y" - avg("Y") OVER t AS v, avg("X") OVER t AS mx, avg("Y") OVER t AS my FROM tracks WINDOW t AS (PARTITION BY "TrajectoryID")),
  s AS (SELECT "TrajectoryID", any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u + u*v*v) / 2 AS a, sum(v*v*v + v*u*u) / 2 AS b, count(*) AS n FROM m GROUP BY 1),
  c AS (SELECT *, (a * vv - b * uv) / (uu * vv - uv * uv) AS cu, (b * uu - a * uv) / (uu * vv - uv * uv) AS cv FROM s)
  SELECT "TrajectoryID", {r("cu + mx", "CX", 3)}, {r("cv + my", "CY", 3)}, {r("sqrt(cu*cu + cv*cv + (uu + vv) / n)", "Radius", 3)} FROM c"""))  # fmt: skip
def circle_fit(spark, sf):
    return det.circle_fit(src.tracks(spark, sf), ["TrajectoryID"]).select("TrajectoryID", rounded("CX", 3), rounded("CY", 3), rounded("Radius", 3))
