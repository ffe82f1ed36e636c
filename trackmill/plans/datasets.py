"""Queries of dataset files, caches and edit logs over the events table, each beside the SQL that it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmill.operators import datasets as ds
from trackmill.operators import edits, graphs, pose_time
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src
from trackmill.sources import caches

QUERIES, SQL, query = registry()
WIDTH, HEIGHT = 1000, 1000

_K = "json_extract_string(props, '$.k')::BIGINT"
_POINTS = f"""p AS (SELECT event_id, user_id, {_K} AS k, [{{'x': {_K} * 10 - 20, 'y': event_id % 80 * 10, 'v': event_id % 3}}, {{'x': event_id % 110 * 10, 'y': {_K} * 10, 'v': (event_id // 3) % 3}}, {{'x': user_id % 100 * 10, 'y': 400, 'v': (event_id // 9) % 3}}] AS points FROM events)"""


def _points(spark, sf):
    """Three keypoints for each event, some outside the image, in tens of pixels: shares then have six digits at most and no rounding has a tie."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = F.col("event_id")
    point = lambda x, y, v: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), v.cast("int").alias("v"))
    points = F.array(point(k * 10 - 20, e % 80 * 10, e % 3), point(e % 110 * 10, k * 10, F.floor(e / 3) % 3), point(F.col("user_id") % 100 * 10, F.lit(400), F.floor(e / 9) % 3))
    return src.table(spark, sf, "events").select("event_id", "user_id", k.alias("k"), points.alias("points"))


def _label(rows, pad=0.2):
    return ds.pose_line(F.pmod("user_id", F.lit(4)), F.col("points"), F.lit(WIDTH), F.lit(HEIGHT), pad=pad)


_SIDE = "CASE WHEN {b} - {a} < 2 THEN greatest(0, ({a} + {b}) / 2.0 - 1) ELSE {a} END AS {p}1, CASE WHEN {b} - {a} < 2 THEN least({e}, ({a} + {b}) / 2.0 + 1) ELSE {b} END AS {p}2"
_LINES = f"""{_POINTS},
s AS (SELECT *, list_filter(points, lambda q: q.v > 0) AS seen FROM p),
m AS (SELECT *, list_min(list_transform(seen, lambda q: q.x)) AS xa, list_max(list_transform(seen, lambda q: q.x)) AS xb, list_min(list_transform(seen, lambda q: q.y)) AS ya, list_max(list_transform(seen, lambda q: q.y)) AS yb FROM s),
d AS (SELECT *, 0.2::DOUBLE * greatest(xb - xa, yb - ya, 1) AS r FROM m),
w AS (SELECT *, greatest(0, xa - r) AS xl, least(999, xb + r) AS xh, greatest(0, ya - r) AS yl, least(999, yb + r) AS yh FROM d),
b AS (SELECT *, {_SIDE.format(a="xl", b="xh", e=999, p="x")}, {_SIDE.format(a="yl", b="yh", e=999, p="y")} FROM w),
lines AS (SELECT event_id, CASE WHEN len(seen) > 0 AND x2 > x1 + 1 AND y2 > y1 + 1 THEN
  printf('%d %.6f %.6f %.6f %.6f ', user_id % 4, (x1 + x2) / 2 / 1000.0::DOUBLE, (y1 + y2) / 2 / 1000.0::DOUBLE, greatest(0.001, (x2 - x1) / 1000.0::DOUBLE), greatest(0.001, (y2 - y1) / 1000.0::DOUBLE))
  || array_to_string(list_transform(points, lambda q: printf('%.6f %.6f %d', greatest(0, least(1, q.x / 1000.0::DOUBLE)), greatest(0, least(1, q.y / 1000.0::DOUBLE)), q.v)), ' ') END AS line FROM b)"""


@query("pose_lines", f'WITH {_LINES} SELECT event_id AS "DetectionID", line AS "Line" FROM lines')
def pose_lines(spark, sf):
    rows = _points(spark, sf)
    return rows.select(F.col("event_id").alias("DetectionID"), _label(rows).alias("Line"))


_BROKEN = "CASE event_id % 8 WHEN 1 THEN replace(line, '0.', '1.') WHEN 2 THEN 'x' || line WHEN 3 THEN substr(line, 1, 20) WHEN 4 THEN line || ' 0.5' WHEN 5 THEN '' WHEN 6 THEN regexp_replace(line, ' [0-9.]+ ', ' nan ') WHEN 7 THEN regexp_replace(line, '[012]$', '7') ELSE line END"


@query("pose_faults", f"""WITH {_LINES}, t AS (SELECT event_id, string_split({_BROKEN}, ' ') AS f, {_BROKEN} AS line FROM lines),
c AS (SELECT event_id, CASE WHEN line IS NULL OR line = '' THEN 'empty' WHEN len(f) < 14 THEN 'fields' WHEN NOT regexp_matches(f[1], '^[0-9]+$') THEN 'class' END AS only_one, list_transform(f[2:14], lambda x: try_cast(x AS DOUBLE)) AS v FROM (SELECT event_id, line, CASE WHEN line <> '' AND regexp_matches(f[1], '^[0-9]+$') THEN f ELSE CASE WHEN len(f) < 14 THEN f ELSE list_concat(f[1:1], list_transform(f[2:], lambda x: '0')) END END AS f FROM t)),
r AS (SELECT event_id, unnest(CASE WHEN only_one IS NOT NULL THEN [only_one] ELSE list_concat(
  list_transform(list_filter(v[1:4], lambda x: isnan(x)), lambda x: 'finite'), list_transform(list_filter(v[1:4], lambda x: NOT (x >= -1e-8 AND x <= 1 + 1e-8) OR isnan(x)), lambda x: 'range'), list_transform(list_filter(v[3:4], lambda x: x < 0.001), lambda x: 'size'),
  list_transform(list_filter([v[7], v[10], v[13]], lambda x: x NOT IN (0, 1, 2)), lambda x: 'visibility'),
  list_transform(list_filter(list_concat(CASE WHEN v[7] > 0 THEN v[5:6] ELSE [] END, CASE WHEN v[10] > 0 THEN v[8:9] ELSE [] END, CASE WHEN v[13] > 0 THEN v[11:12] ELSE [] END), lambda x: NOT (x >= -1e-8 AND x <= 1 + 1e-8)), lambda x: 'range'),
  CASE WHEN v[7] <= 0 AND v[10] <= 0 AND v[13] <= 0 THEN ['unseen'] ELSE [] END) END) AS "Rule" FROM c)
SELECT "Rule", count(*) AS "Count", count(DISTINCT event_id) AS "Labels" FROM r GROUP BY 1""")
def pose_faults(spark, sf):
    """Labels broken in seven ways, and how often each rule finds something."""
    rows = _points(spark, sf)
    lines = rows.select("event_id", _label(rows).alias("line"))
    at = F.col("event_id") % 8
    broken = (
        F.when(at == 1, F.replace("line", F.lit("0."), F.lit("1."))).when(at == 2, F.concat(F.lit("x"), "line")).when(at == 3, F.substring("line", 1, 20)).when(at == 4, F.concat("line", F.lit(" 0.5")))
        .when(at == 5, F.lit("")).when(at == 6, F.concat(F.regexp_extract("line", "^[^ ]*", 0), F.lit(" nan "), F.regexp_extract("line", "^[^ ]* [^ ]* (.*)$", 1))).when(at == 7, F.regexp_replace("line", "[012]$", "7")).otherwise(F.col("line"))
    )
    labels = lines.select(F.col("event_id").cast("string").alias("path"), F.when(F.col("line").isNotNull() | (at == 5), broken).alias("value"))
    return ds.pose_label_issues(labels, 3).groupBy(F.col("rule").alias("Rule")).agg(F.count("*").alias("Count"), F.countDistinct("path").alias("Labels"))


@query("class_folder_files", """SELECT split || '/' || lang || '/img_' || (doc_id % 500) || '.png' AS path, max('/src/' || coalesce(source, 'none') || '/' || doc_id || '/img_' || (doc_id % 500) || '.png') AS source
FROM (SELECT *, ['train', 'val', 'test'][(doc_id % 3 + 1)::BIGINT] AS split FROM documents) WHERE coalesce(lang, '') <> '' GROUP BY 1""")
def class_folder_files(spark, sf):
    d = src.table(spark, sf, "documents")
    name = F.concat(F.lit("img_"), (F.col("doc_id") % 500).cast("string"), F.lit(".png"))
    image = F.concat_ws("/", F.lit("/src"), F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), name)
    split = F.get(F.array(*map(F.lit, ds.SPLITS)), (F.col("doc_id") % 3).cast("int"))
    return ds.class_folders(d.select(image.alias("image"), F.col("lang").alias("label"), split.alias("split")))


@query("cached_tags", src.with_sql("tags", 'SELECT "FrameID", "TagID", "CX", "CY" FROM tags WHERE "FrameID" BETWEEN 20 AND 400'))
def cached_tags(spark, sf):
    """All tags through a cache that is written in three ranges, the last in place of wrong rows."""
    tags = src.tag_observations(spark, sf)
    last = tags.agg(F.max("FrameID")).first()[0] or 0
    graphs.ensure_checkpoints(spark)
    cache = caches.FrameCache(spark, f"{spark.sparkContext.getCheckpointDir()}/caches-{uuid.uuid4().hex}", "tags", {"from": sf}, block=64)
    rows = tags.select("FrameID", "TagID", "CX", "CY", F.lit(None).alias("Corners"), F.lit(None).alias("DetectionIndex"), F.lit(None).alias("Hamming"))
    cache.write(rows.where("FrameID < 100").withColumn("CX", F.col("CX") + 1), 0, 99)
    cache.write(rows.where("FrameID >= 100"), 100, max(100, last))
    cache.write(rows.where("FrameID < 100"), 0, 99)
    return cache.read(20, 400).select("FrameID", "TagID", "CX", "CY")


@query("embedding_changes", """SELECT coalesce(a.path, b.path) AS "Path", CASE WHEN b.path IS NULL THEN 'remove' WHEN a.path IS NULL THEN 'add' WHEN a.m = b.m AND a.whole THEN 'keep' ELSE 'update' END AS "Change"
FROM (SELECT 'd/' || doc_id AS path, n_chars AS m, doc_id % 11 <> 0 AS whole FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT 'd/' || doc_id AS path, n_chars + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS m FROM documents WHERE doc_id % 4 <> 0) b ON a.path = b.path""")
def embedding_changes(spark, sf):
    d = src.table(spark, sf, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("Path")
    stored = d.where("doc_id % 5 <> 0").select(path, F.col("n_chars").alias("Modified"), F.when(F.col("doc_id") % 11 != 0, F.array(F.lit(1.0))).alias("Embedding"))
    listing = d.where("doc_id % 4 <> 0").select(path, (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("Modified"))
    return caches.embedding_changes(stored, listing).select("Path", "Change")


@query("standing_edits", """WITH RECURSIVE log AS (SELECT user_id AS "Session", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "Seq", event_type = 'error' OR event_type = 'view' AS undo FROM events),
r AS (SELECT *, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (PARTITION BY "Session" ORDER BY "Seq") AS s FROM log),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY "Session" ORDER BY "Seq")) AS depth FROM r),
f AS (SELECT *, min(depth) OVER (PARTITION BY "Session" ORDER BY "Seq" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d)
SELECT "Session", "Seq" FROM f WHERE NOT undo AND (later IS NULL OR later >= depth)""")
def standing_edits(spark, sf):
    """Events of a user as an edit log in which errors and views undo."""
    undo = F.col("event_type").isin("error", "view")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    log = src.table(spark, sf, "events").select(F.col("user_id").alias("Session"), seq.alias("Seq"), F.when(undo, "undo").otherwise("delete").alias("Op"), F.col("event_id").alias("FragID"))
    return edits.standing(log).select("Session", "Seq")


@query("clean_poses", src.with_sql("tracks", f"""+f AS (SELECT "TrajectoryID" AS t, "FrameID" AS f, 0 AS k, "X" AS x, "Y" AS y, CASE WHEN "DetectionID" % 5 = 0 THEN 0 ELSE 0.5 END AS c, "State" = 'active' AS judged FROM tracks
  UNION ALL SELECT "TrajectoryID", "FrameID", 1, "Y", "Theta", CASE WHEN "DetectionID" % 4 < 2 THEN 0 ELSE 0.75 END, "State" = 'active' FROM tracks),
o AS (SELECT *, coalesce(c > 0 AND judged AND count(x) OVER n >= 3 AND (abs(x - avg(x) OVER n) / greatest(coalesce(stddev_samp(x) OVER n, 0), 1e-6) > 1.7131 OR abs(y - avg(y) OVER n) / greatest(coalesce(stddev_samp(y) OVER n, 0), 1e-6) > 1.7131), false) AS odd FROM f
  WINDOW n AS (PARTITION BY t, k, c > 0 AND judged ORDER BY f ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT *, CASE WHEN odd THEN 0 ELSE c END AS d, row_number() OVER (PARTITION BY t, k ORDER BY f) AS pos FROM o),
h AS (SELECT *, CASE WHEN d > 0 THEN {{'pos': pos, 'x': x, 'y': y}} END AS here FROM s),
w AS (SELECT *, last_value(here IGNORE NULLS) OVER (PARTITION BY t, k ORDER BY f ROWS UNBOUNDED PRECEDING) AS a, first_value(here IGNORE NULLS) OVER (PARTITION BY t, k ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h),
g AS (SELECT *, coalesce(d = 0 AND b.pos - a.pos - 1 <= 3, false) AS fill FROM w),
z AS (SELECT t, f, odd, fill, CASE WHEN fill THEN a.x + (pos - a.pos) / (b.pos - a.pos)::DOUBLE * (b.x - a.x) ELSE x END AS x, CASE WHEN fill THEN a.y + (pos - a.pos) / (b.pos - a.pos)::DOUBLE * (b.y - a.y) ELSE y END AS y, CASE WHEN fill THEN 0.3 ELSE d END AS c FROM g)
SELECT t AS "TrajectoryID", f AS "FrameID", count(CASE WHEN odd THEN 1 END) AS "Suppressed", count(CASE WHEN fill THEN 1 END) AS "Filled", {r("avg(c::DOUBLE)", "MeanConf")}, {r("sum(x)", "SumX", 4)}, {r("sum(y)", "SumY", 4)} FROM z GROUP BY 1, 2"""))
def clean_poses(spark, sf):
    """Two keypoints a row, one in five and one in two of them unseen."""
    point = lambda x, y, c: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), c.alias("conf"))
    d = F.col("DetectionID")
    points = F.array(point("X", "Y", F.when(d % 5 == 0, 0.0).otherwise(0.5)), point("Y", "Theta", F.when(d % 4 < 2, 0.0).otherwise(0.75)))
    rows = src.tracks(spark, sf).select("TrajectoryID", "FrameID", points.alias("Keypoints"), F.when(F.col("State") == "active", "good").otherwise("bad").alias("PoseState"))
    found = pose_time.clean_poses(rows, 3, 1.7131)
    total = lambda c: F.aggregate(F.transform("Keypoints", lambda p: p[c]), F.lit(0.0), lambda a, x: a + x).alias(f"Sum{c.upper()}")
    sums = found.select("TrajectoryID", "FrameID", "Suppressed", "Filled", "MeanConf", total("x"), total("y"))
    return sums.select("TrajectoryID", "FrameID", "Suppressed", "Filled", rounded("MeanConf"), rounded("SumX", 4), rounded("SumY", 4))


_PIXELS = "list_transform(points, lambda q: q.{c} / 1000.0::DOUBLE * 1000)"
_END = "list_min({p}) AS {c}l, greatest(1.0::DOUBLE, list_max({p}) - list_min({p})) AS {c}w"


@query("crop_corners", f"""WITH {_POINTS}, e AS (SELECT *, {", ".join(_END.format(c=c, p=_PIXELS.format(c=c)) for c in "xy")} FROM p),
s AS (SELECT *, greatest(64.0::DOUBLE, xw * 1.3::DOUBLE, yw * 1.3::DOUBLE) AS side FROM e),
b AS (SELECT *, greatest(0, floor(xl + xw / 2 - side / 2))::INT AS x1, least(1000, ceil(xl + xw / 2 + side / 2))::INT AS x2, greatest(0, floor(yl + yw / 2 - side / 2))::INT AS y1, least(1000, ceil(yl + yw / 2 + side / 2))::INT AS y2 FROM s)
SELECT event_id AS "DetectionID", x1 AS "X1", y1 AS "Y1", x2 AS "X2", y2 AS "Y2", {r("greatest(0, least(1, (points[1].x / 1000.0::DOUBLE * 1000 - x1) / (x2 - x1)))", "CornerX")}, {r("greatest(0, least(1, (points[1].y / 1000.0::DOUBLE * 1000 - y1) / (y2 - y1)))", "CornerY")} FROM b WHERE x2 > x1 AND y2 > y1""")
def crop_corners(spark, sf):
    share = F.transform("points", lambda p: F.struct((p["x"] / WIDTH).alias("x"), (p["y"] / HEIGHT).alias("y")))
    rows = _points(spark, sf).select(F.col("event_id").alias("DetectionID"), share.alias("corners"))
    rows = rows.withColumn("box", ds.crop_box(F.col("corners"), F.lit(WIDTH), F.lit(HEIGHT))).where("box is not null")
    first = F.get(ds.crop_corners(F.col("corners"), F.lit(WIDTH), F.lit(HEIGHT), F.col("box")), F.lit(0))
    found = rows.select("DetectionID", *[F.col(f"box.{c}").alias(c.upper()) for c in ("x1", "y1", "x2", "y2")], first["x"].alias("CornerX"), first["y"].alias("CornerY"))
    return found.select("DetectionID", "X1", "Y1", "X2", "Y2", rounded("CornerX"), rounded("CornerY"))
