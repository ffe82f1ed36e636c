"""Queries of the proofreading and prior operators, each beside the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.functions import angles, pose
from trackmill.operators import catalogue as cat
from trackmill.operators import curate, hierarchy, pairs, priors, review
from trackmill.operators import sequences as seq
from trackmill.plans.common import r, registry, rounded
from trackmill.plans.identity import _POINTS, _points
from trackmill.plans.joins import _LAST, _PIECES, _SPANS, _spans
from trackmill.sources import adapters as src
from trackmill.sources.adapters import with_sql

QUERIES, SQL, query = registry()
_LATE = 'pieces AS (SELECT * REPLACE ("TrajectoryID" * 1000 + CASE WHEN "FrameID" >= 25 AND "TrajectoryID" % 2 = 0 THEN 1 ELSE 0 END AS "TrajectoryID") FROM tracks)'


def _late(spark, sf):
    part = F.when((F.col("FrameID") >= 25) & (F.col("TrajectoryID") % 2 == 0), 1).otherwise(0)
    return src.tracks(spark, sf).withColumn("TrajectoryID", (F.col("TrajectoryID") * 1000 + part).cast("long"))


@query("swap_hypotheses", with_sql("tracks", f"""+{_LATE}, {_SPANS}, l AS ({_LAST.format("pieces")}),
  p AS (SELECT a."TrajectoryID" AS s, b."TrajectoryID" AS t, a."FrameID" AS f, sqrt(power(a."X" - b."X", 2) + power(a."Y" - b."Y", 2)) AS d, a."X" AS ax, a."Y" AS ay, b."X" AS bx, b."Y" AS by_, sa.vx AS vx, sa.vy AS vy, sb.vx AS wx, sb.vy AS wy, sa.df AS e
  FROM l a JOIN l b ON a."FrameID" = b."FrameID" AND a."TrajectoryID" <> b."TrajectoryID" JOIN spans sa ON sa."TrajectoryID" = a."TrajectoryID" JOIN spans sb ON sb."TrajectoryID" = b."TrajectoryID" WHERE abs(a."FrameID" - sa.df) <= 20 AND sb.bf <= sa.df - 10 AND sb.df > sa.df)
  SELECT s AS "SourceID", t AS "TargetID", f AS "FrameID", {r("d", "Distance", 5)}, {r("abs(sqrt(vx * vx + vy * vy) - sqrt(wx * wx + wy * wy))", "Speed", 5)}, {r("sqrt(power(ax + vx * (e - f) - bx, 2) + power(ay + vy * (e - f) - by_, 2))", "Predicted", 5)} FROM p WHERE d <= 12.7 QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY d, f) = 1"""))  # fmt: skip
def swap_hypotheses(spark, sf):
    rows = _late(spark, sf)
    return review.swap_hypotheses(rows, pairs.track_spans(rows), 12.7).select("SourceID", "TargetID", "FrameID", rounded("Distance", 5), rounded("Speed", 5), rounded("Predicted", 5))


_EVENTS = 'e AS (SELECT event_id, user_id % 11 AS a, user_id % 7 + 20 AS b, event_id % 5000 AS peak, value AS s FROM events)'


@query("flickers", f"""WITH {_EVENTS} SELECT a AS "AID", b AS "BID", peak AS "F0", np AS "F1", greatest(s, ns) AS "Score" FROM (SELECT *, lead(peak) OVER w AS np, lead(s) OVER w AS ns FROM e WINDOW w AS (PARTITION BY a, b ORDER BY peak, event_id)) WHERE np - peak <= 15""")
def flickers(spark, sf):
    events = src.table(spark, sf, "events").selectExpr("event_id as EventID", "user_id % 11 as AID", "user_id % 7 + 20 as BID", "event_id % 5000 as Peak", "value as Score")
    return review.flickers(events, 15)


@query("local_proximity", with_sql("tracks", f"""+l AS ({_LAST.format("tracks")}), p AS (SELECT a."TrajectoryID" AS "AID", b."TrajectoryID" AS "BID", "FrameID", sqrt(power(a."X" - b."X", 2) + power(a."Y" - b."Y", 2)) AS d FROM l a JOIN l b USING ("FrameID") WHERE a."TrajectoryID" < b."TrajectoryID" AND (a."TrajectoryID" % 17 = 3 OR b."TrajectoryID" % 17 = 3))
  SELECT "AID", "BID", count(*) AS "Common", {r("min(d)", "MinDistance", 5)}, arg_min("FrameID", (d, "FrameID")) AS "ClosestFrame" FROM p GROUP BY 1, 2 HAVING count(*) >= 3 AND min(d) < 9.7"""))  # fmt: skip
def local_proximity(spark, sf):
    rows = src.tracks(spark, sf)
    affected = rows.where("TrajectoryID % 17 = 3").select("TrajectoryID").distinct()
    return review.local_proximity(rows, affected, 9.7, 3).select("AID", "BID", "Common", rounded("MinDistance", 5), "ClosestFrame")


@query("ranked_events", """WITH e AS (SELECT event_type AS t, event_id AS f, user_id AS u, value AS s FROM events WHERE event_type IN ('click', 'error')) SELECT t AS "Type", f AS "FrameID", u AS "TrajectoryID", s AS "Score", row_number() OVER (PARTITION BY t ORDER BY s DESC, f, u) AS "Rank" FROM e WHERE s >= 20""")
def ranked_events(spark, sf):
    part = lambda t: src.table(spark, sf, "events").where(F.col("event_type") == t).selectExpr("event_type as Type", "event_id as FrameID", "user_id as TrajectoryID", "value as Score")
    return review.ranked_events([part("click"), part("error")], 20.0).withColumn("Rank", F.col("Rank").cast("long"))


_LANES = "l AS (SELECT event_id AS g, user_id % 10 AS t, event_id % 3000 AS f0, event_id % 3000 + user_id % 23 AS f1 FROM events)"


def _lanes(spark, sf):
    return src.table(spark, sf, "events").selectExpr("event_id as FragID", "user_id % 10 as TrackID", "event_id % 3000 as F0", "event_id % 3000 + user_id % 23 as F1")


@query("lane_overlaps", f"""WITH {_LANES}, a AS (SELECT * FROM l WHERE g % 10 = 1) SELECT a.g AS "FragID", count(DISTINCT b.g) AS "Overlaps" FROM a LEFT JOIN l b ON a.t = b.t AND a.f0 <= b.f1 AND a.f1 >= b.f0 AND a.g <> b.g GROUP BY 1""")
def lane_overlaps(spark, sf):
    lanes = _lanes(spark, sf)
    return review.lane_overlaps(lanes, lanes.where("FragID % 10 = 1"))


@query("edit_diff", f"""WITH {_LANES}, a AS (SELECT g, t FROM l WHERE g % 9 <> 4), b AS (SELECT g, CASE WHEN g % 8 = 0 THEN t + 100 ELSE t END AS u FROM l WHERE g % 7 <> 2)
  SELECT g AS "FragID", CASE WHEN u IS NULL THEN 'delete' WHEN t IS NULL THEN 'add' ELSE 'reassign' END AS "Op", t AS "FromID", u AS "ToID" FROM a FULL JOIN b USING (g) WHERE t IS NULL OR u IS NULL OR t <> u""")
def edit_diff(spark, sf):
    lanes = _lanes(spark, sf)
    return review.edit_diff(lanes.where("FragID % 9 <> 4"), lanes.where("FragID % 7 <> 2").withColumn("TrackID", F.expr("case when FragID % 8 = 0 then TrackID + 100 else TrackID end")))


@query("edit_lanes", f"""WITH {_LANES}, e AS (SELECT *, CASE WHEN g % 5 = 0 THEN 'split' WHEN g % 5 = 1 THEN 'delete' WHEN g % 5 = 2 THEN 'reassign' END AS op FROM l)
  SELECT g AS "FragID", CASE WHEN op = 'reassign' THEN 77 ELSE t END AS "TrackID", f0 AS "F0", CASE WHEN op = 'split' AND f1 >= f0 + 3 THEN f0 + 2 ELSE f1 END AS "F1" FROM e WHERE op IS NULL OR op <> 'delete'
  UNION ALL SELECT -g - 1, t, f0 + 3, f1 FROM e WHERE op = 'split' AND f1 >= f0 + 3""")
def edit_lanes(spark, sf):
    lanes = _lanes(spark, sf)
    edits = lanes.where("FragID % 5 < 3").selectExpr("FragID", "element_at(array('split', 'delete', 'reassign'), cast(FragID % 5 + 1 as int)) as Op", "F0 + 3 as At", "cast(77 as bigint) as ToID")
    return review.edit_lanes(lanes, edits)


@query("candidate_update", with_sql("tracks", f"""+{_PIECES}, {_SPANS}, ends AS (SELECT max(df) AS m FROM spans),
  c AS (SELECT a."TrajectoryID" AS s, b."TrajectoryID" AS t, sqrt(power(b.bx - a.dx - a.vx * (b.bf - a.df), 2) + power(b.by_ - a.dy - a.vy * (b.bf - a.df), 2)) AS p FROM spans a JOIN spans b ON b.bf BETWEEN a.df - 15 AND a.df + 60 AND a."TrajectoryID" <> b."TrajectoryID" WHERE a.df < (SELECT m FROM ends) AND sqrt(power(b.bx - a.dx, 2) + power(b.by_ - a.dy, 2)) <= 200),
  w AS (SELECT x."TrajectoryID" AS x, y."TrajectoryID" AS y FROM (SELECT min("TrajectoryID") AS "TrajectoryID" FROM spans) x, (SELECT min("TrajectoryID") AS "TrajectoryID" FROM spans WHERE "TrajectoryID" % 1000 = 1) y),
  anew AS (SELECT x AS s, b."TrajectoryID" AS t, sqrt(power(b.bx - a.dx - a.vx * (b.bf - a.df), 2) + power(b.by_ - a.dy - a.vy * (b.bf - a.df), 2)) AS p FROM w JOIN spans a ON a."TrajectoryID" = w.y JOIN spans b ON b.bf BETWEEN a.df - 15 AND a.df + 60 AND b."TrajectoryID" NOT IN (w.x, w.y) WHERE a.df < (SELECT m FROM ends) AND sqrt(power(b.bx - a.dx, 2) + power(b.by_ - a.dy, 2)) <= 200)
  SELECT s AS "SourceID", t AS "TargetID", {r("p", "Predicted", 4)} FROM (SELECT s, t, p FROM c, w WHERE s NOT IN (x, y) AND t <> y UNION ALL SELECT s, t, p FROM anew)"""))  # fmt: skip
def candidate_update(spark, sf):
    spans = _spans(spark, sf)
    end = spans.agg(F.max("DeathFrame"), F.min("TrajectoryID"), F.min(F.when(F.col("TrajectoryID") % 1000 == 1, F.col("TrajectoryID")))).first()
    known = pairs.hypotheses(spans.where(F.col("DeathFrame") < F.lit(end[0])), spans)
    return review.update_candidates(spans, known, end[1], end[2], end[0]).select("SourceID", "TargetID", rounded("Predicted", 4))


@query("relink_chains", with_sql("tracks", """+h AS (SELECT "TrajectoryID" AS t, "TrajectoryID" - "TrajectoryID" % 5 AS head FROM (SELECT DISTINCT "TrajectoryID" FROM tracks)),
  k AS (SELECT *, max(t) OVER (PARTITION BY head ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER (PARTITION BY head ORDER BY t) AS i FROM h),
  g AS (SELECT t, i, sum(CASE WHEN prev = t - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY head ORDER BY t) AS run, head FROM k), z AS (SELECT t, min(t) OVER (PARTITION BY head, run) AS top FROM g)
  SELECT top AS "TrajectoryID", "FrameID", "DetectionID" FROM tracks JOIN z ON t = "TrajectoryID" QUALIFY row_number() OVER (PARTITION BY top, "FrameID" ORDER BY t - top, "DetectionID") = 1"""))  # fmt: skip
def relink_chains(spark, sf):
    rows = src.tracks(spark, sf)
    ids = rows.select("TrajectoryID").distinct()
    links = ids.select(F.col("TrajectoryID").alias("TargetID"), (F.col("TrajectoryID") - 1).alias("SourceID")).where("TargetID % 5 <> 0").join(ids.select(F.col("TrajectoryID").alias("SourceID")), "SourceID")
    return review.relink(rows, links).select("TrajectoryID", "FrameID", "DetectionID")


@query("pose_summary", f"""WITH {_POINTS}, v AS (SELECT vec_id, list_filter(list_transform(k, lambda q: q.c), lambda c: c >= 0.05) AS c FROM p) SELECT vec_id, {r("CASE WHEN len(c) > 0 THEN list_sum(c) / len(c) ELSE 0.0 END", "Mean", 5)}, len(c)::INT AS "NumValid", {r("len(c) / 5.0", "Fraction")} FROM v""")
def pose_summary(spark, sf):
    rows = _points(spark, sf).select("vec_id", priors.summary(F.transform("points", lambda p: p["conf"]), 0.05).alias("s")).select("vec_id", "s.*")
    return rows.select("vec_id", rounded("Mean", 5), "NumValid", rounded("Fraction"))


_EDGES = "g AS (SELECT label, e, sqrt(power(k[e + 1].x - k[e + 2].x, 2) + power(k[e + 1].y - k[e + 2].y, 2)) AS l FROM (SELECT vec_id, k, unnest(range(0, 4)) AS e FROM p) JOIN embeddings USING (vec_id) WHERE k[e + 1].c >= 0.03 AND k[e + 2].c >= 0.03)"


@query("edge_priors", f"""WITH {_POINTS}, {_EDGES}, m AS (SELECT label, e, median(l) AS m, count(*) AS n FROM g GROUP BY 1, 2) SELECT label, e::INT AS "Edge", any_value(n) AS "N", {r("any_value(m)", "Median", 5)}, {r("median(abs(l - m))", "MAD", 5)}, any_value(n) >= 20 AS "Valid" FROM g JOIN m USING (label, e) GROUP BY 1, 2""")
def edge_priors(spark, sf):
    rows = _points(spark, sf).join(src.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    found = priors.length_prior(priors.edge_lengths(rows, "label", "points", [(0, 1), (1, 2), (2, 3), (3, 4)], 0.03), ["label", "Edge"], "Length")
    return found.select("label", "Edge", "N", rounded("Median", 5), rounded("MAD", 5), "Valid")


@query("body_prior", f"""WITH {_POINTS}, b AS (SELECT sqrt(power(k[1].x - k[5].x, 2) + power(k[1].y - k[5].y, 2)) AS l FROM p), m AS (SELECT median(l) AS m, count(*) AS n FROM b) SELECT any_value(n) AS "N", {r("any_value(m)", "Median", 5)}, {r("median(abs(l - m))", "MAD", 5)}, any_value(n) >= 20 AS "Valid" FROM b, m""")
def body_prior(spark, sf):
    p = lambda i, c: F.col("points")[i][c]
    rows = _points(spark, sf).select(F.hypot(p(0, "x") - p(4, "x"), p(0, "y") - p(4, "y")).alias("Length"))
    return priors.length_prior(rows, [], "Length").select("N", rounded("Median", 5), rounded("MAD", 5), "Valid")


@query("keypoint_medians", f"""WITH {_POINTS}, f AS (SELECT label, i - 1 AS i, k[i] AS q FROM (SELECT vec_id, k, unnest(range(1, 6)) AS i FROM p) JOIN embeddings USING (vec_id)) SELECT label, i::INT AS "Keypoint", {r("median(q.x)", "X", 5)}, {r("median(q.y)", "Y", 5)}, {r("avg(q.c)", "Weight", 5)} FROM f WHERE q.c >= 0.05 GROUP BY 1, 2""")
def keypoint_medians(spark, sf):
    rows = _points(spark, sf).join(src.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return priors.keypoint_medians(rows, ["label"], "points", 0.05).select("label", "Keypoint", rounded("X", 5), rounded("Y", 5), rounded("Weight", 5))


@query("robust_distance", f"""WITH {_POINTS}, d AS (SELECT vec_id, list_sort(list_filter(list_transform(k, lambda q: CASE WHEN q.c >= 0.05 THEN sqrt(q.x * q.x + q.y * q.y) END), lambda x: x IS NOT NULL)) AS d FROM p),
  m AS (SELECT vec_id, d, list_median(d) AS m FROM d WHERE len(d) >= 3), n AS (SELECT vec_id, d, m, list_median(list_transform(d, lambda x: abs(x - m))) AS mad FROM m),
  i AS (SELECT vec_id, CASE WHEN mad > 0 THEN list_filter(d, lambda x: x <= m + 2.5 * mad) ELSE d END AS d FROM n), t AS (SELECT vec_id, CASE WHEN len(d) >= 5 THEN d[1:len(d) - len(d) // 5] ELSE d END AS d FROM i)
  SELECT vec_id, {r("list_avg(d)", "Distance", 5)} FROM t""")  # fmt: skip
def robust_distance(spark, sf):
    far = F.transform("points", lambda p: F.when(p["conf"] >= 0.05, F.hypot(p["x"], p["y"])))
    return _points(spark, sf).select("vec_id", priors.robust_distance(far).alias("Distance")).where("Distance is not null").select("vec_id", rounded("Distance", 5))


@query("heading_reliable", f"""WITH {_POINTS}, v AS (SELECT vec_id, len(list_filter(k, lambda q: q.c >= 0.1)) AS n FROM p) SELECT vec_id, n >= 3 AND n >= 0.6 * 5 AS "Reliable" FROM v""")
def heading_reliable(spark, sf):
    return _points(spark, sf).select("vec_id", priors.is_heading_reliable(F.transform("points", lambda p: p["conf"]), 0.1).alias("Reliable"))


@query("crop_geometry", f"""SELECT event_id, {r("2 * sqrt(value * 2.5 / pi())", "Major", 5)}, {r("least(greatest(2 * sqrt(value * 2.5 / pi()) / 2.5 / 7.5, 0), 1)", "Quality", 5)}, (2 * ceil(2 * sqrt(value * 2.5 / pi()) * 1.2 / 2))::BIGINT AS "Width" FROM events WHERE value >= 0""")
def crop_geometry(spark, sf):
    rows = src.table(spark, sf, "events").where("value >= 0")
    major, minor = priors.dimensions(F.col("value"), F.lit(2.5))
    return rows.select("event_id", major.alias("Major"), priors.crop_quality(minor, 10.0).alias("Quality"), priors.crop_size(major, 2.0, 0.1)[0].alias("Width")).select("event_id", rounded("Major", 5), rounded("Quality", 5), "Width")


@query("keypoints_to_frame", f"""WITH {_POINTS} SELECT vec_id, {r("0.5 * k[2].x - 0.25 * k[2].y + 7", "X", 5)}, {r("0.25 * k[2].x + 0.5 * k[2].y - 3", "Y", 5)} FROM p""")
def keypoints_to_frame(spark, sf):
    moved = priors.to_frame(F.col("points"), [0.5, -0.25, 7.0, 0.25, 0.5, -3.0])
    return _points(spark, sf).select("vec_id", moved[1]["x"].alias("X"), moved[1]["y"].alias("Y")).select("vec_id", rounded("X", 5), rounded("Y", 5))


@query("foreign_boxes", f"""WITH {_POINTS} SELECT vec_id, len(list_filter(k, lambda q: NOT (q.x BETWEEN 0 AND 1.5 AND q.y BETWEEN -1 AND 2) AND q.c > 0))::INT AS "Seen" FROM p""")
def foreign_boxes(spark, sf):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    boxes = F.array(F.array(corner(0.0, -1.0), corner(1.5, -1.0), corner(1.5, 2.0), corner(0.0, 2.0)))
    return _points(spark, sf).select("vec_id", F.size(F.filter(priors.outside_boxes(F.col("points"), boxes), lambda p: p["conf"] > 0)).alias("Seen"))


@query("best_instance", f"""WITH {_POINTS}, m AS (SELECT vec_id % 50 AS image, vec_id, list_avg(list_transform(k, lambda q: q.c)) AS m FROM p) SELECT image, vec_id, {r("m", "Mean", 5)} FROM m QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(m, 12) DESC, vec_id) = 1""")
def best_instance(spark, sf):
    rows = _points(spark, sf).select((F.col("vec_id") % 50).alias("image"), "vec_id", F.transform("points", lambda p: p["conf"]).alias("c"))
    return priors.best_instance(rows, "image", "vec_id", "c").select("image", "vec_id", rounded("Mean", 5))


@query("pair_costs", with_sql("tracks", f"""+p AS (SELECT a."DetectionID" AS d, sqrt(power(a."X" - b."X", 2) + power(a."Y" - b."Y", 2)) AS dist, abs(a."Theta" - b."Theta") AS turn, abs(a."DetectionConfidence" - b."DetectionConfidence") AS c FROM tracks a JOIN tracks b ON a."TrajectoryID" = b."TrajectoryID" AND b."FrameID" = a."FrameID" - 1)
  SELECT d AS "DetectionID", {r("CASE WHEN dist > 50 THEN 1e6 ELSE dist + 2 * least(CASE WHEN turn > pi() THEN 2 * pi() - turn ELSE turn END, abs(pi() - CASE WHEN turn > pi() THEN 2 * pi() - turn ELSE turn END)) + 3 * c END", "Cost", 4)} FROM p"""))  # fmt: skip
def pair_costs(spark, sf):
    rows = src.tracks(spark, sf)
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.TrajectoryID") == F.col("b.TrajectoryID")) & (F.col("b.FrameID") == F.col("a.FrameID") - 1))
    turn = F.abs(F.col("a.Theta") - F.col("b.Theta"))
    short = F.when(turn > 3.141592653589793, 2 * 3.141592653589793 - turn).otherwise(turn)
    cost = priors.pair_cost(pairs.distance("a.X", "a.Y", "b.X", "b.Y"), short, F.abs(F.col("a.DetectionConfidence") - F.col("b.DetectionConfidence")), F.lit(0.0), (1.0, 2.0, 3.0, 1.0), 50.0)
    return both.select(F.col("a.DetectionID").alias("DetectionID"), cost.alias("Cost")).select("DetectionID", rounded("Cost", 4))


@query("run_scores", f"""WITH s AS (SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS a, avg(value) / 100 AS b, 1.0 / count(*) AS c FROM events GROUP BY 1)
  SELECT user_id, {r("0.5 * a + 0.3 * b + 0.2 * c + 0.3 * sqrt((power(a - (a + b + c) / 3, 2) + power(b - (a + b + c) / 3, 2) + power(c - (a + b + c) / 3, 2)) / 3)", "Score", 5)} FROM s""")
def run_scores(spark, sf):
    rows = src.table(spark, sf, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("a"), (F.avg("value") / 100).alias("b"), (F.lit(1.0) / F.count("*")).alias("c"))
    return rows.select("user_id", priors.composite_score({c: F.col(c) for c in "abc"}, {"a": 5.0, "b": 3.0, "c": 2.0}).alias("Score")).select("user_id", rounded("Score", 5))


@query("trial_scores", f"""WITH m AS (SELECT event_type, user_id % 20 AS f, median(value) AS m, avg(value / 100) AS c, avg(1 - value / 1000) AS k FROM events GROUP BY 1, 2) SELECT event_type, {r("avg(c)", "Count", 5)}, {r("avg(k)", "Consistency", 5)}, {r("CASE WHEN avg(m) > 0 THEN greatest(0.0, 1 - stddev_pop(m) / avg(m)) ELSE 0.0 END", "Stability", 5)} FROM m GROUP BY 1""")
def trial_scores(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr("event_type", "user_id % 20 as FrameID", "value as Size", "value / 100 as CountScore", "1 - value / 1000 as ConsistencyScore")
    return priors.trial_score(rows, ["event_type"]).select("event_type", rounded("Count", 5), rounded("Consistency", 5), rounded("Stability", 5))


@query("cluster_density", f"""WITH c AS (SELECT DISTINCT label FROM embeddings UNION SELECT -1) SELECT label, {r("coalesce(avg(d), 0.0)", "Density", 5)} FROM c LEFT JOIN (SELECT label, embedding[1]::DOUBLE AS d FROM embeddings) USING (label) GROUP BY 1""")
def cluster_density(spark, sf):
    rows = src.table(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("Density"))
    clusters = rows.select("label").distinct().unionByName(spark.range(1).select(F.lit(-1).cast(rows.schema["label"].dataType).alias("label")))
    return priors.cluster_density(rows, clusters, "label").select("label", rounded("Density", 5))


@query("multi_shuffles")
def multi_shuffles(spark, sf):
    rows = src.table(spark, sf, "events").where("event_type = 'error'")
    return review.multi_shuffles(rows.selectExpr("event_id as EventID", "event_id % 4000 as F0", "event_id % 4000 + user_id % 5 as F1", "array_distinct(array(user_id % 40, event_id % 40)) as Tracks"))


@query("histogram_pairs", f"""WITH h AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(x)::DOUBLE) AS h FROM embeddings), n AS (SELECT vec_id, list_transform(h, lambda x: sqrt(x / list_sum(h))) AS q FROM h),
  p AS (SELECT a.vec_id AS x, b.vec_id AS y, sqrt(greatest(0.0, 1 - list_sum(list_transform(range(1, 9), lambda i: a.q[i] * b.q[i])))) AS d FROM n a JOIN n b ON a.vec_id < b.vec_id) SELECT x AS "AID", y AS "BID", {r("d", "Distance", 5)} FROM p WHERE d <= 0.1237""")  # fmt: skip
def histogram_pairs(spark, sf):
    return curate.histogram_pairs(_histograms(spark, sf), "vec_id", "h", 0.1237).select("AID", "BID", rounded("Distance", 5))


def _histograms(spark, sf):
    return src.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))).alias("h"))


@query("histogram_dedup")
def histogram_dedup(spark, sf):
    rows = _histograms(spark, sf)
    return curate.keep_first(rows, "vec_id", curate.histogram_pairs(rows, "vec_id", "h", 0.1237))


@query("cluster_representatives")
def cluster_representatives(spark, sf):
    return curate.representatives(curate.clusters(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 8), "vec_id")


@query("pose_penalties", f"""WITH {_POINTS}, s AS (SELECT vec_id, coalesce(list_avg(list_transform(list_filter(k, lambda q: q.c >= 0.02), lambda q: q.c)), 0.0) AS m, len(list_filter(k, lambda q: q.c >= 0.02)) AS n, sqrt(power(k[1].x - k[5].x, 2) + power(k[1].y - k[5].y, 2)) AS l FROM p)
  SELECT vec_id, {r("CASE WHEN n / 5.0 < 0.5 OR n < 3 THEN 0.0 ELSE m * n / 5.0 * CASE WHEN l > 1.5 THEN 0.7 ELSE 1.0 END * greatest(0.5, 1 - 0.15 * (vec_id % 6)) END", "Score", 5)} FROM s""")  # fmt: skip
def pose_penalties(spark, sf):
    odd = pose.body_length(F.col("points"), 0, 4) > 1.5
    return _points(spark, sf).select("vec_id", pose.quality(F.col("points"), 0.02, odd_body=odd, odd_edges=F.col("vec_id") % 6)["Score"].alias("Score")).select("vec_id", rounded("Score", 5))


@query("pose_wide", f"""WITH {_POINTS} SELECT vec_id, {r("k[1].x", "a_X", 5)}, {r("k[3].c", "c_Conf", 5)}, {r("k[3].y", "Back", 5)}, {r("k[2].x", "Moved", 5)}, 0.0 AS "Missing" FROM p""")
def pose_wide(spark, sf):
    names = ["a", "b", "c", "d", "e"]
    wide = _points(spark, sf).select("vec_id", "points", *pose.to_wide(F.col("points"), names))
    new = pose.migrated(F.col("points"), names, ["b", "tail", "a"])
    return wide.select("vec_id", "a_X", "c_Conf", pose.to_nested(names)[2]["y"].alias("Back"), new[0]["x"].alias("Moved"), new[1]["conf"].alias("Missing")).select("vec_id", rounded("a_X", 5), rounded("c_Conf", 5), rounded("Back", 5), rounded("Moved", 5), "Missing")


_TURN = "({0} - floor({0} / 6.283185307179586) * 6.283185307179586)"


@query("directed_angles", with_sql("tracks", f"""+v AS (SELECT *, "X" - 60 AS vx, "Y" - 50 AS vy, CASE WHEN "DetectionID" % 3 = 0 THEN "Theta" + 9 END AS hint, "DetectionID" % 2 = 0 AS dir FROM tracks),
  m AS (SELECT *, {_TURN.format("atan2(vy, vx)")} AS mo, {_TURN.format('"Theta"')} AS ax, {_TURN.format('("Theta" + 3.141592653589793)')} AS ot FROM v), w AS (SELECT *, abs({_TURN.format("(mo - ax + 3.141592653589793)")} - 3.141592653589793) AS d0, abs({_TURN.format("(mo - ot + 3.141592653589793)")} - 3.141592653589793) AS d1 FROM m)
  SELECT "DetectionID", CASE WHEN dir AND hint IS NOT NULL THEN 'hint' WHEN vx * vx + vy * vy > 1e-6 THEN 'motion' ELSE 'axis' END AS "Source", {r(f"CASE WHEN dir AND hint IS NOT NULL THEN {_TURN.format('hint')} WHEN vx * vx + vy * vy > 1e-6 AND d0 > d1 THEN ot ELSE ax END", "Angle", 5)} FROM w"""))  # fmt: skip
def directed_angles(spark, sf):
    rows = src.tracks(spark, sf)
    hint = F.when(F.col("DetectionID") % 3 == 0, F.col("Theta") + 9)
    found = angles.directed(F.col("Theta"), hint, F.col("DetectionID") % 2 == 0, F.col("X") - 60, F.col("Y") - 50)
    return rows.select("DetectionID", found.alias("a")).select("DetectionID", "a.Source", "a.Angle").select("DetectionID", "Source", rounded("Angle", 5))


@query("cosine_pairs", f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM n),
  p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (a.s * b.s) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT x AS "AID", y AS "BID", {r("c", "Similarity", 5)} FROM p WHERE c >= 0.40137""")  # fmt: skip
def cosine_pairs(spark, sf):
    return curate.cosine_pairs(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.40137).select("AID", "BID", rounded("Similarity", 5))


@query("fill_tasks", with_sql("tracks", f"""+k AS (SELECT "TrajectoryID", "FrameID" AS f, "X" AS x, "Y" AS y, lead("FrameID") OVER w AS n, lead("X") OVER w AS nx, lead("Y") OVER w AS ny FROM tracks WHERE "State" = 'active' WINDOW w AS (PARTITION BY "TrajectoryID" ORDER BY "FrameID", "DetectionID"))
  SELECT "TrajectoryID", f + 1 AS "StartFrame", n - 1 AS "EndFrame", x AS "X0", ny AS "Y1" FROM k WHERE n - f - 1 BETWEEN 1 AND 3"""))  # fmt: skip
def fill_tasks(spark, sf):
    return seq.fill_tasks(src.tracks(spark, sf).where("State = 'active'"), 3).select("TrajectoryID", "StartFrame", "EndFrame", "X0", "Y1")


@query("coverage", with_sql("tracks", f"""SELECT "FrameID", {r("count(*) FILTER (\"State\" = 'active') / 150.0", "Coverage")}, count(*) FILTER ("State" = 'occluded') AS "Occluded", count(*) FILTER ("State" = 'lost') AS "Lost" FROM tracks GROUP BY 1"""))
def coverage(spark, sf):
    return seq.coverage(src.tracks(spark, sf), 150).select("FrameID", rounded("Coverage"), "Occluded", "Lost")


@query("first_existing", """SELECT user_id, CASE min(event_id) % 5 WHEN 0 THEN 'b/' || user_id WHEN 1 THEN NULL ELSE 'a/' || user_id END AS "Path" FROM events GROUP BY 1""")
def first_existing(spark, sf):
    ids = src.table(spark, sf, "events").groupBy("user_id").agg((F.min("event_id") % 5).alias("m"))
    candidates = ids.select("user_id", F.posexplode(F.array(F.concat(F.lit("a/"), "user_id"), F.concat(F.lit("b/"), "user_id"))).alias("Position", "Path"))
    present = ids.where("m > 1").select(F.concat(F.lit("a/"), "user_id").alias("Path")).unionByName(ids.where("m <> 1").select(F.concat(F.lit("b/"), "user_id").alias("Path")))
    return cat.first_existing(candidates, present, "user_id")


@query("annotations_of", """SELECT d.doc_id, a.event_id FROM documents d LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'error') a ON a.user_id = d.doc_id""")
def annotations_of(spark, sf):
    images = src.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/x/"), "source", F.lit("/"), "doc_id", F.lit(".png")).alias("path"))
    named = src.table(spark, sf, "events").where("event_type = 'error'").select(F.concat("user_id", F.lit(".png")).alias("Name"), "event_id")
    return cat.annotations_of(images.withColumn("path", F.coalesce("path", F.concat(F.lit("/x/none/"), "doc_id", F.lit(".png")))), named, "path").select("doc_id", "event_id")


@query("class_entries", with_sql("tracks", """+c AS (SELECT "FrameID", "DetectionID", 'c' || "DetectionID" % 4 AS k FROM tracks WHERE "DetectionID" % 3 = 0), i AS (SELECT DISTINCT "TrajectoryID", 't' || "TrajectoryID" % 5 AS k FROM tracks WHERE "TrajectoryID" % 2 = 0)
  SELECT t."DetectionID", c.k AS "Seen", i.k AS "Known" FROM tracks t LEFT JOIN c USING ("FrameID", "DetectionID") LEFT JOIN i USING ("TrajectoryID")"""))
def class_entries(spark, sf):
    rows = src.tracks(spark, sf)
    seen = rows.where("DetectionID % 3 = 0").select("FrameID", "DetectionID", F.concat(F.lit("c"), F.col("DetectionID") % 4).alias("Class"))
    known = rows.where("TrajectoryID % 2 = 0").select("TrajectoryID", F.concat(F.lit("t"), F.col("TrajectoryID") % 5).alias("Class")).distinct()
    return cat.class_entries(rows.select("FrameID", "DetectionID", "TrajectoryID"), seen, known).select("DetectionID", "Seen", "Known")


@query("channel_medians", f"""SELECT event_type, {r("median(value)", "r", 4)}, {r("median((user_id % 256)::DOUBLE)", "g", 4)} FROM events GROUP BY 1""")
def channel_medians(spark, sf):
    rows = src.table(spark, sf, "events").select("event_type", F.col("value").alias("r"), (F.col("user_id") % 256).cast("double").alias("g"))
    return cat.channel_medians(rows, "event_type", ["r", "g"]).select("event_type", rounded("r", 4), rounded("g", 4))


@query("greedy_assignment")
def greedy_assignment(spark, sf):
    a, b = src.forward_tracks(spark, sf), src.backward_tracks(spark, sf)
    return pairs.assign_nearest(pairs._side(a, "A"), pairs._side(b, "B"), 5.0)


@query("cosine_filter")
def cosine_filter(spark, sf):
    return curate.cosine_filter(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.40137)


@query("density_clusters")
def density_clusters(spark, sf):
    return hierarchy.density_clusters(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 40).select("id", "Cluster", "Noise", rounded("Distance"))


@query("cosine_clusters")
def cosine_clusters(spark, sf):
    return hierarchy.cosine_clusters(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 12)


@query("farthest_cosine")
def farthest_cosine(spark, sf):
    return hierarchy.farthest_centres(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 16)
