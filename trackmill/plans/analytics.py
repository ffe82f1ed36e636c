"""Queries of metrics, edits and curation, each beside the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.operators import curate, edits, metrics, ranks
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src
from trackmill.sources.adapters import with_sql

QUERIES, SQL, query = registry()
W = 'PARTITION BY "TrajectoryID" ORDER BY "FrameID", "DetectionID"'


@query("cleaning_statistics", with_sql("tracks", """SELECT count(*) AS "Rows", count(DISTINCT "TrajectoryID") AS "Tracks", count(CASE WHEN "State" = 'active' THEN 1 END) AS "Active", count(CASE WHEN "State" = 'occluded' THEN 1 END) AS "Occluded", count(CASE WHEN "State" = 'lost' THEN 1 END) AS "Lost" FROM tracks"""))
def cleaning_statistics(spark, sf):
    state = lambda s: F.count_if(F.col("State") == s)
    return src.tracks(spark, sf).agg(F.count("*").alias("Rows"), F.count_distinct("TrajectoryID").alias("Tracks"), state("active").alias("Active"), state("occluded").alias("Occluded"), state("lost").alias("Lost"))


_Q = 'quantile_cont("X", [0.1, 0.25, 0.75, 0.9])'


@query("robust_mean", with_sql("tracks", f"""+c AS (SELECT "TrajectoryID", {_Q} AS c FROM tracks GROUP BY 1),
  s AS (SELECT "TrajectoryID", count("X") AS n, avg("X") AS a, count(CASE WHEN "X" BETWEEN c[2] AND c[3] THEN 1 END) AS ni, avg(CASE WHEN "X" BETWEEN c[2] AND c[3] THEN "X" END) AS i,
  count(CASE WHEN "X" BETWEEN c[1] AND c[4] THEN 1 END) AS no, avg(CASE WHEN "X" BETWEEN c[1] AND c[4] THEN "X" END) AS o FROM tracks JOIN c USING ("TrajectoryID") GROUP BY 1)
  SELECT "TrajectoryID", {r("CASE WHEN ni > 0.1 * n THEN i WHEN no > 0.1 * n THEN o ELSE a END", "RobustMean", 5)} FROM s"""))  # fmt: skip
def robust_mean(spark, sf):
    return metrics.robust_mean(src.tracks(spark, sf), ["TrajectoryID"], "X").select("TrajectoryID", rounded("RobustMean", 5))


def _guesses(spark, sf):
    return src.table(spark, sf, "embeddings").select("label", F.pmod(F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0), F.lit(10)).alias("guess"))


_GUESS = "g AS (SELECT label, (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 10 AS guess FROM embeddings)"


@query("confusion", f'WITH {_GUESS} SELECT label, guess, count(*) AS "Count" FROM g GROUP BY 1, 2')
def confusion(spark, sf):
    return metrics.confusion(_guesses(spark, sf), "label", "guess")


@query("class_metrics", f"""WITH {_GUESS}, c AS (SELECT DISTINCT label AS k FROM g UNION SELECT DISTINCT guess FROM g),
  s AS (SELECT k, (SELECT count(*) FROM g WHERE label = k) AS t, (SELECT count(*) FROM g WHERE guess = k) AS p, (SELECT count(*) FROM g WHERE label = k AND guess = k) AS h FROM c),
  m AS (SELECT k, t, CASE WHEN p > 0 THEN h::DOUBLE / p ELSE 0.0 END AS pr, CASE WHEN t > 0 THEN h::DOUBLE / t ELSE 0.0 END AS re FROM s)
  SELECT k AS "Class", t AS "Support", {r("pr", "Precision")}, {r("re", "Recall")}, {r("CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END", "F1")} FROM m""")  # fmt: skip
def class_metrics(spark, sf):
    return metrics.class_metrics(_guesses(spark, sf), "label", "guess").select("Class", "Support", rounded("Precision"), rounded("Recall"), rounded("F1"))


@query("class_weights", f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT lang, sqrt((SELECT max(n) FROM c)::DOUBLE / n) AS w FROM c)
  SELECT lang, {r("w / (SELECT avg(w) FROM w)", "Weight")} FROM w""")  # fmt: skip
def class_weights(spark, sf):
    return metrics.class_weights(src.table(spark, sf, "documents"), "lang", 0.5).select("lang", rounded("Weight"))


@query("cluster_statistics", f"""WITH j AS (SELECT d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), k AS (SELECT source, quality, count(*) AS n FROM j WHERE quality IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT source, max(n) AS top, sum(n) AS al FROM k GROUP BY 1), s AS (SELECT source, count(*) AS size FROM j GROUP BY 1)
  SELECT source, size AS "Size", {r("coalesce(al, 0)::DOUBLE / size", "Coverage")}, {r("coalesce(top::DOUBLE / al, 0.0)", "Purity")} FROM s LEFT JOIN t USING (source)""")  # fmt: skip
def cluster_statistics(spark, sf):
    rows = src.table(spark, sf, "documents").select("doc_id", "source").join(src.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.cluster_statistics(rows, "source", "quality").select("source", "Size", rounded("Coverage"), rounded("Purity"))


@query("reversals", with_sql("tracks", f"""+s AS (SELECT *, "X" - lag("X") OVER ({W}) AS dx, "Y" - lag("Y") OVER ({W}) AS dy FROM tracks), p AS (SELECT *, lag(dx) OVER ({W}) AS px, lag(dy) OVER ({W}) AS py FROM s),
  l AS (SELECT *, sqrt(dx * dx + dy * dy) AS st, sqrt(px * px + py * py) AS pr FROM p)
  SELECT "TrajectoryID", count(st) AS "Steps", sum(CASE WHEN st * pr > 0 AND (dx * px + dy * py) / (st * pr) < -0.3 AND st > 0.2 * 37.3 AND pr > 0.2 * 37.3 THEN 1 ELSE 0 END)::BIGINT AS "Reversals", {r("avg(st) / 37.3", "MeanStep", 5)} FROM l GROUP BY 1"""))  # fmt: skip
def reversals(spark, sf):
    return metrics.reversals(src.tracks(spark, sf), 37.3).select("TrajectoryID", "Steps", "Reversals", rounded("MeanStep", 5))


@query("rank_percentiles", with_sql("tracks", """+s AS (SELECT "TrajectoryID", list_sort(list("X")) AS v FROM tracks GROUP BY 1)
  SELECT "TrajectoryID", v[least(floor(len(v) * 0.95)::INT, len(v) - 1) + 1] AS "P95", v[least(floor(len(v) * 0.5)::INT, len(v) - 1) + 1] AS "P50" FROM s"""))  # fmt: skip
def rank_percentiles(spark, sf):
    return ranks.at_ranks(src.tracks(spark, sf), ["TrajectoryID"], "X", {"P95": ranks.share(0.95), "P50": ranks.share(0.5)}).drop("N")


@query("exponential_mean", with_sql("tracks", f"""+o AS (SELECT "TrajectoryID", "X", row_number() OVER (PARTITION BY "TrajectoryID" ORDER BY "FrameID" DESC) - 1 AS k, count(*) OVER (PARTITION BY "TrajectoryID") AS n FROM tracks)
  SELECT "TrajectoryID", {r('sum("X" * power(0.8, k) * CASE WHEN k = n - 1 THEN 1.0 ELSE 0.2 END)', "Ewma", 5)} FROM o GROUP BY 1"""))  # fmt: skip
def exponential_mean(spark, sf):
    return metrics.exponential_mean(src.tracks(spark, sf), "X", ["TrajectoryID"], ["FrameID"], 0.2).select("TrajectoryID", rounded("Ewma", 5))


@query("windowed_majority", with_sql("tracks", """+h AS (SELECT a."TrajectoryID", a."FrameID", b."State" AS s, count(*) AS n FROM tracks a JOIN tracks b ON a."TrajectoryID" = b."TrajectoryID" AND b."FrameID" BETWEEN a."FrameID" - 5 AND a."FrameID" GROUP BY 1, 2, 3),
  m AS (SELECT *, max(n) OVER (PARTITION BY "TrajectoryID", "FrameID") AS top FROM h)
  SELECT "TrajectoryID", "FrameID", CASE WHEN count(CASE WHEN n = top THEN 1 END) = 1 THEN min(CASE WHEN n = top THEN s END) END AS "Majority" FROM m GROUP BY 1, 2"""))  # fmt: skip
def windowed_majority(spark, sf):
    return metrics.windowed_majority(src.tracks(spark, sf), "State", 5).select("TrajectoryID", "FrameID", "Majority")


@query("uncertainty", f"""WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)
  SELECT vec_id, {r("list_sum(list_transform(p, lambda x: -greatest(x, 1e-10) * ln(greatest(x, 1e-10))))", "Entropy", 5)}, {r("list_reverse_sort(p)[1] - list_reverse_sort(p)[2]", "Margin", 5)} FROM p""")  # fmt: skip
def uncertainty(spark, sf):
    p = src.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("l")).select("vec_id", metrics.softmax(F.col("l")).alias("p"))
    return p.select("vec_id", metrics.entropy(F.col("p")).alias("Entropy"), metrics.margin(F.col("p")).alias("Margin")).select("vec_id", rounded("Entropy", 5), rounded("Margin", 5))


@query("split_and_swap", with_sql("tracks", """SELECT "DetectionID", CASE WHEN "FrameID" >= 10 AND "TrajectoryID" = 3 THEN 100005 WHEN "FrameID" >= 10 AND "TrajectoryID" = 5 THEN 100003 ELSE "TrajectoryID" END::BIGINT AS "TrajectoryID" FROM tracks"""))
def split_and_swap(spark, sf):
    return edits.split_and_swap(src.tracks(spark, sf), 3, 5, 10).select("DetectionID", "TrajectoryID")


@query("merge_tracks", with_sql("tracks", """SELECT "DetectionID", CASE WHEN "TrajectoryID" IN (4, 9, 7) THEN 4 ELSE "TrajectoryID" END::BIGINT AS "TrajectoryID" FROM tracks"""))
def merge_tracks(spark, sf):
    return edits.merge_tracks(src.tracks(spark, sf), [9, 4, 7]).select("DetectionID", "TrajectoryID")


@query("swap_merge", with_sql("tracks", """SELECT "DetectionID", CASE WHEN "FrameID" >= 20 AND "TrajectoryID" = 8 THEN 6 ELSE "TrajectoryID" END::BIGINT AS "TrajectoryID" FROM tracks WHERE NOT ("FrameID" >= 20 AND "TrajectoryID" = 6)"""))
def swap_merge(spark, sf):
    return edits.swap_merge(src.tracks(spark, sf), 6, 8, 20).select("DetectionID", "TrajectoryID")


EDITS = [("DELETE", 1, 5, 9, None, 1), ("REASSIGN", 1, 10, 30, 2, 2), ("REASSIGN", 2, 10, 30, 3, 3), ("REASSIGN", 1, 25, 40, 4, 4), ("DELETE", 3, 0, 4, None, 5)]
_EDITS = "e(op, id, f0, f1, new, rank) AS (VALUES " + ", ".join(str(e).replace("None", "NULL") for e in EDITS) + ")"


@query("apply_edits", with_sql("tracks", f"""+{_EDITS}, k AS (SELECT * FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM e WHERE op = 'DELETE' AND id = "TrajectoryID" AND "FrameID" BETWEEN f0 AND f1))
  SELECT "DetectionID", coalesce((SELECT max_by(new, rank) FROM e WHERE op = 'REASSIGN' AND id = "TrajectoryID" AND "FrameID" BETWEEN f0 AND f1), "TrajectoryID")::BIGINT AS "TrajectoryID" FROM k"""))  # fmt: skip
def apply_edits(spark, sf):
    ops = spark.createDataFrame(EDITS, "Op string, ID long, F0 long, F1 long, NewID long, Rank int")
    return edits.apply_edits(src.tracks(spark, sf), ops).select("DetectionID", "TrajectoryID")


@query("context_frames", with_sql("tracks", """SELECT DISTINCT f AS "FrameID" FROM (SELECT unnest(["FrameID" - 1, "FrameID", "FrameID" + 1]) AS f FROM tracks WHERE "Y" > 97) WHERE f BETWEEN 0 AND 59"""))
def context_frames(spark, sf):
    return edits.clipped_expansion(src.tracks(spark, sf).where("Y > 97"), 60)


@query("catalogue_insert", """WITH old AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0), new AS (SELECT doc_id, lang AS source FROM documents WHERE doc_id % 2 = 0)
  SELECT * FROM old UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)""")  # fmt: skip
def catalogue_insert(spark, sf):
    docs = src.table(spark, sf, "documents")
    return edits.insert_or_ignore(docs.where("doc_id % 3 = 0").select("doc_id", "source"), docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("source")), "doc_id", "source")


@query("catalogue_update", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::VARCHAR ELSE d.lang END AS label, CASE WHEN l.doc_id IS NOT NULL THEN false ELSE d.doc_id % 2 = 0 END AS verified
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT starts_with(d.source, 'src1')""")  # fmt: skip
def catalogue_update(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("label"), (F.col("doc_id") % 2 == 0).alias("verified"))
    changed = edits.update_labels(docs, src.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id", "label", "verified")
    return edits.delete_prefix(changed, "source", "src1").select("doc_id", "label", "verified")


@query("names_and_numbers", """SELECT event_id, regexp_replace(regexp_replace(lower(event_type || ' #' || props), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS "Name", event_id * 10000 + user_id % 10000 AS "Number", -(event_id * 1000000000 + user_id * 1000 + 1) AS "Synthetic" FROM events""")
def names_and_numbers(spark, sf):
    e = src.table(spark, sf, "events")
    return e.select("event_id", edits.sanitize(F.concat("event_type", F.lit(" #"), "props")).alias("Name"), edits.detection_number(F.col("event_id"), F.col("user_id") % 10000).alias("Number"), edits.synthetic_number(F.col("event_id"), F.col("user_id"), F.lit(-3)).alias("Synthetic"))


@query("exact_groups", """SELECT md5(text) AS signature, min(doc_id) AS "KeptID", count(*) AS "Count" FROM documents GROUP BY 1""")
def exact_groups(spark, sf):
    return curate.exact_groups(src.table(spark, sf, "documents").withColumn("signature", F.md5(F.col("text").cast("binary"))), "signature", "doc_id")


_SIGN = "h AS (SELECT vec_id, list_sum(list_transform(range(1, 25), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS s FROM embeddings)"


def _signed(spark, sf):
    return src.table(spark, sf, "embeddings").select("vec_id", curate.sign_hash(F.col("embedding"), 24).alias("s"))


@query("hamming_pairs", f"""WITH {_SIGN} SELECT a.vec_id AS "AID", b.vec_id AS "BID", bit_count(xor(a.s, b.s))::INT AS "Distance" FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.s, b.s)) <= 3""")
def hamming_pairs(spark, sf):
    return curate.hamming_pairs(_signed(spark, sf), "vec_id", "s", 3, 24)


@query("hamming_dedup")
def hamming_dedup(spark, sf):
    rows = _signed(spark, sf)
    return curate.keep_first(rows, "vec_id", curate.hamming_pairs(rows, "vec_id", "s", 3, 24, copies=False))


@query("every_nth_frame", with_sql("hourly", """+f AS (SELECT "FrameID", row_number() OVER (ORDER BY "FrameID") - 1 AS i FROM (SELECT DISTINCT "FrameID" FROM hourly)) SELECT "DetectionID", "FrameID" FROM hourly JOIN f USING ("FrameID") WHERE i % 7 = 0"""))
def every_nth_frame(spark, sf):
    return curate.every_nth_frame(src.hourly_tracks(spark, sf), 7).select("DetectionID", "FrameID")


@query("stratified_split", """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), q AS (SELECT *, least(floor(n * 0.23), n - 1) AS base, n * 0.23 - floor(n * 0.23) AS rest FROM s),
  k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, n DESC, label) AS rank FROM q), z AS (SELECT label, base + CASE WHEN rank <= (SELECT round(sum(n) * 0.23) - sum(base) FROM q) AND base + 1 < n THEN 1 ELSE 0 END AS quota FROM k),
  d AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS draw FROM embeddings)
  SELECT vec_id, label, CASE WHEN draw <= quota THEN 'val' ELSE 'train' END AS "Split" FROM d JOIN z USING (label)""")  # fmt: skip
def stratified_split(spark, sf):
    return curate.stratified_split(src.table(spark, sf, "embeddings"), "vec_id", "label", 0.23)


@query("top_uncertain", f"""WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s),
  h AS (SELECT vec_id, round(list_sum(list_transform(p, lambda x: -greatest(x, 1e-10) * ln(greatest(x, 1e-10)))), 6) AS s FROM p) SELECT vec_id, {r("s", "Score", 6)} FROM h ORDER BY h.s DESC, vec_id LIMIT 100""")  # fmt: skip
def top_uncertain(spark, sf):
    p = src.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("l")).select("vec_id", metrics.softmax(F.col("l")).alias("p"))
    return curate.top_uncertain(p, F.round(metrics.entropy(F.col("p")), 6), "vec_id", 100).select("vec_id", rounded("Score", 6))


@query("farthest_first")
def farthest_first(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    return curate.farthest_first(rows, "vec_id", "embedding", 10, 0)


@query("capped_per_group", "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5")
def capped_per_group(spark, sf):
    return curate.capped_per_group(src.table(spark, sf, "embeddings"), "label", ["vec_id"], 5).select("vec_id", "label")


@query("temperature_fit")
def temperature_fit(spark, sf):
    """Embeddings' first values as logits of their labels."""
    rows = src.table(spark, sf, "embeddings").select(F.slice("embedding", 1, 8).alias("l"), (F.col("label") % 8).alias("y"))
    return spark.createDataFrame([(metrics.fit_temperature(rows, "l", "y"),)], "Temperature double")
