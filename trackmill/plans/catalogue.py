"""Queries of the catalogue operators over documents as an image catalogue, each beside the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.operators import catalogue as cat
from trackmill.plans.common import r, registry, rounded
from trackmill.sources import adapters as src

QUERIES, SQL, query = registry()
_DOCS = """d AS (SELECT doc_id, '/data/' || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/img_' || doc_id || '.v1.png' AS path, lang, source, n_chars,
  CASE WHEN doc_id % 3 <> 0 THEN lang || '|' || source END AS label, doc_id % 7 = 0 AS verified FROM documents)"""
_SPLIT = "CASE WHEN {small} THEN 'train' WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + greatest({least}, floor(n * 0.2)) THEN 'val' ELSE 'test' END"


def _docs(spark, sf):
    d = src.table(spark, sf, "documents")
    path = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/img_"), F.col("doc_id").cast("string"), F.lit(".v1.png"))
    label = F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit("|"), "source"))
    return d.select("doc_id", path.alias("Path"), "lang", "source", "n_chars", label.alias("Label"), (F.col("doc_id") % 7 == 0).alias("Verified"))


@query("folder_counts", f"""WITH {_DOCS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS "Folder", count(*) AS "Count" FROM d GROUP BY 1""")
def folder_counts(spark, sf):
    return cat.folder_counts(_docs(spark, sf), "Path")


@query("path_parts", f"""WITH {_DOCS} SELECT doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS "Folder", 'img_' || doc_id || '.v1' AS "Stem" FROM d""")
def path_parts(spark, sf):
    return _docs(spark, sf).select("doc_id", cat.folder(F.col("Path")).alias("Folder"), cat.stem(F.col("Path")).alias("Stem"))


@query("dominant_class", """SELECT source, lang, n AS "Count" FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def dominant_class(spark, sf):
    return cat.dominant(src.table(spark, sf, "documents"), "source", "lang")


@query("ratio_split", f"""SELECT doc_id, {_SPLIT.format(small="false", least=0)} AS "Split" FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents)""")
def ratio_split(spark, sf):
    return cat.ratio_split(src.table(spark, sf, "documents"), "lang", "doc_id", 0.7, 0.2).select("doc_id", "Split")


@query("cluster_split", f"""SELECT doc_id, {_SPLIT.format(small="n < 3", least=2)} AS "Split" FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, n_chars // 40) AS n, row_number() OVER (PARTITION BY lang, n_chars // 40 ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents)""")
def cluster_split(spark, sf):
    rows = src.table(spark, sf, "documents").withColumn("cluster", F.struct("lang", F.floor(F.col("n_chars") / 40)))
    return cat.ratio_split(rows, "cluster", "doc_id", 0.7, 0.2, 2, 3).select("doc_id", "Split")


@query("split_counts", f"""SELECT lang, "Split", count(*) AS "Count" FROM (SELECT lang, {_SPLIT.format(small="false", least=0)} AS "Split" FROM (SELECT lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents)) GROUP BY 1, 2""")
def split_counts(spark, sf):
    return cat.ratio_split(src.table(spark, sf, "documents"), "lang", "doc_id", 0.7, 0.2).groupBy("lang", "Split").agg(F.count("*").alias("Count"))


@query("mark_verified", f"""WITH {_DOCS} SELECT doc_id, (doc_id % 5 = 1 AND label IS NOT NULL) OR verified AS "Verified" FROM d""")
def mark_verified(spark, sf):
    rows = _docs(spark, sf)
    return cat.mark_verified(rows, rows.where("doc_id % 5 = 1").select("Path"), "Path").select("doc_id", "Verified")


@query("clear_labels", """SELECT doc_id, NULL::VARCHAR AS "Label", false AS "Verified" FROM documents""")
def clear_labels(spark, sf):
    return cat.clear_labels(_docs(spark, sf)).select("doc_id", "Label", "Verified")


@query("review_status", f"""WITH {_DOCS} SELECT path AS "Path", CASE WHEN verified THEN 'verified' WHEN label IS NOT NULL THEN 'labelled' ELSE 'open' END AS "Status" FROM d""")
def review_status(spark, sf):
    return cat.review_status(_docs(spark, sf), "Path")


@query("labelled_rows", f"""WITH {_DOCS} SELECT doc_id, label AS "Label" FROM d WHERE label IS NOT NULL AND verified""")
def labelled_rows(spark, sf):
    return cat.labelled(_docs(spark, sf), True).select("doc_id", "Label")


@query("catalogue_count", """SELECT count(*) AS "Count" FROM documents""")
def catalogue_count(spark, sf):
    return src.table(spark, sf, "documents").agg(F.count("*").alias("Count"))


@query("in_order_of", """SELECT doc_id, min("Position") AS "Position" FROM (SELECT doc_id * 3 AS doc_id, 1000000 - doc_id AS "Position" FROM documents UNION ALL SELECT doc_id, doc_id FROM documents WHERE doc_id % 6 = 0) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1""")
def in_order_of(spark, sf):
    rows = src.table(spark, sf, "documents")
    wanted = rows.selectExpr("1000000 - doc_id as Position", "doc_id * 3 as doc_id").unionByName(rows.where("doc_id % 6 = 0").selectExpr("doc_id as Position", "doc_id"))
    return cat.in_order_of(rows, wanted, "doc_id").select("doc_id", "Position")


@query("embedding_prefix", f"""WITH {_DOCS} SELECT doc_id AS "Position", path AS "Path", k FROM d, (SELECT unnest(['same']) AS k) WHERE doc_id < 100""")
def embedding_prefix(spark, sf):
    listed = _docs(spark, sf).selectExpr("doc_id as Position", "Path")
    same, moved = listed.where("Position < 100"), listed.where("Position < 100").withColumn("Position", F.col("Position") + 1)
    parts = [cat.reusable_prefix(x, listed).withColumn("k", F.lit(k)) for k, x in (("same", same), ("moved", moved))]
    return parts[0].unionByName(parts[1])


@query("newest_versions", """SELECT user_id, event_id, k::INT AS "Rank" FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3""")
def newest_versions(spark, sf):
    return cat.newest(src.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query("best_metric", """SELECT user_id, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' WHEN c IS NOT NULL THEN 'c' END AS "Metric", coalesce(a, b, c) AS "Best" FROM (SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 40 THEN value END) AS a, max(CASE WHEN event_type = 'signup' THEN value END) AS b, max(value) AS c FROM events GROUP BY 1)""")
def best_metric(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr("user_id", "case when event_type = 'error' and value > 40 then value end as a", "case when event_type = 'signup' then value end as b", "value as c")
    return cat.best_metric(rows, ["user_id"], ["a", "b", "c"])


@query("model_ranking", """SELECT user_id, best AS "Best", row_number() OVER (ORDER BY last DESC, user_id) AS "Rank" FROM (SELECT user_id, max(value) AS best, max(event_id) AS last FROM events GROUP BY 1) QUALIFY "Rank" <= 50""")
def model_ranking(spark, sf):
    best = cat.best_metric(src.table(spark, sf, "events").selectExpr("user_id", "value"), ["user_id"], ["value"])
    last = src.table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    top = best.join(last, "user_id").orderBy(F.desc("last"), "user_id").limit(50)
    from pyspark.sql import Window

    return top.withColumn("Rank", F.row_number().over(Window.orderBy(F.desc("last"), "user_id")).cast("long")).select("user_id", "Best", "Rank")


@query("map_classes", """SELECT doc_id, CASE lang WHEN 'de' THEN 2 WHEN 'en' THEN 0 WHEN 'es' THEN 3 WHEN 'fr' THEN 1 END AS "ClassID" FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')""")
def map_classes(spark, sf):
    rows = src.table(spark, sf, "documents").where("lang in ('de', 'en', 'es', 'fr')")
    classes = spark.createDataFrame([("en", 0), ("fr", 1), ("de", 2), ("es", 3)], "Name string, ClassID int")
    return cat.map_classes(rows, "lang", classes).select("doc_id", "ClassID")


@query("without_name", """SELECT label, count(*) AS "Count" FROM embeddings WHERE label % 3 <> 0 GROUP BY 1""")
def without_name(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    return cat.without_name(rows, "label", rows.where("label % 3 = 0").select(F.col("label").alias("ClassID")).distinct())


@query("expand_labels", """WITH s AS (SELECT doc_id, lang AS "Label", CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS "Split" FROM documents), f AS (SELECT * FROM (VALUES ('x', 'en', 'fr'), ('y', 'en', 'de'), ('x', 'fr', 'en')) t("Axis", "Label", to_))
  SELECT doc_id, "Label", "Split", 'none' AS "Axis" FROM s UNION ALL SELECT doc_id, to_, "Split", "Axis" FROM s JOIN f USING ("Label") WHERE "Split" = 'train'""")
def expand_labels(spark, sf):
    rows = src.table(spark, sf, "documents").selectExpr("doc_id", "lang as Label", "case when doc_id % 4 = 0 then 'val' else 'train' end as Split")
    return cat.expand_labels(rows, spark.createDataFrame([("x", "en", "fr"), ("y", "en", "de"), ("x", "fr", "en")], "Axis string, Label string, Flipped string"))


@query("val_fallback", """SELECT doc_id, 'train' AS "Split", 'a' AS k FROM documents UNION ALL SELECT min(doc_id), 'val', 'a' FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'train' END, 'b' FROM documents""")
def val_fallback(spark, sf):
    rows = src.table(spark, sf, "documents").select("doc_id")
    parts = [cat.with_validation(rows.withColumn("Split", split), "doc_id").withColumn("k", F.lit(k)) for k, split in (("a", F.lit("train")), ("b", F.when(F.col("doc_id") % 2 == 0, "val").otherwise("train")))]
    return parts[0].unionByName(parts[1])


@query("composite_labels", """SELECT doc_id, lang || '|' || source AS "Label", lang AS "First", source AS "Second" FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def composite_labels(spark, sf):
    rows = src.table(spark, sf, "documents").where("lang is not null and source is not null").select("doc_id", cat.encode_factors([F.col("lang"), F.col("source")]).alias("Label"))
    return rows.withColumns({"First": cat.decode_factors(F.col("Label"))[0], "Second": cat.decode_factors(F.col("Label"))[1]})


@query("token_lists", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '0,2' WHEN 1 THEN '1' ELSE '' END AS "Indices" FROM documents""")
def token_lists(spark, sf):
    spec = F.when(F.col("doc_id") % 3 == 0, F.lit("nose, 2,nose, tail9")).when(F.col("doc_id") % 3 == 1, F.lit(" neck ,7")).otherwise(F.lit(""))
    return src.table(spark, sf, "documents").select("doc_id", F.array_join(cat.tokens_of(spec, ["nose", "neck", "tail"]).cast("array<string>"), ",").alias("Indices"))


@query("split_shares", f"""SELECT doc_id, {r("CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.0 END", "Train")} FROM (SELECT doc_id, (doc_id % 5)::DOUBLE AS a, (doc_id % 3)::DOUBLE AS b FROM documents)""")
def split_shares(spark, sf):
    rows = src.table(spark, sf, "documents")
    shares = cat.normalised({"Train": (F.col("doc_id") % 5).cast("double"), "Val": (F.col("doc_id") % 3).cast("double")})
    return rows.select("doc_id", shares["Train"].alias("Train")).select("doc_id", rounded("Train"))


@query("nearest_rank", f"""SELECT event_type, n AS "N", {r("m", "Mean", 4)}, l[least(floor(n * 0.95)::INT + 1, n)] AS "P95", l[least(floor(n * 0.99)::INT + 1, n)] AS "P99" FROM (SELECT event_type, count(value) AS n, avg(value) AS m, list_sort(list(value)) AS l FROM events GROUP BY 1)""")
def nearest_rank(spark, sf):
    return cat.nearest_rank(src.table(spark, sf, "events"), ["event_type"], "value", {"P95": 0.95, "P99": 0.99}).select("event_type", "N", rounded("Mean", 4), "P95", "P99")


@query("profile", f"""SELECT event_type, count(value) AS "N", {r("sum(value)", "Total", 3)}, {r("stddev_pop(value)", "Std", 4)}, {r("quantile_cont(value, 0.5)", "P50", 4)}, {r("quantile_cont(value, 0.99)", "P99", 4)}, {r("sum(value) / (SELECT sum(value) FROM events)", "Share")} FROM events GROUP BY 1""")
def profile(spark, sf):
    return cat.profile(src.table(spark, sf, "events"), "event_type", "value").select("event_type", "N", rounded("Total", 3), rounded("Std", 4), rounded("P50", 4), rounded("P99", 4), rounded("Share"))


@query("augmentation_counts", """SELECT event_type, count(*) FILTER (k IS NOT NULL) AS "Posed", count(*) FILTER (k IS NOT NULL AND event_id % 4 <> 0) AS "Detected", count(*) FILTER (k IS NOT NULL AND event_id % 4 = 0) AS "Undetected" FROM (SELECT event_type, event_id, CASE WHEN value > 30 THEN value END AS k FROM events) GROUP BY 1""")
def augmentation_counts(spark, sf):
    rows = src.table(spark, sf, "events").selectExpr("event_type", "value > 30 as posed", "event_id % 4 <> 0 as detected")
    return rows.groupBy("event_type").agg(F.count_if("posed").alias("Posed"), F.count_if(F.col("posed") & F.col("detected")).alias("Detected"), F.count_if(F.col("posed") & ~F.col("detected")).alias("Undetected"))


@query("detection_tags", """SELECT user_id AS "FrameID", event_id % 9 AS "DetectionID", arg_min(event_id % 13, (value, event_id % 13)) AS "TagID" FROM events GROUP BY 1, 2""")
def detection_tags(spark, sf):
    return cat.one_tag_each(src.table(spark, sf, "events").selectExpr("user_id as FrameID", "event_id % 9 as DetectionID", "event_id % 13 as TagID", "value as Distance"))
