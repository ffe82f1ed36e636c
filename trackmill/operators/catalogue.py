"""The image catalogue: paths, labels and their review, versions, splits, classes and caches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import ranks


def folder(path: Column) -> Column:
    """The parent of a path; empty for a bare name."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(.)\\.[^.]*$", "$1")


def folder_counts(rows: DataFrame, path: str) -> DataFrame:
    """(Folder, Count) of the parents of all paths."""
    return rows.groupBy(folder(F.col(path)).alias("Folder")).agg(F.count("*").alias("Count"))


def dominant(rows: DataFrame, item: str, value: str) -> DataFrame:
    """(item, value, Count): the most frequent value of each item; of equals the smallest."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("Count"))
    return counts.groupBy(item).agg(F.min(F.struct((-F.col("Count")).alias("c"), F.col(value).alias("v"))).alias("_m")).select(item, F.col("_m.v").alias(value), (-F.col("_m.c")).alias("Count"))


def ratio_split(rows: DataFrame, bucket: str, key: str, train: float, val: float, least: int = 0, small: int = 0) -> DataFrame:
    """rows with Split: int(n * ratio) of each bucket by digest of ``key``, the rest is test.

    The product is exact in decimals: in doubles 0.7 of 90 rows are 62. Buckets of fewer than ``small`` rows are all train; ``least`` is what val gets at the least elsewhere.
    """
    order = Window.partitionBy(bucket)
    n = F.count("*").over(order)
    rank = F.row_number().over(order.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    placed = rows.withColumns({"_n": n, "_rank": rank})
    part = lambda ratio: F.floor(F.col("_n") * F.lit(Decimal(str(ratio)))).cast("long")
    n_val = F.greatest(F.lit(least), part(val))
    n_train = part(train)
    name = F.when(F.col("_n") < small, "train").when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return placed.withColumn("Split", name).drop("_n", "_rank")


def normalised(parts: dict[str, Column]) -> dict[str, Column]:
    """Shares scaled to a sum of 1; all zero stays zero."""
    total = sum(parts.values(), F.lit(0.0))
    return {k: F.when(total > 0, v / total).otherwise(0.0) for k, v in parts.items()}


def mark_verified(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Verified becomes true for labelled rows that keys name."""
    named = keys.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    return rows.join(named, key, "left").withColumn("Verified", (F.coalesce("_hit", F.lit(False)) & F.col("Label").isNotNull()) | F.col("Verified")).drop("_hit")


def clear_labels(rows: DataFrame) -> DataFrame:
    """No row is labelled or verified any more."""
    return rows.withColumns({"Label": F.lit(None).cast(rows.schema["Label"].dataType), "Verified": F.lit(False)})


def review_status(rows: DataFrame, key: str) -> DataFrame:
    """(key, Status): verified, labelled or open."""
    return rows.select(key, F.when(F.col("Verified"), "verified").when(F.col("Label").isNotNull(), "labelled").otherwise("open").alias("Status"))


def labelled(rows: DataFrame, verified_only: bool = False) -> DataFrame:
    """Rows with a label, and verified ones only if asked."""
    return rows.where("Label is not null" + (" and Verified" if verified_only else ""))


def in_order_of(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that wanted(Position, key) names, with Position: its least where a key is named twice."""
    return rows.join(wanted.groupBy(key).agg(F.min("Position").alias("Position")), key)


def reusable_prefix(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of stored(Position, Path) if they are the first of listed(Position, Path); none otherwise."""
    wrong = stored.join(listed, ["Position", "Path"], "left_anti").agg(F.count("*").alias("_wrong"))
    return stored.crossJoin(F.broadcast(wrong)).where("_wrong = 0").drop("_wrong")


def newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` versions of each key, with Rank from 1."""
    return rows.withColumn("Rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("Rank") <= n)


def best_metric(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, Metric, Best): the greatest value of the first of ``columns`` that has one."""
    tops = [F.max(c).alias(c) for c in columns]
    found = rows.groupBy(*keys).agg(*tops)
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return found.select(*keys, name.alias("Metric"), F.coalesce(*columns).alias("Best"))


def map_classes(rows: DataFrame, value: str, classes: DataFrame) -> DataFrame:
    """rows with ClassID by classes(Name, ClassID); a name without id is an error when the row is read."""
    found = rows.join(F.broadcast(classes) if classes.count() <= 100_000 else classes, rows[value] == classes["Name"], "left").drop("Name")
    return found.withColumn("ClassID", F.coalesce("ClassID", F.raise_error(F.concat(F.lit("no class is named "), F.coalesce(F.col(value), F.lit("null")))).cast("int")))


def without_name(rows: DataFrame, class_id: str, names: DataFrame) -> DataFrame:
    """(class_id, Count) of class ids that names(ClassID) lacks."""
    return rows.join(names.select(F.col("ClassID").alias(class_id)), class_id, "left_anti").groupBy(class_id).agg(F.count("*").alias("Count"))


def expand_labels(rows: DataFrame, flips: DataFrame) -> DataFrame:
    """rows, and for train rows a copy for each of flips(Axis, Label, Flipped) of its label, with Axis."""
    copies = rows.where("Split = 'train'").join(flips, "Label").withColumn("Label", F.col("Flipped")).drop("Flipped")
    return rows.withColumn("Axis", F.lit("none")).unionByName(copies)


def with_validation(rows: DataFrame, order: str) -> DataFrame:
    """rows, and the first train row again as val if there is no val row."""
    first = rows.where("Split = 'train'").orderBy(order).limit(1).withColumn("Split", F.lit("val"))
    none = rows.agg(F.count_if(F.col("Split") == "val").alias("_val")).where("_val = 0").drop("_val")
    return rows.unionByName(first.crossJoin(F.broadcast(none.select(F.lit(1).alias("_one")))).drop("_one"))


def encode_factors(values: list[Column]) -> Column:
    """One label of several factors, joined by a bar."""
    return F.concat_ws("|", *values)


def decode_factors(label: Column) -> Column:
    return F.split(label, "\\|")


def tokens_of(spec: Column, names: list[str]) -> Column:
    """Indices that a comma list of names or numbers stands for, in its order, each once; what is neither goes."""
    known = F.array(*[F.lit(n) for n in names])
    parts = F.transform(F.split(spec, ","), lambda t: F.trim(t))
    number = lambda t: F.when(t.rlike("^[0-9]+$"), t.cast("int")).otherwise(F.array_position(known, t).cast("int") - 1)
    return F.array_distinct(F.filter(F.transform(parts, number), lambda i: (i >= 0) & (i < len(names))))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key N, Mean and for each share the value at index int(n * share) of the sorted values, clipped to the last."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("Mean")).alias("m")
    found = ranks.at_ranks(rows, keys, value, {name: ranks.share(q) for name, q in shares.items()}).alias("f")
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return mean.join(found, same, "left").select(*[F.col(f"m.{k}") for k in keys], F.coalesce("f.N", F.lit(0)).alias("N"), "Mean", *shares)


def profile(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, N, Total, Mean, Std, P50, P95, P99, Share of the total of all)."""
    found = rows.groupBy(key).agg(F.count(value).alias("N"), F.sum(value).alias("Total"), F.avg(value).alias("Mean"), F.stddev_pop(value).alias("Std"), *[F.percentile(value, F.lit(q)).alias(f"P{round(100 * q)}") for q in (0.5, 0.95, 0.99)])
    whole = rows.agg(F.sum(value).alias("_whole"))
    return found.crossJoin(F.broadcast(whole)).withColumn("Share", F.col("Total") / F.col("_whole")).drop("_whole")


def one_tag_each(rows: DataFrame) -> DataFrame:
    """(FrameID, DetectionID, TagID): of several tags of a detection the one nearest to it, then the least."""
    return rows.groupBy("FrameID", "DetectionID").agg(F.min(F.struct("Distance", "TagID")).alias("_m")).select("FrameID", "DetectionID", F.col("_m.TagID").alias("TagID"))


def first_existing(candidates: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, Path): of candidates(key, Position, Path) the first that present(Path) holds; null if none does."""
    found = candidates.join(present.select("Path").distinct(), "Path", "left_semi").groupBy(key).agg(F.min_by("Path", "Position").alias("Path"))
    return candidates.select(key).distinct().join(found, key, "left")


def annotations_of(images: DataFrame, annotations: DataFrame, path: str) -> DataFrame:
    """images with the annotations of the same file name, whatever its folder; images without any stay."""
    name = F.regexp_extract(F.col(path), "([^/]*)$", 1)
    return images.withColumn("Name", name).join(annotations, "Name", "left").drop("Name")


def class_entries(detections: DataFrame, classes: DataFrame, identities: DataFrame) -> DataFrame:
    """detections(FrameID, DetectionID, TrajectoryID) with the class that was seen (Seen) and the one their track is known by (Known)."""
    seen = classes.select("FrameID", "DetectionID", F.col("Class").alias("Seen"))
    known = identities.select("TrajectoryID", F.col("Class").alias("Known"))
    return detections.join(seen, ["FrameID", "DetectionID"], "left").join(known, "TrajectoryID", "left")


def channel_medians(pixels: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """The median of each colour channel."""
    return pixels.groupBy(key).agg(*[F.median(c).alias(c) for c in channels])
