"""Readers and writers of trajectory, detection and dataset files.

Schemas are explicit: nothing is inferred. A table that is rewritten goes to a new folder first and is
swapped in by a rename through Hadoop's file system, so readers see the old or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmill.operators.sequences import FRAME, TRACK, hide_occluded

TRAJECTORY = T.StructType([
    T.StructField(TRACK, T.LongType()), T.StructField("X", T.DoubleType()), T.StructField("Y", T.DoubleType()), T.StructField("Theta", T.DoubleType()),
    T.StructField(FRAME, T.LongType()), T.StructField("State", T.StringType()), T.StructField("DetectionConfidence", T.DoubleType()), T.StructField("DetectionID", T.LongType()),
])


def nan_to_null(rows: DataFrame) -> DataFrame:
    """NaN marks nothing here: it would sort above every number and pass every threshold."""
    return rows.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory CSV with a header in any column order; unseen rows have no position. Numbers may be written as floats."""
    names = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    found = [F.expr(f"try_cast(`{f.name}` as double)").cast(f.dataType).alias(f.name) if f.name in names and not isinstance(f.dataType, T.StringType) else (F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)) for f in TRAJECTORY]
    return hide_occluded(nan_to_null(raw.select(*found)))


def write_trajectories(rows: DataFrame, path: str) -> None:
    """CSV with whole positions and frames, the base columns first, sorted within files by track and frame."""
    base = [f.name for f in TRAJECTORY if f.name in rows.columns]
    rest = [c for c in rows.columns if c not in base and c not in ("TrackID", "Index")]
    whole = rows.select(*base, *rest).withColumns({c: F.round(c).cast("long") for c in ("X", "Y", FRAME) if c in rows.columns})
    whole.repartitionByRange(TRACK, FRAME).sortWithinPartitions(TRACK, FRAME).write.mode("overwrite").option("header", True).csv(path)


def replace_table(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside ``path`` and swap by rename; the old table goes once the new one stands."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.format(fmt).save(new)
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(conf)
    had = files.exists(place(path))
    if had and not files.rename(place(path), place(old)):
        raise OSError(f"can't move {path} aside")
    if not files.rename(place(new), place(path)):
        raise OSError(f"can't put the new table at {path}")
    if had:
        files.delete(place(old), True)


def write_detections(rows: DataFrame, path: str, block: int = 1000) -> None:
    """Detection cache: Parquet in folders of ``block`` frames, so a frame range reads only its folders."""
    rows.withColumn("FrameBlock", F.floor(F.col(FRAME) / block)).repartition("FrameBlock").write.mode("overwrite").partitionBy("FrameBlock").parquet(path)


def read_detections(spark: SparkSession, path: str, start: int, end: int, block: int = 1000) -> DataFrame:
    """Rows of frames start to end; missing frames simply have none."""
    return spark.read.parquet(path).where(F.col("FrameBlock").between(start // block, end // block) & F.col(FRAME).between(start, end)).drop("FrameBlock")


def coverage(rows: DataFrame, start: int, end: int) -> DataFrame:
    """One row (FirstFrame, LastFrame, Covers, Matches) on whether the frames span or equal [start, end]."""
    found = rows.agg(F.min(FRAME).alias("FirstFrame"), F.max(FRAME).alias("LastFrame"))
    first, last = F.col("FirstFrame"), F.col("LastFrame")
    return found.select("FirstFrame", "LastFrame", F.coalesce((first <= start) & (last >= end), F.lit(False)).alias("Covers"), F.coalesce((first == start) & (last == end), F.lit(False)).alias("Matches"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, sha1) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.sha1("content").alias("sha1"))


def settings_key(settings: Column) -> Column:
    """First 16 hex digits of the SHA-1 of a canonical JSON text."""
    return F.substring(F.sha1(settings.cast("binary")), 1, 16)


def write_regions(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Rank int, Label string, F0 int, F1 int, X0 double, Y0 double, X1 double, Y1 double").json(path)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg}", recursive: bool = False) -> DataFrame:
    """(path, stem, FrameID, DetectionIndex) of files; numbers from names such as f000012_det00120003.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    number = F.expr("try_cast(regexp_extract(path, 'det_?(\\\\d+)', 1) as long)")
    return files.select("path", stem.alias("stem"), number.alias("_n")).select("path", "stem", F.floor(F.col("_n") / 10000).alias(FRAME), F.pmod("_n", F.lit(10000)).alias("DetectionIndex"))


def pair_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the label file of the same stem; images without keep a null."""
    return images.join(labels.select("stem", F.col("path").alias("label_path")), "stem", "left")


def parse_box_labels(lines: DataFrame) -> DataFrame:
    """(path, class_id, corners) from lines of a class and eight numbers; other lines are left to label_issues."""
    parts = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(F.slice("_p", 2, 8), lambda v: v.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get("_v", 2 * i).alias("x"), F.get("_v", 2 * i + 1).alias("y")))
    rows = lines.withColumn("_p", parts).where(F.size("_p") == 9).withColumn("_v", numbers)
    return rows.select("path", F.get("_p", F.lit(0)).try_cast("int").alias("class_id"), pairs.alias("corners"))


def parse_pose_labels(lines: DataFrame) -> DataFrame:
    """(path, class_id, box, keypoints) from a class, a box of four numbers and triples."""
    rows = lines.withColumn("_p", F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.try_cast("double"))).where((F.size("_p") >= 8) & ((F.size("_p") - 5) % 3 == 0))
    triples = F.transform(F.sequence(F.lit(0), ((F.size("_p") - 5) / 3 - 1).cast("int")), lambda i: F.struct(F.get("_p", 5 + 3 * i).alias("x"), F.get("_p", 6 + 3 * i).alias("y"), F.get("_p", 7 + 3 * i).alias("v")))
    return rows.select("path", F.get("_p", F.lit(0)).cast("int").alias("class_id"), F.slice("_p", 2, 4).alias("box"), triples.alias("keypoints"))


def label_issues(lines: DataFrame) -> DataFrame:
    """(path, value, issue): lines with the wrong number of fields, a field that is no number, or one outside [0, 1]."""
    rows = lines.withColumn("_p", F.split(F.trim("value"), r"\s+")).withColumn("_v", F.transform(F.slice("_p", 2, 100), lambda v: v.try_cast("double")))
    issue = (
        F.when(F.size("_p") != 9, "field count").when(F.get("_p", F.lit(0)).try_cast("int").isNull() | F.exists("_v", lambda v: v.isNull()), "not a number")
        .when(F.exists("_v", lambda v: (v < -1e-6) | (v > 1 + 1e-6)), "out of range")
    )
    return rows.select("path", "value", issue.alias("issue")).where("issue is not null")


def format_box_labels(rows: DataFrame) -> DataFrame:
    """Lines of a class and eight numbers from (class_id, corners)."""
    numbers = F.flatten(F.transform("corners", lambda p: F.array(F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"]))))
    return rows.select(F.concat_ws(" ", F.col("class_id").cast("string"), numbers).alias("value"))


def remap_labels(rows: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Only mapped classes, under their new numbers."""
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return rows.withColumn("class_id", F.try_element_at(found, F.col("class_id"))).where("class_id is not null")


def keypoint_annotations(rows: DataFrame) -> DataFrame:
    """One JSON text for each image: dense ids, its annotations, visible keypoints counted.

    rows(path, class_id, keypoints) come from many images; each image's annotations are few.
    """
    visible = F.size(F.filter("keypoints", lambda k: k["v"] > 0))
    each = rows.groupBy("path").agg(F.collect_list(F.struct(F.col("class_id").alias("category_id"), "keypoints", visible.alias("num_keypoints"))).alias("annotations"))
    return each.select("path", F.to_json(F.struct(F.xxhash64("path").alias("id"), F.col("path").alias("file_name"), "annotations")).alias("value"))


def export_split(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A data set in folders by split and class."""
    rows.repartition("split", "class_name").write.mode("overwrite").partitionBy("split", "class_name").format(fmt).save(path)


def merge_sources(sources: list[DataFrame], digest: str = "sha") -> DataFrame:
    """All rows of the sources, one for each digest: that of the earliest source, then the least path."""
    union = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_rank", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union.withColumn("_r", F.row_number().over(Window.partitionBy(digest).orderBy("source_rank", "path"))).where("_r = 1").drop("_r")


def read_json_maps(lines: DataFrame, column: str = "value") -> DataFrame:
    """Bad JSON is an empty map."""
    return lines.withColumn("meta", F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>")))


def manifest(counts: dict) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(counts, sort_keys=True, separators=(",", ":"))
