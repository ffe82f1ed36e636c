"""Caches by frame: tags, poses, headings and class predictions of a video, appended by ranges of frames.

A cache is a folder of Parquet in blocks of frames beside a table of the ranges that were written, under a key of the
settings that made them. Writing a range replaces its blocks and no others, keeps the rest of the two blocks at its
ends, and then enters the range; so a range that is entered is there whole, and one that a failed write left half
done is not entered and is written again. A frame without rows is covered like any other.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions import pose
from trackmill.operators.sequences import FRAME
from trackmill.sources.io import replace_table

#: Columns of each kind of cache, beside FrameID.
KINDS = {
    "tags": "TagID long, CX double, CY double, Corners array<struct<x:double,y:double>>, DetectionIndex long, Hamming int",
    "poses": "DetectionID long, Keypoints array<struct<x:double,y:double,conf:double>>",
    "headings": "DetectionID long, Theta double, Confidence double, Directed boolean",
    "classes": "DetectionID long, ClassName string, Confidence double",
}


def cache_key(settings: dict) -> str:
    """Sixteen hex digits of the settings: equal for equal settings in whatever order they are given."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


class FrameCache:
    """The cache of one kind and one set of settings in a folder. Other settings are another cache beside it."""

    def __init__(self, spark: SparkSession, root: str, kind: str, settings: dict, block: int = 1000):
        if kind not in KINDS:
            raise ValueError(f"no kind of cache {kind!r}; there are {', '.join(KINDS)}")
        self.spark, self.block = spark, block
        self.schema = f"{FRAME} long, {KINDS[kind]}"
        home = f"{root.rstrip('/')}/{kind}-{cache_key({**settings, 'block': block})}"
        self.rows, self.ranges = f"{home}/rows", f"{home}/ranges"

    def _there(self, path: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(conf).exists(place)

    def covered(self) -> DataFrame:
        """(Start, End): ranges of frames that were written, apart from each other."""
        return self.spark.read.schema("Start long, End long").parquet(self.ranges) if self._there(self.ranges) else self.spark.createDataFrame([], "Start long, End long")

    def gaps(self, start: int, end: int) -> DataFrame:
        """(Start, End): the parts of start to end that were never written, in order."""
        inside = self.covered().where((F.col("Start") <= end) & (F.col("End") >= start))
        ends = inside.unionAll(self.spark.createDataFrame([(start - 1, start - 1), (end + 1, end + 1)], "Start long, End long"))
        last = F.max("End").over(Window.orderBy("Start", "End").rowsBetween(Window.unboundedPreceding, -1))  # ranges that are apart are few
        gap = ends.select((last + 1).alias("_from"), (F.col("Start") - 1).alias("_to"))
        return gap.where("_from <= _to").select(F.greatest("_from", F.lit(start)).cast("long").alias("Start"), F.least("_to", F.lit(end)).cast("long").alias("End")).where("Start <= End").orderBy("Start")

    def hit(self, start: int, end: int) -> bool:
        """Whether all of start to end can be read. A cache of other settings never answers."""
        return self._there(self.ranges) and not self.gaps(start, end).take(1)

    def write(self, found: DataFrame, start: int, end: int) -> None:
        """Enter the rows of frames start to end. What was there for these frames goes; rows outside raise ValueError."""
        if start > end:
            raise ValueError(f"no frames from {start} to {end}")
        known = self.spark.createDataFrame([], self.schema)
        rows = found.select(*[F.col(f.name).cast(f.dataType) for f in known.schema])
        if rows.where(F.col(FRAME).isNull() | ~F.col(FRAME).between(start, end)).take(1):
            raise ValueError(f"rows outside frames {start} to {end}")
        first, last = start // self.block, end // self.block
        block = F.floor(F.col(FRAME) / self.block).cast("long").alias("FrameBlock")
        # a row without a frame in each block, so that one that loses all its rows is replaced too
        marks = self.spark.range(first, last + 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema], F.col("id").alias("FrameBlock"))
        whole = rows.select("*", block).unionAll(marks)
        if self._there(self.rows):
            old = self._stored().where(F.col("FrameBlock").isin(first, last) & ~F.col(FRAME).between(start, end))
            whole = whole.unionAll(old.select(*whole.columns))
        whole.repartition("FrameBlock").sortWithinPartitions("FrameBlock", FRAME).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("FrameBlock").parquet(self.rows)
        self._enter(start, end)

    def _enter(self, start: int, end: int) -> None:
        ranges = self.covered().unionAll(self.spark.createDataFrame([(start, end)], "Start long, End long"))
        before = Window.orderBy("Start", "End")
        top = F.max("End").over(before.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("Start") <= F.coalesce(top, F.lit(-(1 << 62))) + 1, 0).otherwise(1)).over(before)
        merged = ranges.withColumn("_island", island).groupBy("_island").agg(F.min("Start").alias("Start"), F.max("End").alias("End")).drop("_island")
        replace_table(merged.coalesce(1), self.ranges)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, FrameBlock long").parquet(self.rows)

    def read(self, start: int, end: int) -> DataFrame:
        """Rows of frames start to end, from their blocks only. Asks nothing of coverage: see ``hit`` and ``gaps``."""
        if not self._there(self.rows):
            return self.spark.createDataFrame([], self.schema)
        return self._stored().where(F.col("FrameBlock").between(start // self.block, end // self.block) & F.col(FRAME).between(start, end)).drop("FrameBlock")

    def fill(self, start: int, end: int, make) -> DataFrame:
        """Rows of start to end; ``make(start, end)`` gives those of each gap, which are entered first."""
        for gap in self.gaps(start, end).collect():
            self.write(make(gap["Start"], gap["End"]), gap["Start"], gap["End"])
        return self.read(start, end)


def read_poses(cache: FrameCache, start: int, end: int, least: float) -> DataFrame:
    """Stored poses with their summary, which follows the confidence that is asked for and isn't stored."""
    return cache.read(start, end).select("*", pose.summary(F.col("Keypoints"), least).alias("_s")).select("*", "_s.*").drop("_s")


def merge_embeddings(stored: DataFrame, listing: DataFrame, make) -> DataFrame:
    """The embedding table after a listing of files: stored(Path, Modified, Embedding) and listing(Path, Modified) give the same columns.

    Rows whose file has the same time are kept, those whose file is gone are left out, and ``make`` gets (Path,
    Modified) of files that are new or have another time and returns them with Embedding. A file listed twice counts
    at its latest time; a null path is no file; a stored row without an embedding is made again.
    """
    files = listing.where("Path is not null").groupBy("Path").agg(F.max("Modified").alias("Modified"))
    plan = embedding_changes(stored, files)
    kept = stored.join(plan.where("Change = 'keep'").select("Path"), "Path", "left_semi").dropDuplicates(["Path"]).select("Path", "Modified", "Embedding")
    made = make(plan.where("Change in ('add', 'update')").select("Path", "Modified"))
    return kept.unionByName(made.select("Path", "Modified", "Embedding"))


def embedding_changes(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """(Path, Modified, Change): what a listing of files means for each stored or listed path: keep, add, update or remove."""
    one = stored.groupBy("Path").agg(F.max("Modified").alias("_was"), F.bool_and(F.col("Embedding").isNotNull()).alias("_whole"))
    both = one.join(listing.select("Path", "Modified"), "Path", "full")
    change = F.when(F.col("Modified").isNull() & F.col("_was").isNotNull(), "remove").when(F.col("_was").isNull(), "add").when((F.col("_was") == F.col("Modified")) & F.col("_whole"), "keep").otherwise("update")
    return both.select("Path", F.coalesce("Modified", "_was").alias("Modified"), change.alias("Change"))


class EmbeddingStore:
    """A table of embeddings of one model, swapped whole at each update; its version counts the updates."""

    SCHEMA = "Path string, Modified timestamp, Embedding array<float>, Version long"

    def __init__(self, spark: SparkSession, root: str, model: dict):
        self.spark, self.path = spark, f"{root.rstrip('/')}/embeddings-{cache_key(model)}"

    def read(self) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(conf).exists(place)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def update(self, listing: DataFrame, make) -> DataFrame:
        """Follow a listing of files; only what is new or changed is made. Returns the changes of this update."""
        old = self.read()
        version = (old.agg(F.max("Version")).first()[0] or 0) + 1
        changes = embedding_changes(old, listing.where("Path is not null").groupBy("Path").agg(F.max("Modified").alias("Modified"))).where("Change <> 'keep'")
        told = changes.groupBy("Change").count().collect()
        replace_table(merge_embeddings(old, listing, make).withColumn("Version", F.lit(version).cast("long")), self.path)
        return self.spark.createDataFrame([(r["Change"], r["count"]) for r in told], "Change string, Count long")


def ingest(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, sha1): stored files and those of files(path, content) whose path isn't stored yet; of equal paths one row."""
    new = files.select("path", F.sha1("content").alias("sha1")).dropDuplicates(["path"])
    return stored.select("path", "sha1").unionAll(new.join(stored.select("path"), "path", "left_anti"))
