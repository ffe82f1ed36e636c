"""Caches by frame and the embedding table against plain dictionaries."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trackmill.sources import caches


def rows_of(spark, data):
    return spark.createDataFrame([(f, d, c, 0.5) for f, d, c in data], "FrameID long, DetectionID long, ClassName string, Confidence double")


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_ranges_replace_their_frames_only(spark, tmp_path):
    """Random writes equal a dictionary of frames; gaps are what was never written; untouched blocks keep their files."""
    draw, cache = random.Random(8), caches.FrameCache(spark, str(tmp_path), "classes", {"model": "m", "size": 64}, block=10)
    held, covered = {}, set()
    assert not cache.hit(0, 5) and cache.read(0, 5).count() == 0 and [tuple(r) for r in cache.gaps(3, 9).collect()] == [(3, 9)]
    for k, (start, end) in enumerate([(0, 25), (40, 47), (8, 12), (20, 20), (26, 39), (70, 95), (0, 9)]):
        data = [(f, d, f"{k}-{d}") for f in range(start, end + 1) for d in range(draw.randrange(3)) if k != 6]
        rest = files_of(tmp_path)
        cache.write(rows_of(spark, data), start, end)
        held = {f: v for f, v in held.items() if not start <= f <= end}
        for f, d, c in data:
            held.setdefault(f, []).append((d, c))
        covered |= set(range(start, end + 1))
        blocks = {f"FrameBlock={b}/" for b in range(start // 10, end // 10 + 1)}
        now = files_of(tmp_path)
        assert all(now.get(p) == t for p, t in rest.items() if "/rows/" in p and not any(b in p for b in blocks))
    assert {(r.FrameID, r.DetectionID, r.ClassName) for r in cache.read(0, 200).collect()} == {(f, d, c) for f, v in held.items() for d, c in v}
    for start, end in ((0, 95), (5, 47), (48, 69), (60, 120), (96, 97), (0, 0)):
        gaps = {f for r in cache.gaps(start, end).collect() for f in range(r.Start, r.End + 1)}
        assert gaps == set(range(start, end + 1)) - covered and cache.hit(start, end) == (not gaps)
        assert sorted(r.FrameID for r in cache.read(start, end).collect()) == sorted(f for f, v in held.items() if start <= f <= end for _ in v)
    assert sorted(tuple(r) for r in cache.covered().collect()) == [(0, 47), (70, 95)]
    assert "FrameBlock" in cache.read(20, 29)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_settings_are_other_caches(spark, tmp_path):
    one = caches.FrameCache(spark, str(tmp_path), "classes", {"model": "m", "size": 64})
    one.write(rows_of(spark, [(1, 0, "a")]), 0, 5)
    same = caches.FrameCache(spark, str(tmp_path), "classes", {"size": 64, "model": "m"})
    assert same.hit(0, 5) and not caches.FrameCache(spark, str(tmp_path), "classes", {"size": 65, "model": "m"}).hit(0, 5)
    assert not caches.FrameCache(spark, str(tmp_path), "tags", {"size": 64, "model": "m"}).hit(0, 5)
    for bad in ([(6, 0, "a")], [(None, 0, "a")]):
        with pytest.raises(ValueError, match="outside"):
            one.write(rows_of(spark, bad), 0, 5)
    with pytest.raises(ValueError, match="no frames"):
        one.write(rows_of(spark, []), 3, 2)
    with pytest.raises(ValueError, match="kind"):
        caches.FrameCache(spark, str(tmp_path), "sounds", {})
    assert {(r.FrameID, r.ClassName) for r in one.read(0, 9).collect()} == {(1, "a")}


def test_a_failed_write_is_not_entered(spark, tmp_path):
    cache = caches.FrameCache(spark, str(tmp_path), "classes", {}, block=10)
    cache.write(rows_of(spark, [(3, 0, "a")]), 0, 19)
    broken = rows_of(spark, [(25, 0, "b"), (15, 1, "c")]).withColumn("ClassName", F.when(F.col("FrameID") == 25, F.raise_error(F.lit("lost"))).otherwise(F.col("ClassName")))
    with pytest.raises(Exception, match="lost"):
        cache.write(broken, 15, 30)
    assert not cache.hit(20, 30) and cache.hit(0, 19) and [(r.FrameID, r.ClassName) for r in cache.read(0, 40).collect()] == [(3, "a")]


def test_fill_makes_only_gaps(spark, tmp_path):
    cache, asked = caches.FrameCache(spark, str(tmp_path), "classes", {}, block=10), []

    def make(start, end):
        asked.append((start, end))
        return rows_of(spark, [(f, 0, "x") for f in range(start, end + 1)])

    assert cache.fill(5, 12, make).count() == 8 and cache.fill(0, 20, make).count() == 21 and cache.fill(3, 18, make).count() == 16
    assert asked == [(5, 12), (0, 4), (13, 20)]


def test_poses_are_summed_up_when_read(spark, tmp_path):
    cache = caches.FrameCache(spark, str(tmp_path), "poses", {"pose": 1})
    rows = spark.createDataFrame([(0, 7, [(1.0, 2.0, 0.9), (3.0, 4.0, 0.3)]), (1, 8, [])], "FrameID long, DetectionID long, Keypoints array<struct<x:double,y:double,conf:double>>")
    cache.write(rows, 0, 1)
    for least, n in ((0.2, 2), (0.5, 1), (0.95, 0)):
        assert {r.DetectionID: (r.NumValid, r.NumKeypoints) for r in caches.read_poses(cache, 0, 1, least).collect()} == {7: (n, 2), 8: (0, 0)}


def test_listings_in_turn_equal_one_rebuild(spark, tmp_path):
    draw, store, at = random.Random(1), caches.EmbeddingStore(spark, str(tmp_path), {"model": "m", "dim": 2}), lambda k: datetime.datetime(2024, 1, 1 + k)
    made = []

    def make(files):
        made.append({r.Path for r in files.collect()})
        return files.withColumn("Embedding", F.array(F.length("Path").cast("float"), F.dayofmonth("Modified").cast("float")))

    files = {}
    for turn in range(3):
        want = {"add": 0, "update": 0, "remove": 0}
        touched = set()
        for k in range(30):
            name = f"/img/{k}.png"
            act = draw.choice(("keep", "keep", "touch", "drop"))
            if act == "touch" or (name not in files and turn == 0):
                want["update" if name in files else "add"] += 1
                files[name] = at(turn)
                touched.add(name)
            elif act == "drop" and name in files:
                del files[name]
                want["remove"] += 1
        listing = spark.createDataFrame([*files.items(), *list(files.items())[:3], (None, at(0))], "Path string, Modified timestamp")
        told = store.update(listing, make)
        assert {r.Change: r.Count for r in told.collect()} == {k: v for k, v in want.items() if v} and made[-1] == touched
        found = {r.Path: (r.Modified, r.Embedding, r.Version) for r in store.read().collect()}
        assert found == {p: (t, [float(len(p)), float(t.day)], turn + 1) for p, t in files.items()} and store.read().count() == len(files)
    again = caches.EmbeddingStore(spark, str(tmp_path), {"model": "other"})
    again.update(listing, make)
    assert sorted(r.Path for r in again.read().collect()) == sorted(files)


def test_ingest(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("b", b"2")], "path string, content binary")
    stored = spark.createDataFrame([("a", "old"), ("z", "old")], "path string, sha1 string")
    assert sorted((r.path, r.sha1[:3]) for r in caches.ingest(files, stored).collect()) == [("a", "old"), ("b", "da4"), ("z", "old")]
