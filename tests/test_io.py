from trackmill.sources import io


def test_csv_round_trip_hides_unseen_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TrackID,TrajectoryID,Index,X,Y,Theta,FrameID,State,DetectionID\n0,1,0,10.4,5,0.1,0,active,3.0\n0,1,1,11,6,0.2,1,occluded,\n0,1,2,nan,6,0.2,2,active,4\n")
    rows = io.read_trajectories(spark, str(tmp_path / "t.csv"))
    got = {r.FrameID: r for r in rows.collect()}
    assert (got[0].X, got[0].DetectionID) == (10.4, 3) and got[1].X is None and got[2].X is None and got[1].DetectionConfidence is None
    io.write_trajectories(rows, str(tmp_path / "out"))
    again = io.read_trajectories(spark, str(tmp_path / "out"))
    assert sorted((r.FrameID, r.X) for r in again.collect() if r.X is not None) == [(0, 10.0)]


def test_replace_swaps_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        io.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_detection_cache_reads_only_its_blocks(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(5000).selectExpr("id as FrameID", "id * 10 as DetectionID")
    io.write_detections(rows, path)
    found = io.read_detections(spark, path, 990, 1010)
    assert found.count() == 21 and "PartitionFilters: [isnotnull(FrameBlock" in found._jdf.queryExecution().executedPlan().toString()
    r = io.coverage(rows, 0, 4999).first()
    assert r.Covers and r.Matches and not io.coverage(rows, 0, 5000).first().Covers
    assert not io.coverage(rows.limit(0), 0, 1).first().Covers


def test_labels(spark):
    good, pose = "2 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "0 0.5 0.5 0.2 0.2 0.1 0.2 2 0.3 0.4 0"
    lines = spark.createDataFrame([("a", good), ("a", "1 2 3"), ("b", good.replace("0.2", "1.2", 1)), ("c", good.replace("0.1", "x", 1)), ("d", pose)], "path string, value string")
    assert sorted((r.path, r.issue) for r in io.label_issues(lines).collect()) == [("a", "field count"), ("b", "out of range"), ("c", "not a number"), ("d", "field count")]
    boxes = io.parse_box_labels(lines.where(f"value = '{good}'"))
    assert boxes.first().class_id == 2 and boxes.first().corners[2].y == 0.2
    assert io.format_box_labels(boxes).first().value.split()[:2] == ["2", "0.100000"]
    assert io.remap_labels(boxes, {2: 7}).first().class_id == 7 and io.remap_labels(boxes, {3: 7}).count() == 0
    found = io.parse_pose_labels(lines.where("path = 'd'"))
    assert len(found.first().keypoints) == 2 and found.first().keypoints[0].v == 2
    assert '"num_keypoints":1' in io.keypoint_annotations(found).first().value


def test_files_merge_and_maps(spark, tmp_path):
    for name in ("f1_det00120003.png", "x.png", "y.txt"):
        (tmp_path / name).write_bytes(b"1")
    got = {r.stem: (r.FrameID, r.DetectionIndex) for r in io.scan_files(spark, str(tmp_path), "*.png").collect()}
    assert got == {"f1_det00120003": (12, 3), "x": (None, None)}
    assert len({r.sha1 for r in io.content_hashes(spark, str(tmp_path)).collect()}) == 1
    a, b = (spark.createDataFrame(rows, "path string, sha string") for rows in ([("p", "1"), ("o", "1")], [("q", "1"), ("r", "2")]))
    assert sorted(r.path for r in io.merge_sources([a, b]).collect()) == ["o", "r"]
    assert [r.meta for r in io.read_json_maps(spark.createDataFrame([('{"a":"1"}',), ("{bad",)], "value string")).collect()] == [{"a": "1"}, {}]
    io.export_split(spark.createDataFrame([("p", "train", "c")], "path string, split string, class_name string"), str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set" / "split=train")).count() == 1
