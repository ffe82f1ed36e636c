from trackmill.streaming import windows


def test_slot_states_over_micro_batches(spark, tmp_path):
    rows = [(1, f, m) for f, m in enumerate([True, True, False, False, False, True])] + [(2, 0, True), (2, 1, False)]
    source = tmp_path / "in"
    for i, part in enumerate((rows[:3] + rows[6:], rows[3:6])):
        spark.createDataFrame(part, "TrackID long, FrameID long, Matched boolean").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("TrackID long, FrameID long, Matched boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = windows.slot_states(stream, 3).writeStream.format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.TrackID, r.FrameID): (r.State, r.TrajectoryID) for r in spark.table("slots").collect()}
    assert found[1, 3] == ("occluded", 0) and found[1, 4] == ("lost", 0) and found[1, 5] == ("active", 1)
    assert found[2, 1] == ("occluded", 0)


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = tmp_path / "ev"
    events.repartition(2).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    query = windows.tumbling_counts(stream, "1 hour", "3650 days").writeStream.format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, windows.tumbling_counts(events).collect()))
