"""Cleaning of keypoints along tracks against a version that goes row by row."""

import math
import random
import statistics

import pytest

from trackmill.operators import pose_time

SCHEMA = "TrajectoryID long, FrameID long, Keypoints array<struct<x:double,y:double,conf:double>>, PoseState string, Note string"


def twin(track, max_gap, limit, fill):
    """track: (frame, points, state) in order of frames; changes the points, returns counts of suppressed and filled by row."""
    wide = max(5, 2 * max_gap)
    odd, filled = [0] * len(track), [0] * len(track)
    for k in range(len(track[0][1])):
        sound = [i for i, (_, p, s) in enumerate(track) if s in ("good", "partial") and p[k][2] > 0]
        gone = set()
        for at, i in enumerate(sound):
            near = sound[max(0, at - wide // 2) : at + (wide - 1) // 2 + 1]
            if len(near) >= 3:
                for c in (0, 1):
                    v = [track[j][1][k][c] for j in near]
                    if abs(track[i][1][k][c] - sum(v) / len(v)) / max(statistics.stdev(v), 1e-6) > limit:
                        gone.add(i)
        for i in gone:
            track[i][1][k][2] = 0.0
            odd[i] += 1
        known = [i for i, (_, p, _) in enumerate(track) if p[k][2] > 0]
        for a, b in zip(known, known[1:]):
            if fill and 1 <= b - a - 1 <= max_gap:
                for i in range(a + 1, b):
                    for c in (0, 1):
                        lo, hi = track[a][1][k][c], track[b][1][k][c]
                        track[i][1][k][c] = lo + (i - a) / (b - a) * (hi - lo)
                    track[i][1][k][2] = 0.3
                    filled[i] += 1
    return odd, filled


@pytest.mark.parametrize(("max_gap", "limit", "fill"), [(3, 1.8, True), (1, 1.4, True), (4, 2.0, False)])
def test_against_rows(spark, max_gap, limit, fill):
    draw, tracks = random.Random(max_gap), {}
    for t in range(12):
        frames = sorted(draw.sample(range(100), draw.randrange(1, 40)))
        tracks[t] = [(f, [[f + draw.gauss(0, 1) + (40 if draw.random() < 0.1 else 0), draw.gauss(5, 1), 0.0 if draw.random() < 0.3 or i in (0, len(frames) - 1) and t % 2 else draw.uniform(0.3, 1)] for _ in range(3)], draw.choice(("good", "good", "partial", "bad"))) for i, f in enumerate(frames)]
    rows = [(t, f, [tuple(x) for x in p], s, f"n{f}") for t, track in tracks.items() for f, p, s in track]
    draw.shuffle(rows)
    found = {(r.TrajectoryID, r.FrameID): r for r in pose_time.clean_poses(spark.createDataFrame(rows, SCHEMA).repartition(3), max_gap, limit, fill).collect()}
    assert len(found) == len(rows)
    total = [0, 0]
    for t, track in tracks.items():
        odd, filled = twin(track, max_gap, limit, fill)
        total = [total[0] + sum(odd), total[1] + sum(filled)]
        for (f, p, s), o, n in zip(track, odd, filled):
            r = found[t, f]
            assert (r.Suppressed, r.Filled, r.PoseState, r.Note) == (o, n, s, f"n{f}")
            assert all(a == pytest.approx(b) for x, y in zip(r.Keypoints, p) for a, b in zip(x, y))
            assert r.MeanConf == pytest.approx(sum(x[2] for x in p) / 3) and r.ValidFraction == pytest.approx(sum(x[2] > 0 for x in p) / 3)
    assert total[0] > 2 and (total[1] > 5) == fill


def test_nulls_and_one_shuffle(spark):
    rows = [(1, 0, None, "good", None), (1, 1, [(math.nan, 1.0, math.nan), (1.0, 1.0, 0.5)], None, None), (1, 2, [], "good", None), (2, 0, [(1.0, None, 0.5), (None, 2.0, None)], "good", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {(r.TrajectoryID, r.FrameID): r for r in pose_time.clean_poses(frame, 2, 3.0).collect()}
    assert found[1, 0].Keypoints is None and found[1, 2].Keypoints == [] and found[1, 0].MeanConf == 0.0
    assert found[1, 1].MeanConf == 0.5 and found[1, 1].ValidFraction == 0.5 and found[2, 0].ValidFraction == 0.5
    assert pose_time.clean_poses(frame.limit(0), 2, 3.0).collect() == []
    plan = pose_time.clean_poses(frame, 2, 3.0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") >= 2
