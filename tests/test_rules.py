"""Operators that SQL can't express, against brute force and hand-made cases."""

import math
import random

import numpy as np
import pytest

from trackmill.operators import curate, density, detections, kernels, review


def test_filter_keeps_speed_and_variances_in_bounds():
    f = kernels.Kalman(0, 0, 0.0, fastest=10.0)
    for k in range(1, 40):
        f.predict()
        f.correct(100.0 * k, 0.0, 0.0)
        assert math.hypot(*f.state[3:]) <= 10 + 1e-9
        assert (np.diag(f.spread) > 0).all() and np.allclose(f.spread, f.spread.T)
    for _ in range(400):
        f.predict()
    assert (np.diag(f.spread) <= 1000 + 1e-9).all()


def test_a_far_measurement_moves_the_place_by_the_limit_at_most():
    f = kernels.Kalman(0, 0, 0.0, fastest=10.0)
    f.predict()
    f.correct(1000.0, 0.0, 0.0)
    assert 0 < f.state[0] <= 10
    g = kernels.Kalman(0, 0, 0.0, fastest=10.0)
    g.predict()
    g.correct(5.0, 0.0, 0.0)
    assert 0 < g.state[0] <= 5 and g.spread[0, 0] < f.spread[0, 0]


def test_velocity_noise_follows_the_heading():
    east, north = kernels.Kalman(0, 0, 0.0, along=4.0, across=0.5, grown=0), kernels.Kalman(0, 0, math.pi / 2, along=4.0, across=0.5, grown=0)
    east.predict()
    north.predict()
    assert east.spread[3, 3] - east.spread[4, 4] == pytest.approx(3.5)
    assert north.spread[4, 4] - north.spread[3, 3] == pytest.approx(3.5)


def test_young_tracks_are_held_back():
    f = kernels.Kalman(0, 0, 0.0, damping=1.0, held=0.5, grown=4)
    f.state[3] = 8.0
    f.predict()
    assert f.state[3] == pytest.approx(4.0)


def test_headings():
    deg = math.radians
    slow = kernels.Heading(slow=2.0, most_turn=30.0)
    assert slow.step(0.0, 0.0) == 0.0
    assert slow.step(deg(60), 0.0) == pytest.approx(deg(30))
    assert slow.step(deg(200), 0.0) == pytest.approx(deg(20))
    assert kernels.Heading().step(math.pi, 5.0, motion=0.0) == pytest.approx(0.0)
    firm = kernels.Heading(persist=3)
    firm.step(0.0, 5.0, 0.0, True)
    got = [firm.step(math.pi, 5.0, math.pi, True, 0.9) for _ in range(3)]
    assert got == pytest.approx([0.0, 0.0, math.pi])
    assert firm.step(0.0, 5.0, 0.0, True, 0.1) == pytest.approx(math.pi)


def test_frame_scores_by_hand(spark):
    rows = [(t, 1, 0.25, "active" if t else "lost", 25.0, 100.0) for t in range(4)] + [(t, 2, 0.9, "active", 0.0, 0.0) for t in range(16)]
    got = {r.FrameID: r.Score for r in detections.frame_scores(spark.createDataFrame(rows, "TrajectoryID long, FrameID long, DetectionConfidence double, State string, c double, u double"), 8, 0.5, "c", "u").collect()}
    assert got[1] == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.15 * 0.5 + 0.1 / 8 + 0.05)
    assert got[2] == pytest.approx(0.075)


def brute_shuffles(events, margin):
    rows, free, out = sorted(events, key=lambda e: (e[1], e[0])), set(), []
    free = {e[0] for e in rows}
    for seed, f0, f1, tracks in rows:
        if seed not in free:
            continue
        held = [e for e in rows if e[0] in free and (e[1], e[0]) >= (f0, seed) and set(e[3]) & set(tracks) and e[1] <= f1 + margin and e[2] >= f0 - margin]
        free -= {e[0] for e in held}
        every = sorted({t for e in held for t in e[3]})
        if len(held) > 1 and len(every) > 2:
            out.append((seed, min(e[1] for e in held), max(e[2] for e in held), tuple(every), len(held)))
    return sorted(out)


def test_multi_shuffles_equal_brute_force(spark):
    random.seed(4)
    events = []
    for i in range(120):
        f0 = random.randrange(900)
        events.append((i, f0, f0 + random.randrange(30), sorted(random.sample(range(12), random.randrange(1, 3)))))
    got = review.multi_shuffles(spark.createDataFrame(events, "EventID long, F0 long, F1 long, Tracks array<long>")).collect()
    assert sorted((r.Seed, r.F0, r.F1, tuple(r.Tracks), r.Events) for r in got) == brute_shuffles(events, 10) != []


def test_histogram_duplicates_equal_brute_force(spark):
    random.seed(6)
    base = [[random.random() for _ in range(8)] for _ in range(12)]
    rows = [(i, [max(0.0, x + random.uniform(-0.05, 0.05)) for x in base[i % 12]]) for i in range(90)] + [(90, [0.0] * 8)]

    def far(a, b):
        sa, sb = sum(a) or 1, sum(b) or 1
        return math.sqrt(max(0.0, 1 - sum(math.sqrt(x / sa * y / sb) for x, y in zip(a, b, strict=True))))

    kept = {}
    for i, h in rows:
        first = next((j for j, g in rows[:i] if kept[j] == j and far(h, g) <= 0.1), None)
        kept[i] = i if first is None else first
    table = spark.createDataFrame(rows, "id long, h array<double>")
    got = curate.keep_first(table, "id", curate.histogram_pairs(table, "id", "h", 0.1)).collect()
    assert {r.id: r.KeptID for r in got} == kept and len(set(kept.values())) < len(rows)


def test_clusters_find_separate_clouds(spark):
    random.seed(8)
    rows = [(i, [10.0 * (i % 3) + random.random(), random.random()]) for i in range(90)]
    found = curate.clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.Cluster, set()).add(r.id % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]
    assert curate.representatives(found, "id").count() == 3
    assert curate.clusters(spark.createDataFrame(rows[:1], "id long, v array<double>"), "id", "v", 3).collect()[0].Cluster == 0


def test_regions_equal_a_flood_fill(spark):
    random.seed(9)
    cells = {(random.randrange(8), random.randrange(9), random.randrange(9)) for _ in range(90)} | {(f, 20 + f, 20) for f in range(40)}
    left, sizes = set(cells), []
    while left:
        todo, part = [left.pop()], 0
        while todo:
            f, x, y = todo.pop()
            part += 1
            near = {(f + a, x + b, y + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)} & left
            left -= near
            todo += near
        sizes.append(part)
    got = density.regions(spark.createDataFrame(sorted(cells), "FrameID long, GX long, GY long"), 1, 1).collect()
    assert sorted(r.Cells for r in got) == sorted(sizes)


def test_farthest_first_equals_brute_force(spark):
    random.seed(10)
    rows = [(i, [random.random() for _ in range(4)]) for i in range(60)]
    picked = [5]
    while len(picked) < 6:
        far = {i: min(math.dist(v, rows[p][1]) for p in picked) for i, v in rows if i not in picked}
        picked.append(min(far, key=lambda i: (-far[i], i)))
    got = curate.farthest_first(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 6, 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.Pick)] == picked


def test_cubic_fill_meets_known_rows_and_a_line(spark):
    rows = [(1, f, 3.0 * f + 1 if f % 3 == 0 else None) for f in range(13)]
    got = kernels.fill_cubic(spark.createDataFrame(rows, "TrajectoryID long, FrameID long, X double"), ["X"], 5).collect()
    assert len(got) == 13 and all(r.X == pytest.approx(3.0 * r.FrameID + 1) for r in got)


def test_a_short_burst_of_flipped_headings_is_turned_back(spark):
    rows = [(1, f, float(f), 0.0, math.pi if 10 <= f < 12 else 0.0, f) for f in range(30)]
    got = kernels.repair_heading_flips(spark.createDataFrame(rows, "TrajectoryID long, FrameID long, X double, Y double, Theta double, DetectionID long"), 5).collect()
    assert all(abs(math.sin(r.Theta)) < 1e-9 and math.cos(r.Theta) > 0 for r in got)


def test_greedy_assignment_equals_brute_force(spark):
    from trackmill.operators import pairs

    random.seed(11)
    costs = [(f, t, d, random.randrange(20) / 2) for f in range(6) for t in range(7, 12) for d in range(8, 14) if random.random() < 0.7]
    want = []
    for frame in range(6):
        met = set()
        for f, t, d, c in sorted((x for x in costs if x[0] == frame and x[3] < 8), key=lambda x: (x[3], x[1], x[2])):
            if ("t", t) not in met and ("d", d) not in met:
                met |= {("t", t), ("d", d)}
                want.append((f, t, d, c))
    got = pairs.assign_greedily(spark.createDataFrame(costs, "FrameID long, TrackID long, DetectionID long, Cost double"), 8.0).collect()
    assert sorted(map(tuple, got)) == sorted(want)
