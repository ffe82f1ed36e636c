"""Costs, gates and the three phases on planted cases and against plain loops; replays forward, reverse and as a stream."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.operators import association as a
from trackmill.operators import kernels as k
from trackmill.streaming import tracker as st

NAN = float("nan")


def pair(n_at, m_at, **more):
    both = {"tracks": {"at": np.array(n_at, float)}, "seen": {"at": np.array(m_at, float)}}
    for name, (one, two) in more.items():
        both["tracks"][name], both["seen"][name] = np.array(one), np.array(two)
    return a.Tracks(**both["tracks"]), a.Seen(**both["seen"])


def test_costs_are_the_weighted_terms():
    t, s = pair([[0, 0, 0.1], [50, 0, 3.0]], [[3, 4, math.pi], [400, 0, 0]], area=([100.0, NAN], [80.0, 70.0]), aspect=([2.0, 1.0], [1.5, 1.0]))
    rules = a.Rules(reach=100, place=1, turn=10, area=0.5, aspect=4)
    cost = a.costs(t, s, rules)
    assert cost[0, 0] == pytest.approx(5 + 10 * 0.1 + 0.5 * 20 + 4 * 0.5) and cost[0, 1] == a.VETO
    assert cost[1, 0] == pytest.approx(math.hypot(47, 4) + 10 * (math.pi - 3) + 4 * 0.5)  # an unknown area is not held against it
    s.directed = np.array([True, False])
    assert a.costs(t, s, rules)[0, 0] == pytest.approx(5 + 10 * (math.pi - 0.1) + 12)
    t.inverse = np.array([np.diag([1 / 9, 1 / 16]), np.eye(2)])
    assert a.distances(t, s, True)[0, 0] == pytest.approx(math.sqrt(2))


def test_identities_share_their_weight():
    t, s = pair([[0, 0, 0]] * 3, [[0, 0, 0]] * 3, tag=([1, 2, -1], [1, 3, -1]), classes=([[0], [1], [-1]], [[0], [-1], [1]]))
    got = a.identity(t, s, a.Rules())
    assert got.tolist() == [[-20, 25, 25], [50, 25, -10], [0, 0, 0]]
    t.classes = s.classes = None
    assert a.identity(t, s, a.Rules()).tolist() == [[-20, 50, 0], [50, 50, 0], [0, 0, 0]]
    t.tag = np.array([-1, -1, -1])
    assert a.identity(t, s, a.Rules()) == 0


def test_gates_and_pose_vetoes():
    pose = np.array([[0, 0], [1, 0], [0, 1], [1, 1.0]])
    t, s = pair([[0, 0, 0], [0, 0, 0]], [[5, 0, 0]] * 4, area=([10.0, 10.0], [10.0, 30.0, 10.0, 10.0]), aspect=([1.0, 1.0], [1.0, 1.0, 2.0, 1.0]), pose=([pose, pose * NAN], [pose + 0.1, pose, pose, pose + 1]))
    s.visible = np.array([1.0, 1.0, 1.0, 1.0])
    cost = a.costs(t, s, a.Rules())
    assert cost[0, 0] == 5 and (cost[0, 1:] == a.VETO).all() and cost[1, 3] == 5
    s.visible = np.array([1.0, 1.0, 1.0, 0.4])
    assert a.costs(t, s, a.Rules())[0, 3] == 5
    apart, shared = a.pose_distances(np.array([pose, [[0, 0], [NAN, 0], [NAN, 0], [1, 1]]]), np.array([pose + [3, 4]]))
    assert apart[0, 0] == 5 and math.isnan(apart[1, 0]) and shared.tolist() == [[4], [2]]
    wide = a.Tracks(np.zeros((3, 3)), spread=np.array([0.0, 400.0, 9999.0]), stride=np.array([0.0, 20.0, 9999.0]))
    assert a.motion_gates(wide, a.Rules(reach=10)) == pytest.approx([14, 14 * 1.85, 14 * 2.7])


def phases_twin(cost, raw, lost, matched, started, rules):
    """The three phases with loops; established tracks by trying every assignment."""
    n, m = cost.shape
    gate = [rules.reach * (max(1.0, rules.young_gate) if matched[i] < rules.grown else 1.0) for i in range(n)]
    c = [[a.NEVER if raw[i][j] >= gate[i] else cost[i][j] for j in range(m)] for i in range(n)]
    old = [i for i in range(n) if matched[i] >= rules.grown and not lost[i]]
    slots = [*range(m), *[None] * max(0, len(old) - m)]
    best = min(itertools.permutations(slots, len(old)), key=lambda p: sum(c[i][j] for i, j in zip(old, p) if j is not None))
    pairs = [(i, j) for i, j in zip(old, best) if j is not None and c[i][j] < rules.reach and raw[i][j] < rules.speed_gate * rules.body]
    free = set(range(m)) - {j for _, j in pairs}
    for i in sorted((i for i in range(n) if i not in old and not lost[i]), key=lambda i: -matched[i]):
        if free:
            j = min(sorted(free), key=lambda j: c[i][j])
            if c[i][j] < rules.reach and raw[i][j] < gate[i]:
                pairs.append((i, j))
                free.discard(j)
    begun, slots = [], [i for i in range(n) if lost[i]]
    for j in sorted(free):
        if any(raw[i][j] < 0.8 * rules.reach for i in range(n) if not lost[i]):
            continue
        near = [i for i in slots if started[i] and raw[i][j] < rules.reach]
        new = [i for i in slots if not started[i]]
        i = min(near, key=lambda i: raw[i][j]) if near else new[0] if new else None
        if i is not None:
            begun.append((i, j))
            slots.remove(i)
    return pairs, begun


def test_phases_against_loops():
    draw = np.random.default_rng(6)
    for _ in range(300):
        n, m = draw.integers(1, 6), draw.integers(1, 6)
        t, s = pair(draw.uniform(0, 120, (n, 3)), draw.uniform(0, 120, (m, 3)))
        lost, matched = draw.random(n) < 0.4, draw.integers(0, 20, n)
        started = ~lost | (draw.random(n) < 0.6)
        t.at[~started] = NAN
        rules = a.Rules(reach=60, body=30, young_gate=1.5)
        cost, raw = np.nan_to_num(a.costs(t, s, rules), nan=a.NEVER), a.distances(t, s)
        got = a.assign_in_phases(cost, t, s, lost, matched, started, rules, k.assign)
        want = phases_twin(cost, raw, lost, matched, started, rules)
        assert sorted(got[0]) == sorted(want[0]) and got[1] == want[1]


def test_planted_phases():
    rules = a.Rules(reach=50, grown=5, body=20)
    t, s = pair([[0, 0, 0], [30, 0, 0], [200, 0, 0]], [[10, 0, 0], [29, 0, 0], [230, 0, 0]])
    go = lambda lost, matched, **how: a.assign_in_phases(a.costs(t, s, a.Rules(**{**rules.__dict__, **how})), t, s, np.array(lost), np.array(matched), np.ones(3, bool), a.Rules(**{**rules.__dict__, **how}), k.assign)
    assert go([False, False, True], [9, 9, 0]) == ([(0, 0), (1, 1)], [(2, 2)])
    assert go([False, False, True], [9, 9, 0], greedy=True) == ([(1, 1), (0, 0)], [(2, 2)])
    assert go([False, False, False], [1, 3, 0]) == ([(1, 1), (0, 0), (2, 2)], [])  # young tracks, the longest matched first
    assert go([False, False, False], [9, 9, 9], speed_gate=0.2) == ([(1, 1)], [])
    assert go([True, True, True], [0, 0, 0])[1] == [(0, 0), (1, 1), (2, 2)]
    assert a.confidence(np.array([0.0, 25.0]), rules).tolist() == [1.0, 0.5]


def test_headings():
    h = k.Heading()
    assert h.step(1.0, 0.0) == 1.0 and h.step(1.9, 0.0) == pytest.approx(1.0 + math.radians(30)) and h.step(1.5 + math.pi, 0.0) == pytest.approx(1.5)
    assert h.step(0.2, 9.0, motion=3.0) == pytest.approx(0.2 + math.pi) and h.step(0.2, 9.0) == pytest.approx(0.2)
    d = k.Heading(persist=3)
    d.step(0.0, 9.0, 0.0, True)
    assert [round(math.cos(d.step(math.pi, 9.0, math.pi, True, c))) for c in (0.9, 0.9, 0.1, 0.9, 0.9, 0.9)] == [1, 1, 1, 1, 1, -1]


def walks(seed, videos, frames):
    """Detections of animals that walk, now and then unseen, in random order; tags for some."""
    draw, rows = random.Random(seed), []
    for v in range(videos):
        at = [[60.0 * i, 20.0 * v] for i in range(3)]
        for f in range(frames):
            for i, p in enumerate(at):
                p[0] += draw.uniform(-2, 4)
                p[1] += draw.uniform(-3, 3)
                if draw.random() > 0.15:
                    rows.append((v, f, 100 * f + i, p[0], p[1], draw.uniform(0, 6), i if draw.random() < 0.3 else None))
    draw.shuffle(rows)
    return rows


SCHEMA = "VideoID long, FrameID long, DetectionID long, X double, Y double, Theta double, TagID long"


def key(rows):
    return sorted((r.VideoID, r.FrameID, r.TrajectoryID, round(r.X, 6), round(r.Y, 6), round(r.Theta, 6), r.State, -1 if r.DetectionID is None else r.DetectionID) for r in rows)


def test_replay_keeps_identities_both_ways(spark):
    rows = spark.createDataFrame(walks(1, 2, 60), SCHEMA)
    for reverse in (False, True):
        found = k.track_videos(rows, slots=3, reach=30.0, lost_after=8, reverse=reverse, grown=3).where("DetectionID is not null").collect()
        of = {}
        for r in found:
            of.setdefault((r.VideoID, r.TrajectoryID), set()).add(r.DetectionID % 100)
        assert all(len(v) == 1 for v in of.values()) and len(of) == 6
        assert len(found) == rows.where("X is not null").count()
    assert k.track_videos(rows.limit(0)).collect() == []


@pytest.mark.parametrize("files", [1, 4, 9])
def test_the_stream_equals_the_replay(spark, tmp_path, files):
    """At several sizes of batches, in no order inside them; the state of finished videos is gone."""
    zero, draw = datetime.datetime(2024, 1, 1), random.Random(files)
    rows = [(*r, zero + datetime.timedelta(seconds=r[1])) for r in walks(3, 3, 45)]
    rows.sort(key=lambda r: r[1] + draw.uniform(0, 4))
    step = -(-len(rows) // files)
    parts = [rows[i : i + step] for i in range(0, len(rows), step)] + [[(99, 0, 0, 0.0, 0.0, 0.0, None, zero + datetime.timedelta(hours=h))] for h in (1, 2, 3)]
    schema = f"{SCHEMA}, ts timestamp"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    how = {"slots": 3, "reach": 30.0, "lost_after": 4, "grown": 3}
    name = f"tracked{files}"
    query = st.track_stream(source, late="10 seconds", **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    want = k.track_videos(spark.createDataFrame([r[:7] for r in rows], SCHEMA), **how)
    assert key(spark.table(name).where("VideoID < 99").collect()) == key(want.collect())
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_tags_join_their_detections_as_streams(spark, tmp_path):
    zero = datetime.datetime(2024, 1, 1)
    data = [(v, f, 10 * f + i, float(i), 0.0, 0.0, zero + datetime.timedelta(seconds=f)) for v in range(2) for f in range(20) for i in range(2)]
    tags = [(v, f, d, d % 7, t) for v, f, d, _, _, _, t in data if d % 3 == 0]
    end = zero + datetime.timedelta(hours=1)
    a_schema, b_schema = "VideoID long, FrameID long, DetectionID long, X double, Y double, Theta double, ts timestamp", "VideoID long, FrameID long, DetectionID long, TagID long, ts timestamp"
    for part, schema, path in ((data, a_schema, "a"), ([(99, 0, 0, 0.0, 0.0, 0.0, end)], a_schema, "a"), (tags, b_schema, "b"), ([(98, 0, 0, 5, end)], b_schema, "b")):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / path))
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / path))
    query = st.with_tags(read("a", a_schema), read("b", b_schema)).writeStream.format("memory").queryName("tagged").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    found = {(r.VideoID, r.FrameID, r.DetectionID): r.TagID for r in spark.table("tagged").where(F.col("VideoID") < 99).collect()}
    assert found == {(v, f, d): d % 7 if d % 3 == 0 else -1 for v, f, d, *_ in data}
