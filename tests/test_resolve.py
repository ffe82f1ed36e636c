import math

import pytest

from trackmill.operators import graphs
from trackmill.operators import resolve as r
from trackmill.operators import sequences as seq

SCHEMA = "TrajectoryID long, FrameID long, X double, Y double, Theta double, State string, DetectionID long, DetectionConfidence double"


def frame(spark, rows, first_detection=0):
    return spark.createDataFrame([(t, f, float(x), float(y), float(th), s, first_detection + 1000 * f + t, 0.9) for t, f, x, y, th, s in rows], SCHEMA)


def test_two_disjoint_tracks_and_one_backward(spark):
    fwd = [(0, f, 10 + f, 20, 0, "active") for f in range(6)] + [(1, f, 200 + f, 60, 0, "active") for f in range(20, 26)]
    bwd = [(0, f, 500 + f, 300, 0, "active") for f in range(6)]
    got = r.resolve(frame(spark, fwd), frame(spark, bwd, 500), 5, 2, 2).groupBy("TrajectoryID").count().collect()
    assert sorted(map(tuple, got)) == [(0, 6), (1, 6), (2, 6)]


def test_fragments_are_stitched(spark):
    fwd = [(0, 300 + i, 50 + 2 * i, 100 + 2 * i, 0, "active") for i in range(5)] + [(1, 307 + i, 60 + 2 * i, 110 + 2 * i, 0, "active") for i in range(6)]
    bwd = [(2, 340 + i, 350 + i, 390 + i, 0, "active") for i in range(7)]
    got = r.resolve(frame(spark, fwd), frame(spark, bwd), 6, 2, 2).groupBy("TrajectoryID").count().collect()
    assert sorted(n for _, n in map(tuple, got)) == [7, 11]


def test_agreeing_tracks_merge_to_their_mean(spark):
    fwd = [(20 + t, f, 100 * t + f, 50, 0.0, "active") for t in range(2) for f in range(700, 721)]
    bwd = [(30 + t, f, 100 * t + f + 1, 50, math.pi, "active") for t in range(2) for f in range(700, 721)]
    got = r.resolve(frame(spark, fwd), frame(spark, bwd), 12, 2, 2).collect()
    assert len(got) == 42 and {x.TrajectoryID for x in got} == {0, 1}
    assert all(min(x.X - x.FrameID - 0.5, 1) in (0, 1) for x in got)
    assert all(abs(math.sin(x.Theta)) < 1e-6 for x in got)


def test_crossing_tracks_stay_two(spark):
    fwd = [(t, f, f, f if t == 0 else 99 - f, 0.0, "active") for t in range(2) for f in range(100)]
    bwd = [(t, f, x + 0.3, y, th, s) for t, f, x, y, th, s in fwd]
    got = r.resolve(frame(spark, fwd), frame(spark, bwd), 5, 5, 5).collect()
    assert {x.TrajectoryID for x in got} == {0, 1} and len(got) == 200
    assert len({(x.TrajectoryID, x.FrameID) for x in got}) == len(got)
    assert all(0 <= x.FrameID < 100 for x in got)


def test_interpolation_of_short_gaps(spark):
    rows = [(0, 0, 0, 0, 0, "active"), (0, 2, 2, 2, 0.2, "active"), (0, 3, 3, 3.2, 0.3, "active"), (0, 6, 6, 6.1, 0.6, "active"), (1, 10, 12, 12, 1.0, "active")]
    got = {(x.TrajectoryID, x.FrameID): x for x in r.interpolate(frame(spark, rows), 2).collect()}
    assert len(got) == 8
    assert got[0, 1].X == pytest.approx(1) and got[0, 1].Theta == pytest.approx(0.1) and got[0, 1].State == "occluded"
    assert got[0, 4].Y == pytest.approx(3.2 + 2.9 / 3) and got[0, 5].Y == pytest.approx(3.2 + 2 * 2.9 / 3)
    assert got[0, 4].Theta == pytest.approx(math.atan2((2 * math.sin(0.3) + math.sin(0.6)) / 3, (2 * math.cos(0.3) + math.cos(0.6)) / 3))
    assert got[0, 1].DetectionConfidence is None and got[1, 10].State == "active"


def test_cleaning_cuts_jumps_and_drops_short_pieces(spark):
    rows = [(5, f, f if f < 12 else f + 500, 0, 0, "active") for f in range(24)] + [(6, f, 0, 0, 0, "active") for f in range(4)]
    got = r.clean(frame(spark, rows), 10, 100.0, 3).groupBy("TrajectoryID").count().collect()
    assert sorted(map(tuple, got)) == [(0, 12), (1, 12)]


def test_removal_runs_until_every_pair_is_settled(spark):
    rows = frame(spark, [(t, f, 0, 0, 0, "active") for t in range(4) for f in range(2 * t, 2 * t + 10)])
    assert r.drop_redundant(rows, 1).count() == 16


def test_one_pass_alone_keeps_its_ids(spark):
    rows = [(10, f, f, 0, 0, "active") for f in range(500, 511)]
    for fwd, bwd in ((rows, []), ([], rows)):
        got = r.resolve(frame(spark, fwd), frame(spark, bwd), 10, 2, 2).collect()
        assert len(got) == 11 and {x.TrajectoryID for x in got} == {10}


def test_long_chains_are_stitched_whole(spark):
    rows = frame(spark, [(60 - t, 10 * t + f, 10 * t + f, 0, 0, "active") for t in range(60) for f in range(8)])
    got = r.stitch(rows, 3, 30.0).groupBy("TrajectoryID").count().collect()
    assert list(map(tuple, got)) == [(60, 480)]


def test_tracks_that_overlap_in_their_middles_merge(spark):
    rows = [(0, f, f, 0, 0, "active") for f in range(20)] + [(1, f, f + 1, 0, 0, "active") for f in range(12, 32)]
    got = r.merge_agreeing(frame(spark, rows), 3, 3, 3).orderBy("FrameID").collect()
    assert [x.FrameID for x in got] == list(range(32)) and len({x.TrajectoryID for x in got}) == 1
    assert all(x.X == pytest.approx(x.FrameID + (0.5 if 12 <= x.FrameID < 20 else x.FrameID >= 20)) for x in got)


def test_overlap_without_agreement_stays_apart(spark):
    rows = [(0, f, f, 0, 0, "active") for f in range(20)] + [(1, f, f, 500, 0, "active") for f in range(12, 32)]
    assert r.merge_agreeing(frame(spark, rows), 3, 3, 3).groupBy("TrajectoryID").count().count() == 2


def brute_greedy(edges, one_set=False):
    met, out = set(), []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        ends = {a, b} if one_set else {("l", a), ("r", b)}
        if met.isdisjoint(ends):
            met |= ends
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("one_set", [False, True])
def test_greedy_matches_equal_brute_force(spark, one_set):
    import random

    from trackmill.operators import pairs

    random.seed(5)
    path = [(i, i + (i % 2 == 0), i) for i in range(300)] if not one_set else [(i, i + 1, i) for i in range(300)]
    some = [(1000 + random.randrange(40), 2000 + random.randrange(40), random.randrange(9)) for _ in range(300)]
    edges = sorted({(a, b): s for a, b, s in path + some}.items())
    edges = [(a, b, s) for (a, b), s in edges]
    got = pairs.greedy_matches(spark.createDataFrame(edges, "a long, b long, s long"), "a", "b", "s", one_set, rounds=3).collect()
    assert sorted((x.a, x.b) for x in got) == brute_greedy(edges, one_set)


def test_keep_first_equals_brute_force_on_long_chains(spark):
    from trackmill.operators import curate

    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (300, 303), (302, 303)]
    ids = sorted({i for e in edges for i in e} | {999})
    kept = {}
    for i in ids:
        firsts = [a for a, b in edges if b == i and kept[a] == a]
        kept[i] = min(firsts) if firsts else i
    got = curate.keep_first(spark.createDataFrame([(i,) for i in ids], "id long"), "id", spark.createDataFrame(edges, "AID long, BID long"), rounds=3).collect()
    assert {x.id: x.KeptID for x in got} == kept


def test_components_and_chains(spark):
    from trackmill.operators import graphs

    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100}
    heads = {x.node: (x.head, x.place) for x in graphs.chain_heads(spark.createDataFrame([(i, i + 1) for i in range(30)], "source long, target long")).collect()}
    assert heads == {i: (0, i) for i in range(1, 31)}


def test_dense_ids_follow_the_order(spark):
    keys = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "a long, b long")
    got = [x.n for x in seq.dense_ids(keys, ["a", "b"], "n", 8).orderBy("a", "b").collect()]
    assert got == list(range(101))


def test_links_in_a_circle_raise(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "source long, target long")
    for pairs in ([(1, 2), (2, 1)], [(5, 5)], [(1, 2), (2, 3), (3, 1), (7, 8)]):
        with pytest.raises(ValueError, match="circle"):
            graphs.chain_heads(frame(pairs))
    assert graphs.chain_heads(frame([])).collect() == []
    assert {(r.node, r.head, r.place) for r in graphs.chain_heads(frame([(i, i + 1) for i in range(17)] + [(50, 51)])).collect()} == {(i + 1, 0, i + 1) for i in range(17)} | {(51, 50, 1)}
