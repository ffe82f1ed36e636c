"""Pairs, splits and counts over rows, against plain versions of their SQL."""

import math
import random
import statistics

import numpy as np
import pytest

from trackmill.operators import blocks, catalogue, curate, events, frames, pairs, resolve, review
from trackmill.operators import spans as ends


def test_ratio_split_multiplies_in_decimals(spark):
    rows = spark.range(90).selectExpr("id as doc_id", "'a' as lang")
    found = catalogue.ratio_split(rows, "lang", "doc_id", 0.7, 0.2)
    assert {r.Split: r["count"] for r in found.groupBy("Split").count().collect()} == {"train": 63, "val": 18, "test": 9}


def test_hamming_pairs_of_copies_are_all(spark):
    random.seed(2)
    marks = [random.choice([5, 7, 9, 64, 1 << 12]) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(marks)), "vec_id long, s long")
    want = {(a, b, (marks[a] ^ marks[b]).bit_count()) for a in range(40) for b in range(a + 1, 40) if (marks[a] ^ marks[b]).bit_count() <= 1}
    got = [tuple(r) for r in curate.hamming_pairs(rows, "vec_id", "s", 1, 24).collect()]
    assert len(got) == len(want) and set(got) == want


#: Two steps whose roots of summed squares are equal and whose hypot, in Java, is not: the first frame is the closest one.
STEPS = (3.55, 2.0), (3.95, 1.0)


def test_equal_distances_go_to_the_first_frame(spark):
    assert math.sqrt(3.55 * 3.55 + 4.0) == math.sqrt(3.95 * 3.95 + 1.0)
    far = [(50.0, 0.0)] * 10
    data = [(t, f, f * 2 + t, float(x), float(y)) for f, (dx, dy) in enumerate([*far, STEPS[1], STEPS[0], *far]) for t, x, y in ((0, 0, 0), (1, dx, dy))]
    rows = spark.createDataFrame([*data, (1, 22, 99, 50.0, 0.0)], "TrajectoryID long, FrameID long, DetectionID long, X double, Y double")
    one = rows.where("TrajectoryID = 0").select("TrajectoryID").distinct()
    assert [r.ClosestFrame for r in review.local_proximity(rows, one, 9.7, 3).collect()] == [10]
    assert [r.ClosestFrame for r in pairs.proximity(rows, 9.7, 3).collect()] == [10]
    assert [r.FrameID for r in review.swap_hypotheses(rows, pairs.track_spans(rows), 12.7).collect()] == [10]


def tracks(seed, n, frames):
    """Rows (track, frame, detection, x, y) with gaps, few places, so that distances are often equal, and tracks that never meet."""
    random.seed(seed)
    out = []
    for t in range(n):
        begin = random.randrange(3 * frames)
        out += [(t, f, t * 1000 + f, random.randrange(120) / 10, float(random.randrange(9))) for f in range(begin, begin + frames) if random.random() < 0.7]
    return out


def met(rows, others, twice=False):
    """{(a, b): [(frame, distance, relative x)]} of the common frames of all pairs."""
    out = {}
    for a, f, _, x, y in rows:
        for b, g, _, u, v in others:
            if f == g and (twice or a < b):
                out.setdefault((a, b), []).append((f, math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), x - u))
    return {k: sorted(v) for k, v in out.items()}


ROWS = "TrajectoryID long, FrameID long, DetectionID long, X double, Y double"


def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 150)
    monkeypatch.setattr(blocks, "TILE", 4)


def makes_no_pairs_of_rows(found):
    return "Join" not in found._jdf.queryExecution().toString()


def test_merge_candidates_by_blocks(spark, monkeypatch):
    small_blocks(monkeypatch)
    a, b = tracks(4, 30, 14), tracks(5, 25, 14)
    want = {k: (len(v), sum(d <= 4.0 for _, d, _ in v)) for k, v in met(a, b, True).items()}
    found = pairs.merge_candidates(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), 4.0, 2)
    assert {(r.AID, r.BID): (r.Common, r.Agreeing) for r in found.collect()} == {k: v for k, v in want.items() if v[1] >= 2}
    assert makes_no_pairs_of_rows(found)


def test_agreements_hold_the_rows_of_both(spark):
    a, b = tracks(6, 9, 12), tracks(7, 9, 12)
    sizes = [{t: sum(r[0] == t for r in side) for t in range(9)} for side in (a, b)]
    found = pairs.agreements(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), 6.0, 1).collect()
    assert found and all((r.ARows, r.BRows) == (sizes[0][r.AID], sizes[1][r.BID]) for r in found)


def test_proximity_by_blocks(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = tracks(8, 40, 14)
    least = {k: (len(v), *min((d, f) for f, d, _ in v)) for k, v in met(rows, rows).items()}
    want = {k: v for k, v in least.items() if v[0] >= 3 and v[1] < 2.0}
    table = spark.createDataFrame(rows, ROWS)
    found = pairs.proximity(table, 2.0, 3)
    assert {(r.AID, r.BID): (r.Common, r.MinDistance, r.ClosestFrame) for r in found.collect()} == want
    assert makes_no_pairs_of_rows(found)
    some = {k: v for k, v in want.items() if k[0] % 3 == 0 or k[1] % 3 == 0}
    near = review.local_proximity(table, table.where("TrajectoryID % 3 = 0").select("TrajectoryID"), 2.0, 3).collect()
    assert len(near) == len(some) and {(r.AID, r.BID): (r.Common, r.MinDistance, r.ClosestFrame) for r in near} == some


def test_crossings_by_blocks(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = tracks(9, 40, 14)
    want = {}
    for k, v in met(rows, rows).items():
        d, f = min((d, f) for f, d, _ in v)
        if len(v) >= 3 and d < 2.0:
            at = [x[0] for x in v].index(f)
            sides = [[x[2] for x in part] for part in (v[max(0, at - 4) : at], v[at + 1 : at + 5])]
            want[k] = (f, d, all(sides) and statistics.median(sides[0]) * statistics.median(sides[1]) < 0)
    found = events.crossings(spark.createDataFrame(rows, ROWS), 2.0, 4, 3)
    assert {(r.AID, r.BID): (r.ClosestFrame, r.MinDistance, r.Crossed) for r in found.collect()} == want
    assert makes_no_pairs_of_rows(found) and {v[2] for v in want.values()} == {True, False}


def greedy(edges):
    """Of (a, b, cost, key of order) the greedy matches: lowest order first."""
    found, seen = [], set()
    for a, b, cost in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if not seen & {("l", a), ("r", b)}:
            seen |= {("l", a), ("r", b)}
            found.append((a, b, cost))
    return found


def test_tracks_match_by_bands_as_over_all_candidates(spark, monkeypatch):
    a, b = tracks(10, 30, 14), tracks(11, 25, 14)
    b += [(100 + t, f, d, x + 0.5, y) for t, f, d, x, y in a if t % 3 == 0]
    agree = {k: sum(d <= 4.0 for _, d, _ in v) for k, v in met(a, b, True).items()}
    want = {(x, y, -c) for x, y, c in greedy([(x, y, -n) for (x, y), n in agree.items() if n >= 2])}
    made = []
    monkeypatch.setattr(pairs, "greedy_matches", lambda found, *more, real=pairs.greedy_matches: made.append(found.count()) or real(found, *more))
    got = pairs.match_tracks(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), 4.0, 2).collect()
    assert {(r.AID, r.BID, r.Agreeing) for r in got} == want and len(made) > 1
    assert sum(made) < sum(n >= 2 for n in agree.values())


def test_assignment_by_bands_equals_that_of_all_pairs(spark, monkeypatch):
    random.seed(12)
    side = [[(f, n, random.randrange(80) / 10, random.randrange(80) / 10) for f in range(3) for n in range(120)] for _ in "ab"]
    want, every = set(), 0
    for f in range(3):
        edges = [(a, b, math.sqrt((x - u) ** 2 + (y - v) ** 2)) for g, a, x, y in side[0] for h, b, u, v in side[1] if g == h == f]
        edges = [e for e in edges if e[2] < 5.0]
        every += len(edges)
        want |= {(f, *e) for e in greedy(edges)}
    made = []
    places = [[np.array([r[2:] for r in rows if r[0] == 0]) for rows in side], (np.arange(120), np.arange(120))]
    monkeypatch.setattr(frames, "greedy", lambda i, *more, real=frames.greedy: made.append(len(i)) or real(i, *more))
    list(frames.assigned(*places[0], 5.0, places[1]))
    assert len(made) > 1 and sum(made) * 12 < every
    a, b = (spark.createDataFrame(rows, f"FrameID long, {p}ID long, {p}X double, {p}Y double") for rows, p in zip(side, "AB", strict=True))
    got = pairs.assign_nearest(a, b, 5.0).collect()
    assert {(r.FrameID, r.TrackID, r.DetectionID) for r in got} == {w[:3] for w in want}


SPANS = "TrajectoryID long, BirthFrame long, BirthX double, BirthY double, DeathFrame long, DeathX double, DeathY double, VX double, VY double, Rows long"


def some_spans(n):
    random.seed(13)
    place = lambda: float(random.randrange(-20, 20))
    return [(i, b, place(), place(), b + random.randrange(12), place(), place(), random.choice([0.0, 0.5, -1.0]), random.choice([0.0, 1.0]), 9) for i in range(n) for b in [random.randrange(-30, 60)]]


def of_ends(spans, low, high, far):
    """(source, target, gap, distance, predicted) over every pair."""
    out = []
    for s, _, _, _, df, dx, dy, vx, vy, _ in spans:
        for t, bf, bx, by, *_ in spans:
            gap, d = bf - df, math.sqrt((bx - dx) ** 2 + (by - dy) ** 2)
            if s != t and low <= gap <= high and d <= far:
                out.append((s, t, gap, d, math.sqrt((bx - dx - vx * gap) ** 2 + (by - dy - vy * gap) ** 2)))
    return out


def test_pairs_of_ends_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(ends, "SOURCES", 5)
    monkeypatch.setattr(ends, "PAIRS", 40)
    rows = some_spans(120)
    spans = spark.createDataFrame(rows, SPANS)
    last = max(r[4] for r in rows)
    want = [x for x in of_ends([r for r in rows], -5, 20, 15.0) if rows[x[0]][4] < last]
    found = pairs.merge_hypotheses(spans, None, 5, 20, 15.0)
    got = {(r.SourceID, r.TargetID): r for r in found.collect()}
    assert {(s, t, g, d, p) for s, t, g, d, p in want} == {(r.SourceID, r.TargetID, r.Gap, r.Distance, r.Predicted) for r in got.values()}
    for s in {x[0] for x in want}:
        order = sorted((p, t) for a, t, _, _, p in want if a == s)
        assert [got[s, t].Rank for _, t in order] == list(range(1, len(order) + 1))
    near = {}
    for s, t, g, d, _ in of_ends(rows, 1, 6, 25.0):
        near[s] = min(near.get(s, (math.inf,)), (d, t, g))
    stitched = pairs.stitch_links(spans, 6, 25.0)
    assert {(r.SourceID, r.Distance, r.TargetID, r.Gap) for r in stitched.collect()} == {(s, *v) for s, v in near.items()}
    linked = {}
    for s, t, g, d, _ in of_ends(rows, -8, 12, 14.0):
        if d < 14.0 and (s < t or (t, s) not in linked):
            linked[min(s, t), max(s, t)] = (g, d) if s < t else linked.get((t, s), (g, d))
    links = events.endpoint_links(spans, -8, 12, 14.0)
    both = links.collect()
    assert len(both) == len(linked) and {(r.AID, r.BID): (r.Gap, r.Distance) for r in both} == linked
    assert all("Window" not in f._jdf.queryExecution().toString() for f in (found, stitched, links))


def test_relinks_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(ends, "SOURCES", 5)
    monkeypatch.setattr(ends, "PAIRS", 40)
    rows = some_spans(120)
    want = set()
    for s, t, g, d, p in of_ends(rows, 2, 31, math.inf):
        (vx, vy), (wx, wy) = rows[s][7:9], rows[t][7:9]
        turn = abs((math.atan2(vy, vx) - math.atan2(wy, wx) + math.pi) % (2 * math.pi) - math.pi) if math.hypot(vx, vy) > 0 and math.hypot(wx, wy) > 0 else 0.0
        if d <= 100.0 * g and p <= 12.0 and turn <= math.pi / 3:
            want.add((s, t, g - 1, round(p / 12.0 + 0.25 * (g - 1) / 30 + 0.35 * turn / (math.pi / 3), 9)))
    found = events.relink_candidates(spark.createDataFrame(rows, SPANS), reach=12.0)
    assert {(r.SourceID, r.TargetID, r.Gap, round(r.Score, 9)) for r in found.collect()} == want
    assert "_bucket" not in found._jdf.queryExecution().toString()


def test_hypotheses_are_dealt_to_parts(spark):
    rows = some_spans(120)
    spans = spark.createDataFrame(rows, SPANS)
    found = pairs.hypotheses(spans, spans, 5, 20, 15.0)
    assert {tuple(r) for r in found.collect()} == {(s, t, p) for s, t, _, _, p in of_ends(rows, -5, 20, 15.0)}
    assert "_part" in found._jdf.queryExecution().toString()


def test_crowding_by_blocks(spark, monkeypatch):
    rows = tracks(14, 60, 14)
    near = {}
    for v in met(rows, rows).values():
        for f, d, _ in v:
            near.setdefault(f, []).append(max(0.0, 1 - d / 5.0))
    monkeypatch.setattr(pairs, "CROWD", 4)
    found = pairs.crowding(spark.createDataFrame(rows, ROWS), 5.0)
    assert {r.FrameID: round(r.Crowding, 9) for r in found.collect()} == {f: round(sum(v) / len(v), 9) for f, v in near.items()}
    assert "_gx" not in found._jdf.queryExecution().toString()


def test_closeness_over_many_places():
    random.seed(15)
    a, b = (np.array([(random.random() * 40, random.random() * 40) for _ in range(n)]) for n in (2300, 1500))
    far = lambda one, two: np.maximum(0, 1 - np.sqrt(((one[:, None] - two[None, :]) ** 2).sum(axis=2)) / 7.0)
    assert frames.closeness(a, None, 7.0) == pytest.approx(np.triu(far(a, a), 1).sum())
    assert frames.closeness(a, b, 7.0) == pytest.approx(far(a, b).sum())


def test_absorbers_stop_at_the_first(spark, monkeypatch):
    rows = tracks(16, 90, 14)
    places = {}
    for t, f, _, x, y in rows:
        places.setdefault((t, f), (x, y))
    runs = [(t, f, x, y) for t, f, _, x, y in rows if (t + f) % 5 == 0]
    want = {}
    for t, f, x, y in runs:
        for other in range(90):
            seen = [places[other, g] for g in range(f - 2, f + 3) if (other, g) in places]
            if other != t and seen and math.hypot(x - sum(p[0] for p in seen) / len(seen), y - sum(p[1] for p in seen) / len(seen)) < 3.03:
                want[t, f] = other
                break
    monkeypatch.setattr(frames, "PAIRS", 7)
    found = events.absorbers(spark.createDataFrame(runs, "TrajectoryID long, StartFrame long, X double, Y double"), spark.createDataFrame(rows, ROWS), 2, 3.03)
    assert {(r.TrajectoryID, r.StartFrame): r.AbsorberID for r in found.collect()} == want
    assert "_id" not in found._jdf.queryExecution().analyzed().toString()


def test_lane_overlaps_are_counted(spark):
    """Ids that come twice, lanes that end before they begin and lanes asked for that are elsewhere included."""
    random.seed(17)
    lanes = [(random.randrange(80), random.randrange(3), f, f + random.randrange(-3, 9)) for _ in range(120) for f in [random.randrange(60)]]
    asked = lanes[::3] + [(1000, 1, 5, 9), (1001, 7, 0, 3), (lanes[0][0], lanes[0][1], 2, 4), (1002, None, 1, 2)]
    want = {}
    for g, t, f0, f1 in asked:
        want.setdefault(g, set()).update(h for h, u, b0, b1 in lanes if t == u and f0 <= b1 and f1 >= b0 and g != h)
    schema = "FragID long, TrackID long, F0 long, F1 long"
    found = review.lane_overlaps(spark.createDataFrame(lanes, schema), spark.createDataFrame(asked, schema))
    got = found.collect()
    assert {r.FragID: r.Overlaps for r in got} == {g: len(v) for g, v in want.items()} and len(got) == len(asked)
    crowd = spark.range(3000).selectExpr("id as FragID", "0L as TrackID", "id % 7 as F0", "id % 7 + 3 as F1")
    most = review.lane_overlaps(crowd, crowd).agg({"Overlaps": "max"}).first()[0]
    assert most == sum(any(a <= f + 3 and a + 3 >= f for a in (3,)) for f in (i % 7 for i in range(3000))) - 1


def test_shuffles_of_one_long_component(spark):
    """Many events of few tracks: each is looked at a few times, and links are a chain a track."""
    random.seed(18)
    rows = [(i, f, f + random.randrange(5), random.sample(range(6), 2)) for i in range(3000) for f in [random.randrange(900)]]
    found = review.multi_shuffles(spark.createDataFrame(rows, "EventID long, F0 long, F1 long, Tracks array<long>"), 3)
    free, want = sorted(rows, key=lambda r: (r[1], r[0])), []
    while free:
        seed, f0, f1, own = free[0]
        held = [r for r in free if set(own) & set(r[3]) and r[1] <= f1 + 3 and r[2] >= f0 - 3]
        free = [r for r in free if r not in held]
        every = sorted({t for r in held for t in r[3]})
        if len(held) > 1 and len(every) > 2:
            want.append((seed, min(r[1] for r in held), max(r[2] for r in held), every, len(held)))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_agreeing_pairs_by_blocks(spark, monkeypatch):
    """Frames of one detection agree at any distance; two of them stand for half the frames."""
    small_blocks(monkeypatch)
    rows = tracks(19, 40, 14)
    rows = [(t, f, f if t % 4 == 0 and f % 3 == 0 else d, x, y) for t, f, d, x, y in rows]
    named = {(t, f): d for t, f, d, _, _ in rows}
    want = {}
    for (a, b), v in met(rows, rows).items():
        same = sum(named[a, f] == named[b, f] for f, _, _ in v)
        agree = sum(d <= 6.0 or named[a, f] == named[b, f] for f, d, _ in v)
        if len(v) >= 4 and (agree >= 2 if same >= 2 else agree >= 4 and agree >= len(v) / 2):
            want[a, b] = (len(v), agree, same)
    calls = []
    monkeypatch.setattr(blocks, "compare", lambda *more, real=blocks.compare: calls.append(1) or real(*more))
    found = resolve.agreeing_pairs(spark.createDataFrame(rows, ROWS), 6.0, 4).collect()
    assert len(found) == len(want) and {(r.AID, r.BID): (r.Common, r.Agreeing, r.SameID) for r in found} == want
    assert calls and {v[2] > 1 for v in want.values()} == {True, False}
