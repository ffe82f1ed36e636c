"""Close pairs and nearest neighbours of vectors against numpy over all pairs."""

import numpy as np
import pytest

from trackmill.operators import curate, metric
from trackmill.operators import pairs as p


def table(spark, vectors, name="v", kind="float"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"id long, {name} array<{kind}>").repartition(4)


def clustered(n, dims, centres, spread, seed=0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims))
    return middle[draw.integers(0, centres, n)] + draw.normal(size=(n, dims)) * spread


def cosines(v):
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    return u @ u.T


@pytest.mark.parametrize(("least", "block"), [(0.95, 4096), (0.95, 50), (0.5, 64), (-0.2, 200)])
def test_cosine_pairs_are_all(spark, monkeypatch, least, block):
    monkeypatch.setattr(metric, "BLOCK", block)
    v = np.concatenate([clustered(700, 8, 20, 0.15).astype(np.float32), np.zeros((3, 8)), np.ones((5, 8))])
    c = cosines(v.astype(float))
    i, j = np.nonzero(np.triu(c >= least - 1e-9, 1))
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist())}
    found = curate.cosine_pairs(table(spark, v), "id", "v", least).collect()
    got = {(r.AID, r.BID) for r in found}
    assert len(got) == len(found) and got <= want and all(c[a, b] < least + 1e-9 for a, b in want - got)
    assert all(abs(c[r.AID, r.BID] - r.Similarity) < 1e-9 for r in found)


def test_few_are_compared_where_vectors_cluster(spark):
    """At 0.95 under a tenth of all pairs meet; where the distance is wide no row is copied far more often than blocks need."""
    v = clustered(4000, 64, 40, 0.05, 3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    points = table(spark, unit, kind="double").withColumnsRenamed({"id": "_id", "v": "_r"})
    met = metric.meetings(metric.placed(points, (2 - 2 * 0.95) ** 0.5)).collect()
    compared = sum(r.Homes * (r.Homes - 1) / 2 + r.Homes * r.Copies for r in met)
    assert compared < 0.1 * 4000 * 3999 / 2 and sum(r.Homes for r in met) == 4000
    wide = metric.meetings(metric.placed(points, 1.3)).collect()
    assert sum(r.Copies for r in wide) < 4 * 4000


def test_filter_keeps_the_first(spark):
    v = clustered(300, 6, 12, 0.2, 5)
    c, kept, want = cosines(v), [], {}
    for i in range(len(v)):
        by = [k for k in kept if c[i, k] >= 0.9]
        want[i] = by[0] if by else i
        if not by:
            kept.append(i)
    assert {r.id: r.KeptID for r in curate.cosine_filter(table(spark, v, kind="double"), "id", "v", 0.9).collect()} == want and 12 <= len(kept) < 300


def test_histograms(spark):
    h = np.abs(clustered(300, 5, 10, 0.1, 2))
    h[7] = 0
    q = np.sqrt(np.divide(h, h.sum(1, keepdims=True), out=np.zeros_like(h), where=h.sum(1, keepdims=True) > 0))
    d = np.sqrt(np.maximum(0, 1 - q @ q.T))
    found = curate.histogram_pairs(table(spark, h, "h", "double"), "id", "h", 0.1).collect()
    assert {(r.AID, r.BID) for r in found} == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(d <= 0.1, 1))))} and len(found) > 50


def test_edges(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    rows = spark.createDataFrame([*[(i, x) for i, x in enumerate(v)], (None, [1.0, 0.0]), (9, None)], "_id long, _r array<double>")
    assert {(r.AID, r.BID, r.Dot) for r in metric.close_pairs(rows, 0.1).collect()} == {(0, 1, 1.0)}
    assert metric.close_pairs(rows.limit(0), 0.1).collect() == [] and metric.close_pairs(rows.where("_id = 0"), 0.1).collect() == []
    names = spark.createDataFrame([("b", v[0]), ("a", v[1])], "_id string, _r array<double>")
    assert [(r.AID, r.BID) for r in metric.close_pairs(names, 0.1).collect()] == [("a", "b")]


@pytest.mark.parametrize("chunk", [64 << 20, 200])
def test_nearest_are_exact_with_ties_by_id(spark, monkeypatch, chunk):
    monkeypatch.setattr(metric, "QUERY_BYTES", chunk)
    v = np.concatenate([clustered(600, 4, 8, 0.3, 1), np.ones((20, 4)), np.round(clustered(200, 4, 5, 1.0, 2))])
    rows = table(spark, v, kind="double")
    ids = range(0, len(v), 17)
    found = {}
    for r in p.nearest_neighbours(rows.where("id % 17 = 0"), rows, 7, "id", "v").collect():
        found.setdefault(r.QueryID, {})[r.Rank] = (r.NeighbourID, r.Distance)
    assert set(found) == set(ids)
    for i in ids:
        gap = np.sqrt(((v - v[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(len(v)), gap)).tolist() if j != i][:7]
        assert [found[i][k + 1][0] for k in range(7)] == want and all(abs(found[i][k + 1][1] - gap[j]) < 1e-9 for k, j in enumerate(want))
    few = p.nearest_neighbours(rows.where("id = 3"), rows.where("id < 6"), 9, "id", "v").collect()
    assert sorted(r.NeighbourID for r in few) == [0, 1, 2, 4, 5] and p.nearest_neighbours(rows.limit(0), rows, 3, "id", "v").collect() == []
