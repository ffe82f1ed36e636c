"""Order statistics, weighted means and dense numbers against plain lists, also where one group or key holds nearly all rows."""

import math
import random

import pytest

from trackmill.operators import catalogue, metrics, priors, ranks
from trackmill.operators import sequences as seq


@pytest.fixture(scope="module")
def data():
    draw = random.Random(9)
    rows = [("hot" if draw.random() < 0.9 else draw.choice("abc"), draw.choice((draw.uniform(-5, 5), float(draw.randrange(4)), None))) for _ in range(3000)]
    return [*rows, (None, 1.0), (None, 3.0), ("void", None)]


def groups(data):
    out = {}
    for k, v in data:
        out.setdefault(k, []).extend([] if v is None else [v])
    return {k: sorted(v) for k, v in out.items()}


def test_places(spark, data):
    frame = spark.createDataFrame(data, "k string, v double")
    found = {r.k: (r.N, r.low, r.high, r.out) for r in ranks.at_ranks(frame, ["k"], "v", {"low": lambda n: n * 0, "high": ranks.share(0.95), "out": lambda n: n}).collect()}
    assert found == {k: (len(v), v[0], v[min(int(len(v) * 0.95), len(v) - 1)], None) for k, v in groups(data).items() if v}
    whole = sorted(v for _, v in data if v is not None)
    assert tuple(ranks.at_ranks(frame, [], "v", {"mid": ranks.share(0.5)}).first()) == (len(whole), whole[len(whole) // 2])
    assert ranks.at_ranks(frame.limit(0), ["k"], "v", {"x": ranks.share(0.5)}).collect() == []
    plan = ranks.medians(frame, [], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile(" not in plan and " median" not in plan


def test_medians_and_priors(spark, data):
    def median(v):
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    frame = spark.createDataFrame(data, "k string, v double")
    own = {k: v for k, v in groups(data).items() if v and k is not None}
    found = {r.k: (r.N, r.Median, r.MAD, r.Valid) for r in priors.length_prior(frame, ["k"], "v").collect()}
    want = {k: (len(v), median(v), median(sorted(abs(x - median(v)) for x in v)), len(v) >= 20) for k, v in own.items()}
    assert set(found) == set(want) and all(a == pytest.approx(b) for k in want for a, b in zip(found[k], want[k]))
    whole = sorted(v for _, v in data if v is not None)
    assert tuple(priors.length_prior(frame, [], "v").first()) == pytest.approx((len(whole), median(whole), median(sorted(abs(x - median(whole)) for x in whole)), True))
    told = {r.k: (r.N, r.P95) for r in catalogue.nearest_rank(frame, ["k"], "v", {"P95": 0.95}).collect()}
    assert told == {k: (len(v), v[min(int(len(v) * 0.95), len(v) - 1)] if v else None) for k, v in groups(data).items()}


def test_exponential_mean(spark, data):
    rows = [(k, i, v) for i, (k, v) in enumerate(data)]
    found = {r.k: r.Ewma for r in metrics.exponential_mean(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], ["i"], 0.2).collect()}
    want = {}
    for k, _, v in rows:
        if v is not None:
            want[k] = v if k not in want else want[k] + 0.2 * (v - want[k])
    assert set(found) == set(want) and all(math.isclose(found[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_dense_numbers_by_whole_keys(spark):
    keys = [(k, name, i) for k in (0, 1, None) for name in ("a", "b", None) for i in range(700)]
    random.Random(2).shuffle(keys)
    frame = spark.createDataFrame(keys, "k int, s string, i long")
    order = sorted(keys, key=lambda x: tuple((v is not None, v) for v in x))
    found = {(r.k, r.s, r.i): r.n for r in seq.dense_ids(frame, ["k", "s", "i"], "n").collect()}
    assert found == {x: i for i, x in enumerate(order)}
    placed = seq.dense_ids(frame, ["k", "s", "i"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" in placed and seq.dense_ids(frame.limit(0), ["k"], "n").collect() == []


def test_temperature_equals_a_plain_search(spark):
    import numpy as np

    draw = np.random.default_rng(4)

    def loss(z, y, t):
        a = z / t
        top = a.max(1, keepdims=True)
        return float((np.log(np.exp(a - top).sum(1)) + top[:, 0] - a[np.arange(len(y)), y]).sum())

    def search(z, y):
        lo, hi = math.log(0.1), math.log(10)
        for _ in range(200):
            a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if loss(z, y, math.exp(a)) < loss(z, y, math.exp(b)) else (a, hi)
        return math.exp((lo + hi) / 2)

    for scale in (0.5, 1.0, 4.0, 60.0):
        z = draw.normal(size=(400, 5)) * scale
        y = np.array([draw.choice(5, p=np.exp(a) / np.exp(a).sum()) for a in z / scale * 1.5])
        frame = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(z, y)] + [(None, 1), ([1.0, None], 0), ([1.0], 7), ([2.0], None)], "z array<double>, y int")
        assert metrics.fit_temperature(frame, "z", "y") == pytest.approx(search(z, y), rel=1e-5)
    sure = spark.createDataFrame([([9.0, 1.0], 0)], "z array<double>, y int")
    assert metrics.fit_temperature(sure, "z", "y") == 0.1 and metrics.fit_temperature(spark.createDataFrame([([9.0, 1.0], 1)], "z array<double>, y int"), "z", "y") == 10.0
    assert metrics.fit_temperature(sure.limit(0), "z", "y") == 1.0 and metrics.fit_temperature(spark.createDataFrame([([3.0, 3.0], 1)], "z array<double>, y int"), "z", "y") == 1.0
