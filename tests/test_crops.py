"""Crops around boxes and their corners in the crop against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.operators import datasets as ds


@pytest.mark.parametrize(("pad", "least", "square"), [(0.15, 64, True), (0.5, 10, False), (-1.0, 1, True)])
def test_crops(spark, pad, least, square):
    draw = np.random.default_rng(3)
    boxes = [(draw.uniform(-0.1, 1.1, 2) + draw.normal(size=(4, 2)) * 0.05).tolist() for _ in range(150)] + [[[3.0, 3.0]] * 4, [[0.5, 0.5]] * 4, []]
    rows = spark.createDataFrame([(i, [(x, y) for x, y in b]) for i, b in enumerate(boxes)], "id int, corners array<struct<x:double,y:double>>")
    rows = rows.unionByName(spark.createDataFrame([(900, None), (901, [(None, 0.5)])], rows.schema))
    w, h = F.lit(640), F.lit(480)
    got = {r.id: r for r in rows.withColumn("box", ds.crop_box(F.col("corners"), w, h, pad, least, square)).withColumn("out", ds.crop_corners(F.col("corners"), w, h, F.col("box"))).collect()}
    assert got[900].box is None and got[901].box is None and got[152].box is None and got[150].out is None
    for i, b in enumerate(boxes[:-1]):
        points = [(x * 640, y * 480) for x, y in b]
        sides = []
        for axis in (0, 1):
            low, high = min(p[axis] for p in points), max(p[axis] for p in points)
            size = max(1.0, high - low)
            sides.append((low + size / 2, max(float(least), size * (1 + 2 * max(0.0, pad)))))
        if square:
            sides = [(m, max(s for _, s in sides)) for m, _ in sides]
        (x1, x2), (y1, y2) = [(max(0, math.floor(m - s / 2)), min(top, math.ceil(m + s / 2))) for (m, s), top in zip(sides, (640, 480), strict=True)]
        if x2 <= x1 or y2 <= y1:
            assert got[i].box is None
            continue
        assert tuple(got[i].box) == (x1, y1, x2, y2)
        want = [(min(1, max(0, (x - x1) / (x2 - x1))), min(1, max(0, (y - y1) / (y2 - y1)))) for x, y in points]
        assert np.allclose([tuple(p) for p in got[i].out], want)
