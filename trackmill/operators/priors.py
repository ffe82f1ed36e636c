"""Pose priors and robust pose distances, crop geometry, and the costs and scores of tracking runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.operators import ranks
from trackmill.operators.sequences import FRAME


def summary(confidences: Column, least: float) -> Column:
    """Mean and count of valid confidences, and the valid fraction of all keypoints."""
    valid = F.filter(confidences, lambda c: c >= least)
    total = F.aggregate(valid, F.lit(0.0), lambda a, c: a + c)
    return F.struct(F.when(F.size(valid) > 0, total / F.size(valid)).otherwise(0.0).alias("Mean"), F.size(valid).alias("NumValid"), F.when(F.size(confidences) > 0, F.size(valid) / F.size(confidences)).otherwise(0.0).alias("Fraction"))


def length_prior(rows: DataFrame, keys: list[str], value: str, least: int = 20) -> DataFrame:
    """(keys, N, Median, MAD, Valid): the median of a length and of the deviations from it."""
    known = rows.where(F.col(value).isNotNull())
    middle = ranks.medians(known, keys, value)
    both = known.join(middle, keys) if keys else known.crossJoin(F.broadcast(middle))  # one row without keys
    far = ranks.medians(both.select(*keys, F.abs(F.col(value) - F.col("Median")).alias("_far")), keys, "_far").withColumnRenamed("Median", "MAD").drop("N")
    found = middle.join(far, keys) if keys else middle.crossJoin(F.broadcast(far))
    return found.select(*keys, "N", "Median", "MAD", (F.col("N") >= least).alias("Valid"))


def edge_lengths(rows: DataFrame, key: str, points: str, edges: list[tuple[int, int]], least: float) -> DataFrame:
    """(key, Edge, Length) of skeleton edges both ends of which are confident."""
    ends = F.array(*[F.struct(F.lit(k).alias("Edge"), F.col(points)[i].alias("p"), F.col(points)[j].alias("q")) for k, (i, j) in enumerate(edges)])
    found = rows.select(key, F.explode(ends).alias("e")).where((F.col("e.p.conf") >= least) & (F.col("e.q.conf") >= least))
    return found.select(key, "e.Edge", F.hypot(F.col("e.p.x") - F.col("e.q.x"), F.col("e.p.y") - F.col("e.q.y")).alias("Length"))


def keypoint_medians(rows: DataFrame, keys: list[str], points: str, least: float) -> DataFrame:
    """(keys, Keypoint, X, Y, Weight): medians of the confident places of each keypoint, and their mean confidence."""
    flat = rows.select(*keys, F.posexplode(points).alias("Keypoint", "p")).where(F.col("p.conf") >= least)
    return flat.groupBy(*keys, "Keypoint").agg(F.median("p.x").alias("X"), F.median("p.y").alias("Y"), F.avg("p.conf").alias("Weight"))


def robust_distance(distances: Column, least: int = 3) -> Column:
    """Mean distance of shared keypoints without outliers: beyond the median and 2.5 deviations, then the top fifth of five or more.

    Null if fewer than ``least`` are shared.
    """

    def middle(sorted_values: Column) -> Column:
        n = F.size(sorted_values)
        return (F.element_at(sorted_values, F.floor((n - 1) / 2).cast("int") + 1) + F.element_at(sorted_values, F.floor(n / 2).cast("int") + 1)) / 2

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def inner(d: Column) -> Column:
        return let(middle(d), lambda m: let(middle(F.sort_array(F.transform(d, lambda x: F.abs(x - m)))), lambda mad: F.when(mad > 0, F.filter(d, lambda x: x <= m + 2.5 * mad)).otherwise(d)))

    def trimmed(d: Column) -> Column:
        keep = F.when(F.size(d) >= 5, F.size(d) - F.floor(F.size(d) / 5).cast("int")).otherwise(F.size(d))
        return let(F.slice(d, F.lit(1), keep), lambda k: F.aggregate(k, F.lit(0.0), lambda a, x: a + x) / F.size(k))

    known = F.sort_array(F.filter(distances, lambda x: x.isNotNull()))
    return F.when(F.size(known) >= least, let(let(known, inner), trimmed))


def is_heading_reliable(confidences: Column, least: float, share: float = 0.6, points: int = 3) -> Column:
    """Whether enough keypoints are seen to take a heading from them."""
    valid = F.size(F.filter(confidences, lambda c: c >= least))
    return (valid >= points) & (valid >= share * F.size(confidences))


def dimensions(area: Column, aspect: Column) -> tuple[Column, Column]:
    """Major and minor axis of an ellipse of an area and an aspect ratio."""
    major = 2 * F.sqrt(area * aspect / F.lit(3.141592653589793))
    return major, major / aspect


def crop_quality(minor: Column, body: float) -> Column:
    """How much of a body a crop can show: its minor side against three quarters of the body size, in [0, 1]."""
    return F.least(F.greatest(minor / (0.75 * body), F.lit(0.0)), F.lit(1.0))


def crop_size(major: Column, aspect: float, padding: float) -> tuple[Column, Column]:
    """Width and height of a canonical crop: the major side with its margin, and by aspect the other, up to even numbers."""
    even = lambda c: (2 * F.ceil(c / 2)).cast("long")
    long_side = even(major * (1 + 2 * padding))
    return long_side, even(long_side / aspect)


def to_frame(points: Column, inverse: list[float]) -> Column:
    """Keypoints of a crop in frame coordinates, by the six numbers of an affine map."""
    a, b, c, d, e, f = inverse
    return F.transform(points, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y"), p["conf"].alias("conf")))


def outside_boxes(points: Column, boxes: Column) -> Column:
    """Keypoints with no confidence inside any of ``boxes``, arrays of corners in order; edges count as inside."""

    def inside(p: Column, corners: Column) -> Column:
        n = F.size(corners)
        turn = F.transform(corners, lambda q, i: (F.element_at(corners, (i + 1) % n + 1)["x"] - q["x"]) * (p["y"] - q["y"]) - (F.element_at(corners, (i + 1) % n + 1)["y"] - q["y"]) * (p["x"] - q["x"]))
        return F.forall(turn, lambda t: t >= 0) | F.forall(turn, lambda t: t <= 0)

    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(F.exists(boxes, lambda b: inside(p, b)), 0.0).otherwise(p["conf"]).alias("conf")))


def best_instance(rows: DataFrame, key: str, order: str, confidences: str) -> DataFrame:
    """(key, order, Mean): of a key's instances the one of the greatest mean confidence, the first of equals."""
    known = F.filter(F.col(confidences), lambda c: c.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)).otherwise(-1.0)
    best = rows.withColumn("_mean", mean).groupBy(key).agg(F.min(F.struct((-F.col("_mean")).alias("m"), F.col(order).alias("o"))).alias("_b"))
    return best.select(key, F.col("_b.o").alias(order), (-F.col("_b.m")).alias("Mean"))


def pair_cost(place: Column, turn: Column, area: Column, aspect: Column, weights: tuple[float, float, float, float], reach: float, cull: float = 1e6) -> Column:
    """Cost of a track and a detection: weighted distance, turn of the axis (at most a right angle), change of area and aspect.

    Beyond ``reach`` it is ``cull``.
    """
    axis = F.least(F.abs(turn), F.lit(3.141592653589793) - F.abs(turn))
    w = weights
    return F.when(place > reach, F.lit(cull)).otherwise(w[0] * place + w[1] * axis + w[2] * area + w[3] * aspect)


def composite_score(costs: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of sub-costs, and three tenths of the spread of those that have weight."""
    total = sum(weights.values())
    active = [costs[k] for k in costs if weights[k] > 0]
    mean = sum((costs[k] * (weights[k] / total) for k in costs), F.lit(0.0))
    middle = sum(active, F.lit(0.0)) / len(active)
    return mean + 0.3 * F.sqrt(sum(((c - middle) * (c - middle) for c in active), F.lit(0.0)) / len(active))


def trial_score(rows: DataFrame, keys: list[str], frame: str = FRAME) -> DataFrame:
    """(keys, Count, Consistency, Stability): means of two scores, and one less the spread of frame medians over their mean."""
    medians = rows.groupBy(*keys, frame).agg(F.median("Size").alias("_m"), F.avg("CountScore").alias("_c"), F.avg("ConsistencyScore").alias("_k"))
    stable = F.when(F.avg("_m") > 0, F.greatest(F.lit(0.0), 1 - F.stddev_pop("_m") / F.avg("_m"))).otherwise(0.0)
    return medians.groupBy(*keys).agg(F.avg("_c").alias("Count"), F.avg("_k").alias("Consistency"), stable.alias("Stability"))


def cluster_density(points: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """(key, Density): mean density of the points of each of clusters, zero for empty ones."""
    found = points.groupBy(key).agg(F.avg("Density").alias("_d"))
    return clusters.join(found, key, "left").select(key, F.coalesce("_d", F.lit(0.0)).alias("Density"))
