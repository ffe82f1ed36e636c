"""Expressions on keypoints: array<struct<x,y,conf>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def valid(points: Column, least: float = 0.2) -> Column:
    return F.filter(points, lambda p: p["conf"] >= least)


def summary(points: Column, least: float = 0.2) -> Column:
    """struct(MeanConf, ValidFraction, NumValid, NumKeypoints)."""
    n = F.size(points)
    good = F.size(valid(points, least))
    mean = F.when(n > 0, _total(F.transform(points, lambda p: p["conf"].cast("double"))) / n).otherwise(0.0)
    return F.struct(mean.alias("MeanConf"), F.when(n > 0, good / n).otherwise(0.0).alias("ValidFraction"), good.alias("NumValid"), n.alias("NumKeypoints"))


def centroid(points: Column) -> Column:
    """struct(x, y) weighted by confidence; null without weight."""
    weight = _total(F.transform(points, lambda p: p["conf"].cast("double")))
    mean = lambda c: _total(F.transform(points, lambda p: p["conf"].cast("double") * p[c])) / weight
    return F.when(weight > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def body_length(points: Column, head: int, tail: int) -> Column:
    """Distance between two keypoints by number."""
    a, b = F.get(points, F.lit(head)), F.get(points, F.lit(tail))
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def normalised(points: Column) -> Column:
    """Points moved to their centroid and divided by the median radius, at least 1."""
    c = centroid(points)
    moved = F.transform(points, lambda p: F.struct((p["x"] - c["x"]).alias("x"), (p["y"] - c["y"]).alias("y"), p["conf"].alias("conf")))
    radii = F.sort_array(F.transform(moved, lambda p: F.hypot(p["x"], p["y"])))
    n = F.size(radii)
    middle = (F.get(radii, F.floor((n - 1) / 2).cast("int")) + F.get(radii, F.floor(n / 2).cast("int"))) / 2
    scale = F.greatest(F.lit(1.0), middle)
    return F.transform(moved, lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y"), p["conf"].alias("conf")))


def quality(points: Column, least: float = 0.2, fraction: float = 0.5, count: int = 3, odd_body: Column | None = None, odd_edges: Column | None = None) -> Column:
    """struct(Score, State): rejected below the fraction or the count of valid points; else by the score.

    The score is the valid fraction times the mean confidence of valid points, times 0.7 if the body's length is
    odd, and times 1 - 0.15 for each odd edge, 0.5 at the least.
    """
    s = summary(points, least)
    sure = F.transform(valid(points, least), lambda p: p["conf"].cast("double"))
    score = s["ValidFraction"] * F.when(F.size(sure) > 0, _total(sure) / F.size(sure)).otherwise(0.0)
    if odd_body is not None:
        score = score * F.when(odd_body, 0.7).otherwise(1.0)
    if odd_edges is not None:
        score = score * F.greatest(F.lit(0.5), 1 - 0.15 * odd_edges)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    refused = (s["ValidFraction"] < fraction) | (s["NumValid"] < count)
    state = F.when(points.isNull() | (F.size(points) == 0), "no_pose").when(refused, "rejected").when(score < 0.2, "bad").when(score < 0.7, "partial").otherwise("good")
    return F.struct(F.when(refused, F.lit(0.0)).otherwise(score).alias("Score"), state.alias("State"))


def to_wide(points: Column, names: list[str]) -> list[Column]:
    """Columns <name>_X, <name>_Y and <name>_Conf of keypoints in order."""
    return [F.get(points, F.lit(i))[c].alias(f"{name}_{label}") for i, name in enumerate(names) for c, label in (("x", "X"), ("y", "Y"), ("conf", "Conf"))]


def to_nested(names: list[str]) -> Column:
    """Keypoints of such columns."""
    return F.array(*[F.struct(F.col(f"{n}_X").alias("x"), F.col(f"{n}_Y").alias("y"), F.col(f"{n}_Conf").alias("conf")) for n in names])


def migrated(points: Column, old: list[str], new: list[str]) -> Column:
    """Keypoints in the order of new names; a name that the old ones lack is zero."""
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("conf"))
    as_double = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), p["conf"].cast("double").alias("conf"))
    return F.array(*[as_double(F.get(points, F.lit(old.index(n)))) if n in old else none for n in new])


def rectangle(cx: Column, cy: Column, w: Column, h: Column, theta: Column) -> Column:
    """Corners of a rotated rectangle as an array of (x, y)."""
    c, s = F.cos(theta), F.sin(theta)
    return F.array(*[F.struct((cx + a * w / 2 * c - b * h / 2 * s).alias("x"), (cy + a * w / 2 * s + b * h / 2 * c).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def bounding_box(corners: Column, pad: float = 0.0) -> Column:
    """struct(X0, Y0, X1, Y1), padded by a share of each side."""
    ends = {n: f(F.transform(corners, lambda p: p[c])) for n, f, c in (("X0", F.array_min, "x"), ("Y0", F.array_min, "y"), ("X1", F.array_max, "x"), ("Y1", F.array_max, "y"))}
    w, h = (ends["X1"] - ends["X0"]) * pad, (ends["Y1"] - ends["Y0"]) * pad
    return F.struct((ends["X0"] - w).alias("X0"), (ends["Y0"] - h).alias("Y0"), (ends["X1"] + w).alias("X1"), (ends["Y1"] + h).alias("Y1"))
