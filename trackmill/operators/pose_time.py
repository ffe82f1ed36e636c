"""Keypoints along a track: places that jump are suppressed, short gaps filled, and the row's summary follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators.sequences import FRAME, TRACK

# Pose states whose keypoints are judged, the confidence of a filled one, the least deviation and window.
JUDGED, FILLED, LEAST_DEVIATION, LEAST_WINDOW = ("good", "partial"), 0.3, 1e-6, 5


def clean_poses(rows: DataFrame, max_gap: int, limit: float, fill: bool = True) -> DataFrame:
    """rows(track, frame, Keypoints array<struct<x,y,conf>>, ...) with Keypoints cleaned, and Suppressed, Filled, MeanConf, ValidFraction.

    A keypoint is known where its confidence is above zero. Known ones of rows in a judged PoseState (all rows if there is no
    such column) are compared with those around them, as many as twice max_gap and at least five in a centred window: one whose x or y
    lies more than ``limit`` deviations from their mean loses its confidence, if three at least are in the window. Then up to
    max_gap rows between two known places get the place on the straight line by row, and a confidence of 0.3. Suppressed
    and Filled count a row's keypoints. One row per track and frame; a null array stays null, with zeros. All windows
    are of one partitioning by track, so a track's rows move once.
    """
    wide = max(LEAST_WINDOW, 2 * max_gap)
    judged = F.col("PoseState").isin(*JUDGED) if "PoseState" in rows.columns else F.lit(True)
    placed = rows.repartition(TRACK)
    flat = placed.select(TRACK, FRAME, F.coalesce(judged, F.lit(False)).alias("_judged"), F.posexplode("Keypoints").alias("_k", "p")).select(TRACK, FRAME, "_judged", "_k", "p.*")
    known = F.coalesce(F.col("conf") > 0, F.lit(False)) & ~F.coalesce(F.isnan("conf"), F.lit(False))
    flat = flat.withColumn("_sound", known & F.col("_judged"))
    near = Window.partitionBy(TRACK, "_k", "_sound").orderBy(FRAME).rowsBetween(-(wide // 2), (wide - 1) // 2)

    def jumps(c: str):
        n, mean, deviation = F.count(c).over(near), F.avg(c).over(near), F.coalesce(F.stddev_samp(c).over(near), F.lit(0.0))
        return (n >= 3) & (F.abs(F.col(c) - mean) / F.greatest(deviation, F.lit(LEAST_DEVIATION)) > limit)

    flat = flat.withColumn("_odd", F.col("_sound") & F.coalesce(jumps("x") | jumps("y"), F.lit(False)))
    flat = flat.withColumn("conf", F.when(F.col("_odd"), F.lit(0.0)).otherwise(F.col("conf").cast("double")))
    if fill:
        order = Window.partitionBy(TRACK, "_k").orderBy(FRAME)
        back = order.rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy(TRACK, "_k").orderBy(F.desc(FRAME)).rowsBetween(Window.unboundedPreceding, 0)
        flat = flat.withColumn("_at", F.row_number().over(order))
        here = F.when(known, F.struct("_at", "x", "y"))
        flat = flat.withColumns({"_a": F.last(here, True).over(back), "_b": F.last(here, True).over(ahead)})
        gap = ~known & (F.col("_b._at") - F.col("_a._at") - 1 <= max_gap)
        part = (F.col("_at") - F.col("_a._at")) / F.when(F.col("_b._at") > F.col("_a._at"), F.col("_b._at") - F.col("_a._at"))
        line = lambda c: F.col(f"_a.{c}") + part * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))
        flat = flat.withColumn("_fill", F.coalesce(gap, F.lit(False))).select(TRACK, FRAME, "_k", "_odd", "_fill", *[F.when(F.col("_fill"), line(c)).otherwise(F.col(c).cast("double")).alias(c) for c in ("x", "y")], F.when(F.col("_fill"), F.lit(FILLED)).otherwise(F.col("conf")).alias("conf"))
    else:
        flat = flat.withColumn("_fill", F.lit(False))
    points = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "conf").alias("p")))), lambda e: e["p"])  # a row's keypoints
    whole = flat.groupBy(TRACK, FRAME).agg(points.alias("_points"), F.count_if("_odd").alias("Suppressed"), F.count_if("_fill").alias("Filled"))
    finite = F.filter(F.transform("_points", lambda p: p["conf"]), lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    mean = F.when(F.size(finite) > 0, F.aggregate(finite, F.lit(0.0), lambda a, c: a + c) / F.size(finite)).otherwise(0.0)
    told = whole.withColumns({"MeanConf": mean, "ValidFraction": F.size(F.filter(finite, lambda c: c > 0)) / F.size("_points")})
    rest = [c for c in rows.columns if c not in ("Keypoints", "Suppressed", "Filled", "MeanConf", "ValidFraction")]
    none = {"Suppressed": 0, "Filled": 0, "MeanConf": 0.0, "ValidFraction": 0.0}
    empty = F.when(F.col("Keypoints").isNotNull(), F.array().cast("array<struct<x:double,y:double,conf:double>>"))
    return placed.join(told, [TRACK, FRAME], "left").select(*rest, F.coalesce("_points", empty).alias("Keypoints"), *[F.coalesce(told[c], F.lit(v)).alias(c) for c, v in none.items()])
