"""Dense regions in space and time from low-confidence detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators.pairs import ensure_checkpoints
from trackmill.operators.sequences import FRAME


def accumulate(rows: DataFrame, cell: float, sigma: float = 1.0) -> DataFrame:
    """(FrameID, GX, GY, Density): sum over detections of (1 - confidence) times a Gaussian, on cells within three sigma.

    Cells are ``cell`` wide and sigma counts cells; what lies beyond three sigma is left out.
    """
    reach = max(1, round(3 * sigma))
    side = F.sequence(F.lit(-reach), F.lit(reach))
    spread = rows.select(FRAME, (F.col("X") / cell).alias("_x"), (F.col("Y") / cell).alias("_y"), (1 - F.col("DetectionConfidence")).alias("_w")).withColumn("_dx", F.explode(side)).withColumn("_dy", F.explode(side))
    placed = spread.select(FRAME, (F.floor("_x") + F.col("_dx")).alias("GX"), (F.floor("_y") + F.col("_dy")).alias("GY"), "_x", "_y", "_w")
    far = F.pow(F.col("GX") + 0.5 - F.col("_x"), 2) + F.pow(F.col("GY") + 0.5 - F.col("_y"), 2)
    return placed.groupBy(FRAME, "GX", "GY").agg(F.sum(F.col("_w") * F.exp(-far / (2 * sigma * sigma))).alias("Density"))


def smooth_in_time(cells: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Density smoothed along the frames of a cell by a Gaussian cut at three sigma; absent cells count as zero."""
    reach = round(3 * sigma)
    total = sum(_bell(k, sigma) for k in range(-reach, reach + 1))
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_bell(k, sigma) / total).alias("w")) for k in range(-reach, reach + 1)])
    spread = cells.withColumn("_o", F.explode(offsets))
    return spread.groupBy((F.col(FRAME) + F.col("_o.k")).alias(FRAME), "GX", "GY").agg(F.sum(F.col("Density") * F.col("_o.w")).alias("Density"))


def _bell(k: int, sigma: float) -> float:
    return 2.718281828459045 ** (-(k * k) / (2 * sigma * sigma))


def above_share(cells: DataFrame, share: float = 0.3) -> DataFrame:
    """Cells of at least ``share`` of the greatest density."""
    top = cells.agg(F.max("Density").alias("_top"))
    return cells.crossJoin(F.broadcast(top)).where(F.col("Density") >= share * F.col("_top")).drop("_top")


def regions(cells: DataFrame, least_frames: int = 3, least_area: int = 1) -> DataFrame:
    """(Region, F0, F1, X0, X1, Y0, Y1, Cells): 26-connected components of cells, large enough, by size.

    Each cell takes the least label of its neighbourhood and labels jump to their label's label, so the
    rounds grow with the logarithm of a component's extent; they are cut by checkpoint().
    """
    ensure_checkpoints(cells.sparkSession)
    key = [FRAME, "GX", "GY"]
    code = F.struct(*key)
    now = cells.select(*key).distinct().select(*key, code.alias("label")).checkpoint()
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    while True:
        sent = now.withColumn("_s", F.explode(shifts)).select((F.col(FRAME) + F.col("_s.a")).alias(FRAME), (F.col("GX") + F.col("_s.b")).alias("GX"), (F.col("GY") + F.col("_s.c")).alias("GY"), "label")
        near = sent.groupBy(*key).agg(F.min("label").alias("_near"))
        step = now.join(near, key).withColumn("_new", F.least("label", "_near"))
        jump = step.select(F.struct(*key).alias("_at"), F.col("_new").alias("_far"))
        new = step.join(jump, step["_new"] == jump["_at"], "left").select(*key, F.col("label").alias("_old"), F.least("_new", F.coalesce("_far", "_new")).alias("label")).checkpoint()
        if new.where("_old <> label").isEmpty():
            break
        now = new.drop("_old")
    boxes = now.groupBy("label").agg(F.min(FRAME).alias("F0"), F.max(FRAME).alias("F1"), F.min("GX").alias("X0"), F.max("GX").alias("X1"), F.min("GY").alias("Y0"), F.max("GY").alias("Y1"), F.count("*").alias("Cells"))
    kept = boxes.where((F.col("F1") - F.col("F0") + 1 >= least_frames) & ((F.col("X1") - F.col("X0") + 1) * (F.col("Y1") - F.col("Y0") + 1) >= least_area))
    return kept.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("F0", "X0", "Y0", "label")).alias("Region"), "F0", "F1", "X0", "X1", "Y0", "Y1", "Cells")


