"""Detection filters and selections: measures, masks, windows, frame scores and picks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators.sequences import FRAME, TRACK


def filter_raw(rows: DataFrame, least_confidence: float = 0.25, area: tuple[float, float] = (0.0, math.inf), aspect: tuple[float, float] = (0.0, math.inf), targets: int = 8) -> DataFrame:
    """Detections (FrameID, DetectionID, W, H, Confidence) in bounds; of a frame the ``targets`` largest, ties by id.

    Size is the area of the ellipse with axes W and H.
    """
    size = F.col("W") * F.col("H") * math.pi / 4
    ratio = F.greatest("W", "H") / F.least("W", "H")
    kept = rows.withColumn("Area", size).where((F.col("Confidence") >= least_confidence) & F.col("Area").between(*area) & ratio.between(*aspect))
    rank = F.row_number().over(Window.partitionBy(FRAME).orderBy(F.desc("Area"), "DetectionID"))
    return kept.withColumn("_r", rank).where(F.col("_r") <= targets).drop("_r")


def inside_mask(rows: DataFrame, mask: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    """Rows whose pixel (floor x, floor y) is set in mask(MX, MY)."""
    on = (F.floor(rows[x]) == mask["MX"]) & (F.floor(rows[y]) == mask["MY"])
    return rows.join(mask.select("MX", "MY").distinct(), on, "left_semi")


def window_of(rows: DataFrame, f0: int, f1: int, box: tuple[float, float, float, float] | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows of a frame range, optionally of a box (x0, y0, x1, y1) and of some tracks."""
    kept = rows.where(F.col(FRAME).between(f0, f1))
    if box:
        kept = kept.where(F.col("X").between(box[0], box[2]) & F.col("Y").between(box[1], box[3]))
    return kept.where(F.col(TRACK).isin(ids)) if ids is not None else kept


def rescale(rows: DataFrame, factor: float, columns: tuple[str, ...] = ("X", "Y", "Width", "Height")) -> DataFrame:
    """Positions and sizes that exist, divided by the resize factor."""
    return rows.withColumns({c: F.col(c) / factor for c in columns if c in rows.columns})


def frame_scores(rows: DataFrame, expected: int, sure: float = 0.5, cost: str | None = None, uncertainty: str | None = None) -> DataFrame:
    """(FrameID, Score): how badly a frame went. A sum of low mean confidence (0.4), tracks that are missing (0.3) or
    too many (half of 0.15), mean assignment cost (0.15), lost tracks (0.1) and mean position uncertainty (0.05).

    Costs and uncertainties count in fiftieths up to one; without their column they add nothing.
    """
    n, lost = F.count_distinct(TRACK), F.count_distinct(F.when(F.col("State") == "lost", F.col(TRACK)))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)) if c else F.lit(0.0)
    found = rows.groupBy(FRAME).agg(n.alias("_n"), lost.alias("_l"), F.avg("DetectionConfidence").alias("_c"), mean(cost).alias("_a"), mean(uncertainty).alias("_u"))
    unsure = F.greatest(F.lit(0.0), (sure - F.coalesce("_c", F.lit(sure))) / max(sure, 1e-6))
    off = (F.col("_n") - expected) / expected
    count = F.when(off < 0, -0.3 * off).otherwise(0.15 * 0.5 * F.least(off, F.lit(1.0)))
    up_to_one = lambda c: F.least(c, F.lit(1.0))
    return found.select(FRAME, (0.4 * unsure + count + 0.15 * up_to_one(F.col("_a") / 50) + 0.1 * up_to_one(F.col("_l") / expected) + 0.05 * up_to_one(F.col("_u") / 50)).alias("Score"))


def diverse_frames(scores: DataFrame, k: int, apart: int) -> DataFrame:
    """The k worst frames in order of score, none within ``apart`` frames of a worse one that was picked.

    Only the best frame of each bucket of ``apart`` frames can be first, so each pick reads one row; k is the
    operator's own limit.
    """
    spark, picked = scores.sparkSession, []
    for _ in range(k):
        left = scores
        for f, _s in picked:
            left = left.where(F.abs(F.col(FRAME) - f) >= apart)
        row = left.orderBy(F.desc("Score"), FRAME).first()
        if row is None:
            break
        picked.append((row[FRAME], row["Score"]))
    return spark.createDataFrame([(f, s, i) for i, (f, s) in enumerate(picked)], "FrameID long, Score double, Pick int")


def representatives(rows: DataFrame, cluster: str, label: str, density: str, id_column: str, n: int) -> DataFrame:
    """(id, cluster, Score): n unlabelled rows from clusters by (1 - coverage) / density, clusters filled in order.

    Inside a cluster rows come by a hash of their id. n is the operator's own limit.
    """
    stats = rows.groupBy(cluster).agg(((1 - F.avg(F.col(label).isNotNull().cast("double"))) / (F.coalesce(F.avg(density), F.lit(0.0)) + 1e-6)).alias("Score"))
    free = rows.where(F.col(label).isNull()).select(F.col(id_column).alias("id"), cluster)
    return free.join(stats, cluster).orderBy(F.desc("Score"), cluster, F.md5(F.col("id").cast("string")), "id").limit(n)


def quotas(sizes: DataFrame, cluster: str, total: int, least: int = 1) -> DataFrame:
    """(cluster, Quota): at least ``least`` each (never over the size), the rest in proportion, rounded down."""
    base = sizes.withColumn("_b", F.least(F.lit(least), "Size"))
    sums = base.agg(F.sum("Size").alias("_all"), F.sum("_b").alias("_used"))
    spare = F.greatest(F.lit(0), F.lit(total) - F.col("_used"))
    return base.crossJoin(F.broadcast(sums)).select(cluster, F.least("Size", F.col("_b") + F.floor(spare * F.col("Size") / F.col("_all"))).cast("long").alias("Quota"))


def worst_two_classes(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, Count): the two most frequent confusions, ties by name."""
    return rows.where(F.col(truth) != F.col(guess)).groupBy(truth, guess).agg(F.count("*").alias("Count")).orderBy(F.desc("Count"), truth, guess).limit(2)


def within_of_best(rows: DataFrame, group: str, value: str, share: float = 0.05) -> DataFrame:
    """Rows of a group no more than ``share`` above its least value."""
    best = F.min(value).over(Window.partitionBy(group))
    return rows.withColumn("_best", best).where(F.col(value) <= F.col("_best") * (1 + share)).drop("_best")


def latest_valid(rows: DataFrame, group: str, order: list, valid: Column) -> DataFrame:
    """The last valid row of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.where(valid).withColumn("_r", rank).where("_r = 1").drop("_r")


def padding_waste(count: Column, batch: int) -> Column:
    """Slots of the last batch that stay empty."""
    return F.pmod(-count, F.lit(batch))


def circle_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, CX, CY, Radius): algebraic least squares from sums of one pass; null where the points lie on a line."""
    x, y = F.col("X"), F.col("Y")
    mean = rows.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    u, v = x - F.col("_mx"), y - F.col("_my")
    s = rows.join(mean, keys).groupBy(*keys, "_mx", "_my").agg(*[F.sum(e).alias(n) for n, e in (("uu", u * u), ("vv", v * v), ("uv", u * v), ("uuu", u * u * u), ("vvv", v * v * v), ("uvv", u * v * v), ("vuu", v * u * u))], F.count("*").alias("n"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a, b = (F.col("uuu") + F.col("uvv")) / 2, (F.col("vvv") + F.col("vuu")) / 2
    safe = F.when(F.abs(det) > 1e-9, det)
    cu, cv = (a * F.col("vv") - b * F.col("uv")) / safe, (b * F.col("uu") - a * F.col("uv")) / safe
    return s.select(*keys, (cu + F.col("_mx")).alias("CX"), (cv + F.col("_my")).alias("CY"), F.sqrt(cu * cu + cv * cv + (F.col("uu") + F.col("vv")) / F.col("n")).alias("Radius"))
