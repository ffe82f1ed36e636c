"""Operators on the row sequence of one trajectory: breaks, splits, fills and smoothing.

All are window expressions over one partitioning by track, so a chain of them shuffles once.
Segments are islands: a flag at each row that begins one, and a running sum of the flags.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRACK, FRAME = "TrajectoryID", "FrameID"
HIDDEN = ("occluded", "lost")


def by_track() -> WindowSpec:
    return Window.partitionBy(TRACK)


def in_order() -> WindowSpec:
    """A track's rows by frame; rows of one frame by detection."""
    return by_track().orderBy(FRAME, "DetectionID")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def hide_occluded(rows: DataFrame) -> DataFrame:
    """X, Y and Theta null where the state says that nothing was seen."""
    seen = ~F.col("State").isin(*HIDDEN)
    return rows.withColumns({c: F.when(seen, F.col(c)) for c in ("X", "Y", "Theta")})


def step_velocity(rows: DataFrame) -> DataFrame:
    """FrameDiff, DistDiff and Velocity against the row before; at the same frame 0 or infinite."""
    gap = F.col(FRAME) - F.lag(FRAME).over(in_order())
    far = F.hypot(F.col("X") - F.lag("X").over(in_order()), F.col("Y") - F.lag("Y").over(in_order()))
    out = rows.withColumns({"FrameDiff": gap, "DistDiff": far})
    speed = F.when(F.col("FrameDiff") == 0, F.when(F.col("DistDiff") > 0, F.lit(math.inf))).otherwise(F.col("DistDiff") / F.when(F.col("FrameDiff") != 0, F.col("FrameDiff")))
    return out.withColumn("Velocity", speed)


def islands(rows: DataFrame, begins: Column, name: str = "Segment") -> DataFrame:
    """Number of the segment of each row, from 0, where ``begins`` is true at a segment's first row."""
    marked = rows.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("long"))
    return marked.withColumn(name, F.sum("_begins").over(so_far())).drop("_begins")


def drop_short(rows: DataFrame, least: int, name: str = "Segment") -> DataFrame:
    """Only segments of at least ``least`` rows."""
    return rows.withColumn("_rows", F.count("*").over(Window.partitionBy(TRACK, name))).where(F.col("_rows") >= least).drop("_rows")


def velocity_breaks(rows: DataFrame, limit: float = 100.0, least: int = 10) -> DataFrame:
    """Segments cut where the speed exceeds ``limit``; short ones go."""
    return drop_short(islands(step_velocity(rows), F.col("Velocity") > limit), least)


def zscore_breaks(rows: DataFrame, limit: float, window: int = 10, floor: float = 2.0, active: float = 0.5, regular: float = 0.5) -> DataFrame:
    """Break flags from how far a speed stands out of those of the ``window`` rows before it.

    Speeds of at least ``active`` count where there are three of them, else all. Tracks of fewer than
    window + 2 rows have no break.
    """
    past = in_order().rowsBetween(-window, -1)
    v = F.col("Velocity")
    lively = F.when(v >= active, v)
    few = F.count(lively).over(past) < 3
    out = step_velocity(rows).withColumns({
        "_n": F.count(v).over(past), "_at": F.row_number().over(in_order()) - 1, "_all": F.count("*").over(by_track()),
        "_mean": F.when(few, F.avg(v).over(past)).otherwise(F.avg(lively).over(past)),
        "_std": F.when(few, F.stddev_samp(v).over(past)).otherwise(F.stddev_samp(lively).over(past)),
    })
    hot = (v >= floor) & ((v - F.col("_mean")) / (F.col("_std") + regular) > limit)
    ready = (F.col("_n") >= 3) & (F.col("_at") >= window + 1) & (F.col("_all") >= window + 2)
    return out.withColumn("IsBreak", F.coalesce(hot & ready, F.lit(False))).drop("_n", "_at", "_all", "_mean", "_std")


def occlusion_splits(rows: DataFrame, gap: int = 30) -> DataFrame:
    """Segments that begin where a run of more than ``gap`` unseen rows begins."""
    hidden = F.col("State").isin(*HIDDEN)
    runs = rows.withColumn("_hidden", hidden).withColumn("_turn", (F.lag("_hidden").over(in_order()) != F.col("_hidden")).cast("long"))
    runs = runs.withColumn("_run", F.coalesce(F.sum("_turn").over(so_far()), F.lit(0)))
    sized = runs.withColumns({"_size": F.count("*").over(Window.partitionBy(TRACK, "_run")), "_first": F.coalesce(F.col("_turn") == 1, F.lit(True))})
    return islands(sized, F.col("_hidden") & (F.col("_size") > gap) & F.col("_first")).drop("_hidden", "_turn", "_run", "_size", "_first")


def spatial_jump_splits(rows: DataFrame, limit: float = 100.0) -> DataFrame:
    """Segments that begin at a seen row whose last seen row lies more than one frame back, too far for ``limit``."""
    seen = F.col("X").isNotNull() & F.col("Y").isNotNull()
    last = {c: F.last(F.when(seen, F.col(c)), True).over(before()) for c in (FRAME, "X", "Y")}
    out = rows.withColumns({"_f": last[FRAME], "_x": last["X"], "_y": last["Y"]})
    gap = F.col(FRAME) - F.col("_f")
    jump = seen & (gap > 1) & (F.hypot(F.col("X") - F.col("_x"), F.col("Y") - F.col("_y")) > limit * gap)
    return islands(out, jump).drop("_f", "_x", "_y")


def trim_edges(rows: DataFrame, least: int = 1) -> DataFrame:
    """Without the unseen rows before the first and after the last seen one; short tracks go."""
    frame = F.when(~F.col("State").isin(*HIDDEN), F.col(FRAME))
    inner = rows.withColumns({"_lo": F.min(frame).over(by_track()), "_hi": F.max(frame).over(by_track())}).where(F.col(FRAME).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return inner.withColumn("_rows", F.count("*").over(by_track())).where(F.col("_rows") >= least).drop("_rows")


def gap_segments(rows: DataFrame, max_gap: int = 5, max_jump: float = 75.0) -> DataFrame:
    """Segments cut where the frame gap or the step is too large."""
    gap = F.col(FRAME) - F.lag(FRAME).over(in_order())
    far = F.hypot(F.col("X") - F.lag("X").over(in_order()), F.col("Y") - F.lag("Y").over(in_order()))
    return islands(rows, (gap > max_gap) | (far > max_jump))


def first_per_frame(rows: DataFrame) -> DataFrame:
    """The first row of each track and frame."""
    rank = F.row_number().over(Window.partitionBy(TRACK, FRAME).orderBy("DetectionID"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_per_frame(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(TRACK, FRAME).orderBy(F.desc("DetectionID")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def densify(rows: DataFrame) -> DataFrame:
    """A row for every frame from a track's first to its last; new rows are occluded.

    Each row opens the frames up to the next one, so nothing is joined: expects one row per frame.
    """
    ahead = F.lead(FRAME).over(in_order())
    grown = rows.withColumn("_to", F.coalesce(ahead - 1, F.col(FRAME))).withColumn("_f", F.explode(F.sequence(F.col(FRAME), F.col("_to"))))
    own = F.col("_f") == F.col(FRAME)
    kept = [F.when(own, F.col(c)).alias(c) for c in rows.columns if c not in (TRACK, FRAME, "State")]
    return grown.select(TRACK, F.col("_f").alias(FRAME), F.when(own, F.col("State")).otherwise("occluded").alias("State"), *kept)


def _around(value: Column, order) -> tuple[Column, ...]:
    """Frame and value of the nearest known rows at or before, and at or after."""
    so_far = lambda order: order.rowsBetween(Window.unboundedPreceding, 0)  # noqa: E731  a running value; what follows is what precedes in reverse
    back, ahead = so_far(order), so_far(by_track().orderBy(F.desc(FRAME)))
    frame = F.when(value.isNotNull(), F.col(FRAME))
    return F.last(frame, True).over(back), F.last(value, True).over(back), F.last(frame, True).over(ahead), F.last(value, True).over(ahead)


def fill_linear(rows: DataFrame, columns: list[str], max_gap: int = 10) -> DataFrame:
    """Nulls between known values filled on the straight line, in gaps of at most ``max_gap`` frames. One row per frame."""
    order = by_track().orderBy(FRAME)
    names = {c: [f"_{c}_{k}" for k in ("f0", "v0", "f1", "v1")] for c in columns}
    out = rows.withColumns({n: e for c in columns for n, e in zip(names[c], _around(F.col(c), order), strict=True)})
    for c in columns:
        f0, v0, f1, v1 = map(F.col, names[c])
        line = v0 + (v1 - v0) * (F.col(FRAME) - f0) / F.when(f1 > f0, f1 - f0)
        out = out.withColumn(c, F.when(F.col(c).isNull() & (f1 - f0 - 1 <= max_gap), line).otherwise(F.col(c)))
    return out.drop(*[n for part in names.values() for n in part])


def fill_circular(rows: DataFrame, column: str = "Theta", max_gap: int = 10) -> DataFrame:
    """The same for an angle, by its sine and cosine."""
    parts = rows.withColumns({"_sin": F.sin(column), "_cos": F.cos(column)})
    filled = fill_linear(parts, ["_sin", "_cos"], max_gap)
    angle = F.atan2("_sin", "_cos")
    return filled.withColumn(column, F.coalesce(F.col(column), angle - F.floor(angle / (2 * math.pi)) * (2 * math.pi))).drop("_sin", "_cos")


def fragments(rows: DataFrame) -> DataFrame:
    """(track, start, end, rows): runs of consecutive frames. One row per frame."""
    run = F.col(FRAME) - F.row_number().over(by_track().orderBy(FRAME))
    return rows.withColumn("_run", run).groupBy(TRACK, "_run").agg(F.min(FRAME).alias("StartFrame"), F.max(FRAME).alias("EndFrame"), F.count("*").alias("Rows")).drop("_run")


def unseen_runs(rows: DataFrame, least: int = 5) -> DataFrame:
    """(track, start, end, rows): runs of null X of at least ``least`` rows."""
    lost = F.col("X").isNull()
    run = F.row_number().over(in_order()) - F.row_number().over(Window.partitionBy(TRACK, lost).orderBy(FRAME, "DetectionID"))
    return rows.withColumns({"_lost": lost, "_run": run}).where("_lost").groupBy(TRACK, "_run").agg(F.min(FRAME).alias("StartFrame"), F.max(FRAME).alias("EndFrame"), F.count("*").alias("Rows")).where(F.col("Rows") >= least).drop("_run")


def rolling_outliers(rows: DataFrame, column: str, half: int = 5, limit: float = 3.0) -> DataFrame:
    """Flag values far from the mean of their centred window (three values at least)."""
    near = in_order().rowsBetween(-half, half)
    v = F.col(column)
    out = rows.withColumns({"_n": F.count(v).over(near), "_m": F.avg(v).over(near), "_s": F.stddev_samp(v).over(near)})
    odd = (F.col("_n") >= 3) & (F.col("_s") > 0) & (F.abs(v - F.col("_m")) > limit * F.col("_s"))
    return out.withColumn("IsOutlier", F.coalesce(odd, F.lit(False))).drop("_n", "_m", "_s")


def smooth_median(rows: DataFrame, column: str, window: int = 5) -> DataFrame:
    """Centred median over an odd window, truncated at the ends."""
    half = window // 2
    near = F.sort_array(F.collect_list(column).over(in_order().rowsBetween(-half, half)))
    out = rows.withColumn("_near", near)
    low, high = F.floor((F.size("_near") - 1) / 2).cast("int"), F.floor(F.size("_near") / 2).cast("int")
    return out.withColumn(f"{column}Smooth", (F.get("_near", low) + F.get("_near", high)) / 2).drop("_near")


def smooth_angle(rows: DataFrame, column: str = "Theta", half: int = 2) -> DataFrame:
    """Centred mean of the unwrapped angle, wrapped again."""
    turn = F.col(column) - F.lag(column).over(in_order())
    stepped = rows.withColumn("_step", F.coalesce(turn - 2 * math.pi * F.floor((turn + math.pi) / (2 * math.pi)), F.col(column)))
    unwrapped = stepped.withColumn("_flat", F.sum("_step").over(so_far()))
    mean = F.avg("_flat").over(in_order().rowsBetween(-half, half))
    out = unwrapped.withColumn("_mean", mean)
    return out.withColumn(f"{column}Smooth", F.col("_mean") - F.floor(F.col("_mean") / (2 * math.pi)) * (2 * math.pi)).drop("_step", "_flat", "_mean")


def renumber(rows: DataFrame, keys: list[str], name: str = "NewID") -> DataFrame:
    """Dense numbers from 0 in the order of ``keys``."""
    ids = dense_ids(rows.select(*keys).distinct(), keys, name)
    on = [rows[k].eqNullSafe(ids[k]) for k in keys]
    return rows.join(ids, on).select(rows["*"], ids[name])


def dense_ids(keys_of: DataFrame, keys: list[str], name: str, parts: int = 64) -> DataFrame:
    """Consecutive numbers of distinct keys in their order: rank inside a range of keys plus the keys before it.

    The ranges are cut at whole keys of a sample that is drawn by hash (at most 32 for each of ``parts``), so a key's range
    doesn't depend on where Spark happens to place it, and no task sorts all keys even if the first one has few values.
    """
    drawn = keys_of.select(*keys).orderBy(F.xxhash64(*keys)).limit(32 * parts).orderBy(*keys).collect()
    kinds = [keys_of.schema[k].dataType for k in keys]
    cuts = [F.struct(*[F.lit(row[k]).cast(t).alias(k) for k, t in zip(keys, kinds)]) for row in drawn[:: max(1, -(-len(drawn) // parts))]]
    own = F.struct(*keys)
    part = F.size(F.filter(F.array(*cuts), lambda c: c <= own)) if cuts else F.lit(0)
    placed = keys_of.withColumn("_part", part)
    local = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(earlier), "_part").select(*keys, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias(name))


def fill_tasks(rows: DataFrame, most: int) -> DataFrame:
    """(track, StartFrame, EndFrame, X0, Y0, X1, Y1): unseen runs of at most ``most`` frames, with the known places on both sides."""
    known = rows.where("X is not null and Y is not null")
    order = in_order()
    ahead = known.select(TRACK, F.col(FRAME).alias("_f"), F.col("X").alias("X0"), F.col("Y").alias("Y0"), F.lead(FRAME).over(order).alias("_next"), F.lead("X").over(order).alias("X1"), F.lead("Y").over(order).alias("Y1"))
    gap = F.col("_next") - F.col("_f") - 1
    return ahead.where((gap >= 1) & (gap <= most)).select(TRACK, (F.col("_f") + 1).alias("StartFrame"), (F.col("_next") - 1).alias("EndFrame"), "X0", "Y0", "X1", "Y1")


def coverage(rows: DataFrame, slots: int) -> DataFrame:
    """(FrameID, Coverage, Occluded, Lost): the share of slots that are active, and how many are in the other states."""
    return rows.groupBy(FRAME).agg((F.count_if(F.col("State") == "active") / slots).alias("Coverage"), F.count_if(F.col("State") == "occluded").alias("Occluded"), F.count_if(F.col("State") == "lost").alias("Lost"))
