"""Cleaning, interpolation and the reconciliation of a forward and a backward pass.

The frame joins are plain equi-joins; what decides by order (matching, removal of redundant tracks,
stitching) works on small tables of pairs, and each round is cut from its lineage by checkpoint().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import blocks, graphs, kernels, pairs
from trackmill.operators import sequences as seq
from trackmill.operators.sequences import FRAME, TRACK


def relabel(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Dense TrajectoryID over the old id and the segment columns."""
    return seq.renumber(rows, [TRACK, *parts], "_new").withColumn(TRACK, F.col("_new")).drop("_new", *parts)


def clean(rows: DataFrame, least: int = 10, limit: float = 100.0, gap: int = 30) -> DataFrame:
    """Velocity breaks, occlusion splits, jumps across gaps; then edges trimmed and ids dense. Short pieces go."""
    cut = seq.velocity_breaks(seq.hide_occluded(rows), limit, least).drop("FrameDiff", "DistDiff", "Velocity")
    cut = relabel(cut, ["Segment"])
    cut = relabel(seq.drop_short(seq.occlusion_splits(cut, gap), least), ["Segment"])
    cut = relabel(seq.drop_short(seq.spatial_jump_splits(cut, limit), least), ["Segment"])
    return relabel(seq.trim_edges(cut, least), [])


def interpolate(rows: DataFrame, max_gap: int = 10, burst: int = 5, method: str = "linear") -> DataFrame:
    """One row per frame, dense frames, positions and headings filled in gaps of at most ``max_gap``.

    method: linear or cubic for positions; headings are repaired and filled on the circle. A smoothing
    spline is not offered: its smoothing rule can't be reproduced here.
    """
    if method not in ("linear", "cubic"):
        raise ValueError(f"no such method: {method}")
    grid = seq.densify(seq.first_per_frame(rows))
    placed = seq.fill_linear(grid, ["X", "Y"], max_gap) if method == "linear" else kernels.fill_cubic(grid, ["X", "Y"], max_gap)
    return seq.fill_circular(kernels.repair_heading_flips(placed, burst), "Theta", max_gap)


def merge_pairs(forward: DataFrame, backward: DataFrame, matches: DataFrame, near: float) -> DataFrame:
    """Rows of matched tracks: merged where they agree, both sides apart where they don't.

    From a frame of agreement on the pair is merged until one of disagreement, and from there on apart
    until they agree again; frames of one side alone stay in the state that holds.
    """
    cols = ["X", "Y", "Theta", "State", "DetectionID", "DetectionConfidence"]
    m = matches.select("AID", "BID")
    a = seq.last_per_frame(forward).withColumnRenamed(TRACK, "AID").join(m, "AID").select("AID", "BID", FRAME, F.struct(*cols).alias("a"))
    b = seq.last_per_frame(backward).withColumnRenamed(TRACK, "BID").join(m, "BID").select("AID", "BID", FRAME, F.struct(*cols).alias("b"))
    both = a.join(b, ["AID", "BID", FRAME], "full")
    has_a, has_b = F.col("a.X").isNotNull(), F.col("b.X").isNotNull()
    far = F.hypot(F.col("a.X") - F.col("b.X"), F.col("a.Y") - F.col("b.Y"))
    verdict = F.when(has_a & has_b, F.when(far <= near, "merged").otherwise("apart"))
    order = Window.partitionBy("AID", "BID").orderBy(FRAME)
    state = F.coalesce(F.last(verdict, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("merged"))
    marked = both.withColumn("_state", state).withColumn("_turn", F.coalesce((F.lag("_state").over(order) != F.col("_state")).cast("long"), F.lit(0)))
    blocks = marked.withColumn("_block", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.when(has_a & has_b, _consensus()).when(has_a | F.col("b").isNull(), F.col("a")).otherwise(F.coalesce("b", "a"))
    sides = F.when(F.col("_state") == "merged", F.array(F.struct(F.lit(0).alias("side"), one.alias("row")))).otherwise(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("row")), F.struct(F.lit(2).alias("side"), F.col("b").alias("row"))))
    return blocks.select("AID", "BID", "_block", FRAME, F.explode(sides).alias("_s")).where("_s.row is not null").select(F.col("AID").alias(TRACK), "BID", "_block", F.col("_s.side").alias("_side"), FRAME, "_s.row.*")


def _consensus():
    from trackmill.functions.angles import axis_mean

    theta = F.when(F.col("a.Theta").isNotNull() & F.col("b.Theta").isNotNull(), axis_mean(F.col("a.Theta"), F.col("b.Theta"))).otherwise(F.coalesce("a.Theta", "b.Theta"))
    state = F.when((F.col("a.State") == "active") | (F.col("b.State") == "active"), "active").otherwise(F.col("a.State"))
    return F.struct(((F.col("a.X") + F.col("b.X")) / 2).alias("X"), ((F.col("a.Y") + F.col("b.Y")) / 2).alias("Y"), theta.alias("Theta"), state.alias("State"), F.coalesce("a.DetectionID", "b.DetectionID").alias("DetectionID"), F.greatest("a.DetectionConfidence", "b.DetectionConfidence").alias("DetectionConfidence"))


def drop_redundant(rows: DataFrame, near: float, remove: float = 0.95, trim: float = 0.7) -> DataFrame:
    """Of overlapping tracks the longer stays: one that agrees in 95 % of its frames with a kept longer one goes,
    in 70 % it loses the frames that agree.

    A track is decided once all longer ones that agree with it enough are; rounds run on the pair table until
    every pair is settled.
    """
    pairs.ensure_checkpoints(rows.sparkSession)
    known = pairs._side(rows, "A").checkpoint()

    def share(p: blocks.Tile, q: blocks.Tile):
        count = blocks.agreeing(p, q, near)
        i, j = np.nonzero((count > 0) & (count >= trim * np.minimum(p.sizes[:, None], q.sizes[None, :]) - 1))
        return i, j, {"n": count[i, j].astype(np.int64), "first": np.where(p.ids[i] < q.ids[j], p.sizes[i], q.sizes[j]), "second": np.where(p.ids[i] < q.ids[j], q.sizes[j], p.sizes[i])}

    met = blocks.compare(known, None, share, "n long, first long, second long")
    longer = F.col("first") >= F.col("second")  # of equals the first stays
    ordered = met.select(F.when(longer, F.col("AID")).otherwise(F.col("BID")).alias("AID"), F.when(longer, F.col("BID")).otherwise(F.col("AID")).alias("BID"), (F.col("n") / F.least("first", "second")).alias("ratio"))
    edges = ordered.where(F.col("ratio") >= trim).checkpoint()
    gone = edges.select(F.col("BID").alias("id")).limit(0).checkpoint()
    open_edges = edges
    while not open_edges.isEmpty():
        settled = open_edges.join(open_edges.select(F.col("BID").alias("AID")).distinct(), "AID", "left_anti")
        removed = settled.where(F.col("ratio") >= remove).select(F.col("BID").alias("id")).distinct()
        gone = gone.unionAll(removed).distinct().checkpoint()
        done = settled.select("AID", "BID")
        open_edges = open_edges.join(done, ["AID", "BID"], "left_anti").join(gone.select(F.col("id").alias("BID")), "BID", "left_anti").join(gone.select(F.col("id").alias("AID")), "AID", "left_anti").select("AID", "BID", "ratio").checkpoint()
    live = edges.join(gone.select(F.col("id").alias("AID")), "AID", "left_anti").join(gone.select(F.col("id").alias("BID")), "BID", "left_anti")
    other = known.select(FRAME, F.col("AID").alias("BID"), F.col("AX").alias("BX"), F.col("AY").alias("BY"))
    both = live.select("AID", "BID").join(known, "AID").join(other, ["BID", FRAME]).where(pairs.distance("AX", "AY", "BX", "BY") <= near)
    trimmed = both.select(F.col("BID").alias(TRACK), FRAME).distinct()
    return rows.join(gone.select(F.col("id").alias(TRACK)), TRACK, "left_anti").join(trimmed, [TRACK, FRAME], "left_anti")


def agreeing_pairs(rows: DataFrame, near: float, overlap: int) -> DataFrame:
    """(AID, BID, Common, Agreeing, SameID): pairs of one set of tracks that are one object where they overlap.

    A frame agrees if both have the same detection or are at most ``near`` apart. Wanted are ``overlap``
    common frames, as many of them that agree, and half of all common ones; two frames of one detection
    stand for half the agreeing frames (two at least) and for any share.
    """
    side = lambda p: seq.last_per_frame(rows).where("X is not null and Y is not null").select(FRAME, F.col(TRACK).alias(f"{p}ID"), F.col("X").alias(f"{p}X"), F.col("Y").alias(f"{p}Y"), F.col("DetectionID").alias(f"{p}D"))
    a, b = side("A"), side("B")
    same = a.join(b, (a[FRAME] == b[FRAME]) & (F.col("AD") == F.col("BD"))).where("AID < BID").groupBy("AID", "BID").agg(F.count("*").alias("SameID"), F.count_if(pairs.distance("AX", "AY", "BX", "BY") > near).alias("_far"))
    half = max(2, overlap // 2)

    def agree(p: blocks.Tile, q: blocks.Tile):
        """Pairs that agree enough by place, with one frame to spare for one of the same detection that lies apart."""
        count, shared = blocks.agreeing(p, q, near), blocks.common(p, q)
        i, j = np.nonzero((shared >= overlap) & (count >= overlap - 1) & (count * 2 >= shared - 2))
        return i, j, {"Common": shared[i, j], "_near": count[i, j].astype(np.int64)}

    met = blocks.compare(a.drop("AD"), None, agree, "Common long, _near long")
    counted = met.join(same, ["AID", "BID"], "left").fillna(0, ["SameID", "_far"]).withColumn("Agreeing", F.col("_near") + F.col("_far")).where("SameID < 2")
    apart = F.count_if(pairs.distance("AX", "AY", "BX", "BY") <= near)
    strong = same.where("SameID >= 2").join(a, "AID").join(b.select(FRAME, "BID", "BX", "BY"), ["BID", FRAME]).groupBy("AID", "BID", "SameID", "_far").agg(F.count("*").alias("Common"), apart.alias("_near"))
    strong = strong.withColumn("Agreeing", F.col("_near") + F.col("_far")).where((F.col("Common") >= overlap) & (F.col("Agreeing") >= half))
    usual = counted.where((F.col("Agreeing") >= overlap) & (F.col("Agreeing") >= F.col("Common") / 2))
    cols = ["AID", "BID", "Common", "Agreeing", "SameID"]
    return usual.select(*cols).unionByName(strong.select(*cols))


_MERGED = "_a long, _piece int, FrameID long, X double, Y double, Theta double, State string, DetectionID long, DetectionConfidence double"


def _merge_two(near: float, least: int):
    """Tracks from the frames of a pair: one main track that each frame continues, and what neither frame could."""
    jump = 5 * near

    def merge(frames):
        import pandas as pd

        done, main, left = [], [], {"a": [], "b": []}

        def reach(row, limit):
            last = main[-1] if main else None
            if last is None or row["X"] is None or row["X"] != row["X"] or last["X"] != last["X"]:
                return 0.0
            far = ((row["X"] - last["X"]) ** 2 + (row["Y"] - last["Y"]) ** 2) ** 0.5
            return far if far <= limit else None

        def add(row, limit):
            if reach(row, limit) is None:
                close()
            main.append(row)

        def close():
            if len(main) >= least:
                done.append(list(main))
            main.clear()

        for r in frames.sort_values("FrameID").itertuples(index=False):
            one, two, both = r.a, r.b, r.both
            if both is not None:
                if r.same:
                    main.append(both)
                else:
                    add(both, jump)
            elif one is None or two is None:
                add(one if two is None else two, jump)
            elif (one["State"] == "active") != (two["State"] == "active"):
                add(one if one["State"] == "active" else two, 2 * jump)
            else:
                d1, d2 = reach(one, 2 * jump), reach(two, 2 * jump)
                if d1 is None and d2 is None:
                    close()
                    left["a"].append(one)
                    left["b"].append(two)
                elif d2 is None or (d1 is not None and d1 <= d2):
                    main.append(one)
                    left["b"].append(two)
                else:
                    main.append(two)
                    left["a"].append(one)
        close()
        for rows in left.values():
            for row in rows:
                add(row, jump)
            close()
        out = [(int(frames["AID"].iloc[0]), k, *(row[c] for c in ("FrameID", "X", "Y", "Theta", "State", "DetectionID", "DetectionConfidence"))) for k, rows in enumerate(done) for row in rows]
        return pd.DataFrame(out, columns=["_a", "_piece", "FrameID", "X", "Y", "Theta", "State", "DetectionID", "DetectionConfidence"])

    return merge


def merge_agreeing(rows: DataFrame, near: float, overlap: int, least: int) -> DataFrame:
    """Merge tracks of one set that overlap and agree, pair by pair in id order, until no pair does.

    Frames that agree merge to their mean; others continue the main track if they are near its last place,
    else they stand in tracks of their own; pieces of fewer than ``least`` rows go. Each pair is merged by
    one task, which holds the rows of two tracks. Rounds go on while the table changes; RuntimeError if one comes back.
    """
    pairs.ensure_checkpoints(rows.sparkSession)
    cols = [FRAME, "X", "Y", "Theta", "State", "DetectionID", "DetectionConfidence"]
    seen = set()
    while True:
        found = agreeing_pairs(rows, near, overlap).withColumn("score", F.lit(0))
        chosen = pairs.greedy_matches(found, "AID", "BID", "score", one_set=True).select("AID", "BID").checkpoint()
        if chosen.isEmpty():
            return rows
        last = seq.last_per_frame(rows).where("X is not null and Y is not null")
        a = last.join(chosen, last[TRACK] == chosen["AID"]).select("AID", FRAME, F.struct(*cols).alias("a"))
        b = last.join(chosen, last[TRACK] == chosen["BID"]).select("AID", FRAME, F.struct(*cols).alias("b"))
        same = F.coalesce(F.col("a.DetectionID") == F.col("b.DetectionID"), F.lit(False))
        agree = same | (pairs.distance("a.X", "a.Y", "b.X", "b.Y") <= near)
        mean = F.struct(F.col(FRAME), "_m.X", "_m.Y", "_m.Theta", "_m.State", "_m.DetectionID", "_m.DetectionConfidence")
        both = a.join(b, ["AID", FRAME], "full").withColumn("_m", _consensus()).select("AID", FRAME, "a", "b", F.when(agree, mean).alias("both"), F.coalesce(same, F.lit(False)).alias("same"))
        merged = both.groupBy("AID").applyInPandas(_merge_two(near, least), _MERGED)
        ends = chosen.select(F.explode(F.array("AID", "BID")).alias(TRACK))
        rest = rows.join(ends, TRACK, "left_anti").select(F.col(TRACK).alias("_a"), F.lit(0).alias("_piece"), *cols)
        whole = rest.unionByName(merged).checkpoint()
        rows = seq.renumber(whole, ["_a", "_piece"], TRACK).select(TRACK, *cols).checkpoint()
        state = tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64(TRACK, *cols)), F.sum(F.xxhash64(FRAME, TRACK, "X", "Y").cast("decimal(38,0)"))).first())
        if state in seen:
            raise RuntimeError("merging comes back to an earlier table")
        seen.add(state)


def stitch(rows: DataFrame, max_gap: int = 3, near: float = 30.0) -> DataFrame:
    """Join fragments end to start, nearest first, one successor and one predecessor each, until nothing joins.

    A round joins whole chains of fragments: every one takes the id of its chain's head.
    """
    pairs.ensure_checkpoints(rows.sparkSession)
    while True:
        links = pairs.stitch_links(pairs.track_spans(rows), max_gap, near)
        best = pairs.greedy_matches(links.withColumn("score", -F.col("Distance")), "SourceID", "TargetID", "score").select(F.col("SourceID").alias("source"), F.col("TargetID").alias("target")).checkpoint()
        if best.isEmpty():
            return rows
        heads = graphs.chain_heads(best).select(F.col("node").alias(TRACK), "head")
        rows = rows.join(heads, TRACK, "left").withColumn(TRACK, F.coalesce("head", TRACK)).drop("head").checkpoint()


def _long_enough(rows: DataFrame, least: int) -> DataFrame:
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(TRACK))).where(F.col("_n") >= least).drop("_n")


def resolve(forward: DataFrame, backward: DataFrame, near: float = 15.0, overlap: int = 5, least: int = 5) -> DataFrame:
    """One set of tracks from a forward and a backward pass.

    Candidates, greedy one-to-one matches, pairwise merge with unmatched tracks of both sides kept, removal
    of redundant tracks, merge of those that overlap and agree, stitching over gaps of three frames within
    twice the distance, removal again; then short tracks go, edges are trimmed and ids are dense. If one
    pass has no tracks the other's are returned, trimmed, with their ids.
    """
    pairs.ensure_checkpoints(forward.sparkSession)
    cols = [TRACK, FRAME, "X", "Y", "Theta", "State", "DetectionID", "DetectionConfidence"]
    forward, backward = (seq.trim_edges(seq.hide_occluded(_long_enough(x.select(*cols), least)), least).checkpoint() for x in (forward, backward))
    for one, other in ((forward, backward), (backward, forward)):
        if one.isEmpty():
            return other
    matches = pairs.match_tracks(forward, backward, near, overlap).checkpoint()
    merged = merge_pairs(forward, backward, matches, near).select(F.struct(F.lit(0).alias("k"), TRACK, F.col("_block").alias("b"), F.col("_side").alias("s")).alias("_key"), *cols[1:])
    alone = lambda rows, side, k: rows.join(matches.select(F.col(side).alias(TRACK)), TRACK, "left_anti").select(F.struct(F.lit(k).alias("k"), TRACK, F.lit(0).cast("long").alias("b"), F.lit(0).alias("s")).alias("_key"), *cols[1:])
    union = merged.unionByName(alone(forward, "AID", 1)).unionByName(alone(backward, "BID", 2))
    flat = union.select("_key.*", *cols[1:])
    numbered = seq.renumber(flat, ["k", TRACK, "b", "s"], "_new").select(F.col("_new").alias(TRACK), *cols[1:]).checkpoint()
    kept = drop_redundant(numbered, near).checkpoint()
    agreed = merge_agreeing(kept, near, overlap, least)
    joined = stitch(agreed, 3, 2 * near)
    once = drop_redundant(seq.first_per_frame(joined), near)
    return relabel(seq.trim_edges(_long_enough(once, least), least), [])
