"""Relabelling and mutation of trajectory tables, and the keyed label catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import graphs
from trackmill.operators.sequences import FRAME, TRACK

OFFSET = 100_000


def split_and_swap(rows: DataFrame, a: int, b: int, frame: int) -> DataFrame:
    """From ``frame`` on a's rows become b + OFFSET and b's become a + OFFSET."""
    late = F.col(FRAME) >= frame
    return rows.withColumn(TRACK, F.when(late & (F.col(TRACK) == a), F.lit(b + OFFSET)).when(late & (F.col(TRACK) == b), F.lit(a + OFFSET)).otherwise(F.col(TRACK)).cast("long"))


def merge_tracks(rows: DataFrame, ids: list[int]) -> DataFrame:
    """All of ``ids`` become the least of them."""
    return rows.withColumn(TRACK, F.when(F.col(TRACK).isin(ids), F.lit(min(ids))).otherwise(F.col(TRACK)).cast("long"))


def swap_merge(rows: DataFrame, source: int, target: int, frame: int) -> DataFrame:
    """The source's rows from ``frame`` on go; the target's become the source's."""
    late = F.col(FRAME) >= frame
    kept = rows.where(~(late & (F.col(TRACK) == source)))
    return kept.withColumn(TRACK, F.when(late & (F.col(TRACK) == target), F.lit(source)).otherwise(F.col(TRACK)).cast("long"))


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Deletes, then reassignments, each against the ids as they were, so that chains don't collide.

    ``edits(Op, ID, F0, F1, NewID, Rank)``, inclusive frames. Of several reassignments that hold a row the
    one with the greatest Rank wins. Edits join on the id first, so nothing is compared with all edits.
    """
    hit = (F.col(TRACK) == F.col("ID")) & F.col(FRAME).between(F.col("F0"), F.col("F1"))
    kept = rows.join(edits.where("Op = 'DELETE'").select("ID", "F0", "F1"), hit, "left_anti")
    moves = kept.select(TRACK, FRAME).distinct().join(edits.where("Op = 'REASSIGN'"), hit).groupBy(TRACK, FRAME).agg(F.max_by("NewID", "Rank").alias("_new"))
    return kept.join(moves, [TRACK, FRAME], "left").withColumn(TRACK, F.coalesce("_new", TRACK).cast("long")).drop("_new")


def clipped_expansion(frames: DataFrame, total: int) -> DataFrame:
    """Each frame with its neighbours, inside [0, total), once."""
    near = frames.select(F.explode(F.array(F.col(FRAME) - 1, F.col(FRAME), F.col(FRAME) + 1)).alias(FRAME))
    return near.where(F.col(FRAME).between(0, total - 1)).distinct()


def insert_or_ignore(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """table with the rows of new whose key it lacks; of new rows that share a key the first stays."""
    first = new.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rank = 1").drop("_rank")
    return table.unionByName(first.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def update_labels(table: DataFrame, updates: DataFrame, key: str, label: str, verified: str) -> DataFrame:
    """New labels by key; a row whose label was set must be reviewed again."""
    found = updates.select(key, F.col(label).alias("_label"), F.lit(True).alias("_set"))
    joined = table.join(found, key, "left")
    changed = F.coalesce("_set", F.lit(False))
    return joined.withColumns({label: F.when(changed, F.col("_label")).otherwise(F.col(label)), verified: F.when(changed, False).otherwise(F.col(verified))}).drop("_label", "_set")


def delete_prefix(table: DataFrame, column: str, prefix: str) -> DataFrame:
    return table.where(~F.col(column).startswith(prefix))


def sanitize(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def detection_number(frame: Column, index: Column) -> Column:
    """frame * 10000 + index."""
    return (frame * 10_000 + index).cast("long")


def synthetic_number(frame: Column, track: Column, index: Column) -> Column:
    """A negative id for a row that no detection made."""
    return -(frame * 1_000_000_000 + track * 1000 + F.greatest(index, F.lit(0)) + 1).cast("long")


def standing(log: DataFrame) -> DataFrame:
    """The edits of log(Session, Seq, Op, ...) that stand: each undo takes back the last one that still did, if there is one.

    An edit stands at the depth that it and what stood before it make, and falls when the depth goes below that later.
    Of a log, not of what it is applied to; so it should hold accepted edits only.
    """
    so_far = Window.partitionBy("Session").orderBy("Seq")
    run = F.sum(F.when(F.col("Op") == "undo", -1).otherwise(1)).over(so_far)
    deep = log.withColumn("_run", run).withColumn("_depth", F.col("_run") - F.least(F.lit(0), F.min("_run").over(so_far)))
    backwards = Window.partitionBy("Session").orderBy(F.desc("Seq")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.min("_depth").over(backwards)
    return deep.withColumn("_later", later).where((F.col("Op") != "undo") & (F.col("_later").isNull() | (F.col("_later") >= F.col("_depth")))).select(*log.columns)


def replay(lanes: DataFrame, log: DataFrame) -> DataFrame:
    """lanes(Session, FragID, TrackID, F0, F1) after a log of edits, with Deleted: any number for a fragment, undone ones left out.

    log(Session, Seq, Op, FragID, At, ToID): split cuts before frame At, and the later part is a new fragment; delete marks;
    reassign moves to ToID; undo takes back the last edit that stands. New ids follow the session's greatest, in the order of
    all splits in the log, undone ones included, as an editor gives them. An edit that doesn't fit any more (a split outside
    the fragment, anything after its delete) changes nothing. Each round settles all fragments of one generation of
    splits with running values over their edits, so rounds are as many as splits are nested.
    """
    graphs.ensure_checkpoints(lanes.sparkSession)
    top = lanes.groupBy("Session").agg(F.max("FragID").alias("_top"))
    numbers = log.where("Op = 'split'").select("Session", "Seq", F.row_number().over(Window.partitionBy("Session").orderBy("Seq")).alias("_nth"))
    edits = standing(log).join(numbers.join(top, "Session").select("Session", "Seq", (F.col("_top") + F.col("_nth")).alias("NewID")), ["Session", "Seq"], "left").checkpoint()
    now, done = lanes.select("Session", "FragID", "TrackID", "F0", "F1"), None
    by = Window.partitionBy("Session", "FragID").orderBy("Seq")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    while not now.isEmpty():
        met = now.join(edits.drop("TrackID"), ["Session", "FragID"]).withColumn("_gone", F.max(F.col("Op") == "delete").over(earlier)).where(~F.coalesce("_gone", F.lit(False)))
        cut = F.when((F.col("Op") == "split") & (F.col("At") > F.col("F0")), F.col("At") - 1)
        met = met.withColumn("_cut", cut).withColumn("_end", F.least("F1", F.min("_cut").over(earlier))).withColumn("_track", F.coalesce(F.last(F.when(F.col("Op") == "reassign", F.col("ToID")), True).over(earlier), "TrackID")).checkpoint()
        after = met.groupBy("Session", "FragID").agg(F.min("_cut").alias("_cut"), F.max_by(F.when(F.col("Op") == "reassign", F.col("ToID")), F.when(F.col("Op") == "reassign", F.col("Seq"))).alias("_to"), F.max(F.col("Op") == "delete").alias("_deleted"))
        settled = now.join(after, ["Session", "FragID"], "left").select("Session", "FragID", F.coalesce("_to", "TrackID").alias("TrackID"), "F0", F.least("F1", "_cut").alias("F1"), F.coalesce("_deleted", F.lit(False)).alias("Deleted"))
        done = settled if done is None else done.unionByName(settled)
        now = met.where("_cut is not null and _cut < _end").select("Session", F.col("NewID").alias("FragID"), F.col("_track").alias("TrackID"), F.col("At").alias("F0"), F.col("_end").alias("F1"))
    return lanes.select("Session", "FragID", "TrackID", "F0", "F1", F.lit(False).alias("Deleted")) if done is None else done
