"""Dataset curation: duplicates by hash, sampling, ranking and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import graphs, metric
from trackmill.operators.graphs import ensure_checkpoints


def exact_groups(rows: DataFrame, signature: str, order: str) -> DataFrame:
    """(signature, KeptID, Count) of every signature; the first row in order is kept."""
    return rows.groupBy(signature).agg(F.min(order).alias("KeptID"), F.count("*").alias("Count"))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """A 64-bit signature: the signs of the vector's first values."""
    places = F.transform(F.slice(vector, 1, bits), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming_pairs(rows: DataFrame, id_column: str, signature: str, radius: int, bits: int = 64, copies: bool = True) -> DataFrame:
    """(AID, BID, Distance), AID < BID, within ``radius`` of ``bits`` bits.

    The signature falls into radius + 1 bands, of which two signatures in reach share one at least, so the
    pairs come from an equi-join on the bands. Rows of one signature meet those of others once, as their least id,
    and are joined back through it. Among themselves all pair; without ``copies`` each does with the least only.
    """
    width = -(-bits // (radius + 1))
    own = rows.select(F.col(id_column).alias("_id"), F.col(signature).alias("_s"))
    least = own.groupBy("_s").agg(F.min("_id").alias("_id"))
    cuts = [F.struct(F.lit(i).alias("band"), F.call_function("shiftrightunsigned", F.col("_s"), F.lit(i * width)).bitwiseAND(F.lit((1 << width) - 1)).alias("part")) for i in range(radius + 1) if i * width < bits]
    placed = least.select("_id", "_s", F.explode(F.array(*cuts)).alias("_c")).select("_id", "_s", "_c.*")
    a = placed.select("band", "part", F.col("_id").alias("_ai"), F.col("_s").alias("_a"))
    b = placed.select("band", "part", F.col("_id").alias("_bi"), F.col("_s").alias("_b"))
    both = a.join(b, ["band", "part"]).where("_ai < _bi").withColumn("Distance", F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))))
    near = both.where(F.col("Distance") <= radius).select("_a", "_b", "Distance").distinct()
    crossed = near.join(own.select(F.col("_id").alias("_x"), F.col("_s").alias("_a")), "_a").join(own.select(F.col("_id").alias("_y"), F.col("_s").alias("_b")), "_b").select(F.least("_x", "_y").alias("AID"), F.greatest("_x", "_y").alias("BID"), "Distance")
    firsts = (own if copies else least).select("_s", F.col("_id").alias("_first"))
    equal = own.join(firsts, "_s").where("_first < _id").select(F.col("_first").alias("AID"), F.col("_id").alias("BID"), F.lit(0).alias("Distance"))
    return crossed.unionAll(equal)


#: Pairs of a component that one task may decide in order.
LARGEST = 1_000_000


def keep_first(rows: DataFrame, id_column: str, pairs: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, KeptID): in id order a row is dropped if it pairs with a kept one, the least of which it is counted to.

    Of rows with equal signatures only the pair with the least needs to be given. Each round settles every
    undecided row whose smaller partners are all decided; rounds are cut from their lineage by checkpoint().
    The long chains that ``rounds`` rounds leave are decided in order, a component in a task; only components
    of more than LARGEST pairs go on in rounds until nothing is left.
    """
    ensure_checkpoints(rows.sparkSession)
    ids = rows.select(F.col(id_column).alias("id"))
    edges = pairs.select(F.col("BID").alias("id"), F.col("AID").alias("by"))
    free = ids.join(edges.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("KeptID"))
    decided = free.checkpoint()
    waiting, done = edges.checkpoint(), 0
    while not waiting.isEmpty():
        known = decided.select(F.col("id").alias("by"), (F.col("KeptID") == F.col("id")).alias("kept"))
        if done == rounds:
            #: Partners that are decided stay beside the row that waits for them, so that components fall apart there.
            state = waiting.join(known, "by", "left").withColumn("_by", F.when(F.col("kept").isNull(), F.col("by")).otherwise(F.col("id")))
            small, large = graphs.by_component(state, "id", "_by", LARGEST)
            new = small.groupBy("Group").applyInPandas(_in_order, decided.schema).checkpoint()
            decided = decided.unionAll(new).checkpoint()
            waiting = large.select("id", "by").checkpoint()
        else:
            state = waiting.join(known, "by", "left").groupBy("id").agg(F.min(F.when(F.col("kept"), F.col("by"))).alias("first"), F.min(F.when(F.col("kept").isNull(), F.col("by"))).alias("open"))
            ready = state.where("open is null or first < open").select("id", F.coalesce("first", "id").alias("KeptID"))
            new = ready.checkpoint()
            decided = decided.unionAll(new).checkpoint()
            waiting = waiting.join(new.select("id"), "id", "left_anti").checkpoint()
        done += 1
    return decided


def _in_order(edges):
    """(id, KeptID) of the waiting rows of one component; kept tells of partners that are decided already."""
    import pandas as pd

    kept = {by: bool(k) for by, k in zip(edges["by"], edges["kept"], strict=True) if k is not None and k == k}
    partners: dict = {}
    for i, by in zip(edges["id"], edges["by"], strict=True):
        partners.setdefault(i, []).append(by)
    out = []
    for i in sorted(partners):
        first = next((by for by in sorted(partners[i]) if kept.get(by, False)), None)
        kept[i] = first is None
        out.append((i, i if first is None else first))
    return pd.DataFrame(out, columns=["id", "KeptID"])


def every_nth_frame(rows: DataFrame, n: int, frame: str = "FrameID") -> DataFrame:
    """All rows of every n-th distinct frame."""
    frames = rows.select(frame).distinct().withColumn("_all", F.lit(0))
    kept = frames.withColumn("_rank", F.row_number().over(Window.partitionBy("_all").orderBy(frame))).where((F.col("_rank") - 1) % n == 0).select(frame)
    return rows.join(kept, frame, "left_semi")


def stratified_split(rows: DataFrame, id_column: str, label: str, share: float, seed: int = 7) -> DataFrame:
    """(id, label, Split): ``share`` of the rows to validation by largest remainder, at least one of each label to training.

    Base quota floor(n * share), never all; the rest of round(N * share) goes to the largest remainders, then
    the larger and the first label. Inside a label rows are drawn by a seeded hash of their id.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    exact = F.col("_n") * share
    quota = sizes.withColumns({"_base": F.least(F.floor(exact), F.col("_n") - 1), "_rest": exact - F.floor(exact)})
    ranked = quota.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), F.desc("_n"), label)))
    total = quota.agg((F.round(F.sum("_n") * share) - F.sum("_base")).alias("_extra"))
    final = ranked.crossJoin(F.broadcast(total)).select(label, (F.col("_base") + F.when((F.col("_rank") <= F.col("_extra")) & (F.col("_base") + 1 < F.col("_n")), 1).otherwise(0)).alias("_quota"))
    drawn = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))), id_column))
    return rows.select(id_column, label).withColumn("_draw", drawn).join(F.broadcast(final), label).select(id_column, label, F.when(F.col("_draw") <= F.col("_quota"), "val").otherwise("train").alias("Split"))


def top_uncertain(rows: DataFrame, score: Column, id_column: str, k: int) -> DataFrame:
    """The k rows of the highest score, ties by id."""
    return rows.withColumn("Score", score).orderBy(F.desc("Score"), id_column).limit(k)


def farthest_first(rows: DataFrame, id_column: str, vector: str, k: int, start: int) -> DataFrame:
    """(id, Pick): k rows, each the farthest (L2) from those picked before; ties to the least id.

    A running minimum of distances: one pass over the rows for each pick, one row to the driver each.
    """
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    own = rows.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    last = own.where(F.col("id") == start).first()
    picks = [(start, 0)]
    state = own.withColumn("far", F.lit(float("inf")))
    for i in range(1, k):
        if last is None:
            break
        point = F.array(*[F.lit(float(x)) for x in last["v"]])
        gap = F.sqrt(F.aggregate(F.zip_with("v", point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        state = state.withColumn("far", F.least("far", gap))
        if i % 8 == 0:
            state = state.checkpoint()
        last = state.orderBy(F.desc("far"), "id").first()
        if last is None or last["far"] == 0:
            break
        picks.append((last["id"], i))
    return spark.createDataFrame(picks, "id long, Pick int")


def capped_per_group(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """At most ``cap`` rows of each group in order; the cap is the operator."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= cap).drop("_rank")


def histogram_pairs(rows: DataFrame, id_column: str, histogram: str, limit: float) -> DataFrame:
    """(AID, BID, Distance), AID < BID, of histograms whose Bhattacharyya distance is at most ``limit``.

    The distance is the Euclidean one of the square roots of two normed histograms, over the root of two.
    """
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    roots = rows.select(F.col(id_column).alias("_id"), F.transform(histogram, lambda x: F.sqrt(F.when(total > 0, x / total).otherwise(0.0))).alias("_r"))
    far = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("Dot")))
    return metric.close_pairs(roots, limit * 2**0.5).select("AID", "BID", far.alias("Distance")).where(F.col("Distance") <= limit)


def unit(vector: Column) -> Column:
    """A vector of length one in the same direction; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def cosine_pairs(rows: DataFrame, id_column: str, vector: str, least: float) -> DataFrame:
    """(AID, BID, Similarity), AID < BID, of a cosine of at least ``least``: unit vectors at most the root of 2 - 2 * least apart."""
    points = rows.select(F.col(id_column).alias("_id"), unit(F.col(vector)).alias("_r"))
    return metric.close_pairs(points, (2 - 2 * least) ** 0.5 + 1e-9).select("AID", "BID", F.col("Dot").alias("Similarity")).where(F.col("Similarity") >= least)


def cosine_filter(rows: DataFrame, id_column: str, vector: str, least: float) -> DataFrame:
    """(id, KeptID): in id order a vector is dropped if its cosine with a kept one is at least ``least``."""
    return keep_first(rows, id_column, cosine_pairs(rows, id_column, vector, least))


def clusters(rows: DataFrame, id_column: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(id, Cluster, Distance to its centre) by distributed k-means with at most as many centres as rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rows.select(F.col(id_column), F.transform(vector, lambda x: x.cast("double")).alias("_p"))
    n = points.limit(k).count()
    if n < 2:
        return points.select(id_column, F.lit(0).alias("Cluster"), F.lit(0.0).alias("Distance"))
    model = KMeans(k=n, seed=seed, featuresCol="_f", predictionCol="Cluster").fit(points.withColumn("_f", array_to_vector("_p")))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(points.withColumn("_f", array_to_vector("_p")))
    gap = F.zip_with("_p", F.get(centres, F.col("Cluster")), lambda a, b: (a - b) * (a - b))
    return placed.select(id_column, "Cluster", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("Distance"))


def representatives(found: DataFrame, id_column: str) -> DataFrame:
    """(Cluster, id): of each of clusters the row nearest to its centre, ties by id."""
    return found.groupBy("Cluster").agg(F.min(F.struct("Distance", F.col(id_column).alias("i"))).alias("_m")).select("Cluster", F.col("_m.i").alias(id_column))
