"""Connected components and chains of edge tables, in rounds that grow with the logarithm of their size.

Every round is an aggregation and equi-joins over the edge table where it lies, cut from its lineage by checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoints(spark) -> None:
    """Use the session's shared folder. Without one a local folder serves a local master; a cluster needs its own named."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(a, b) that are not the least of their component.

    Alternates moving every node's larger neighbours, then its smaller ones, to the least one it has seen.
    """
    ensure_checkpoints(edges.sparkSession)
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct().checkpoint()
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.join(low, "node").where("root > node and root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        moved = large.join(least, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")), F.struct("node", F.col("low").alias("root")))).alias("e")).select("e.*")
        new = moved.where("node <> root").distinct().checkpoint()
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new
        now = new
    return now


def chain_heads(links: DataFrame) -> DataFrame:
    """(node, head, place) for every target of links(source, target), of which each node has one in and one out at most.

    place counts the links from the head. Pointers jump to their pointer's pointer, so chains of n links take log2(n)
    rounds; links that still move after that run in a circle, and raise ValueError with one of its nodes.
    """
    ensure_checkpoints(links.sparkSession)
    now = links.select(F.col("target").alias("node"), F.col("source").alias("head"), F.lit(1).cast("long").alias("place")).checkpoint()
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("node").alias("head"), F.col("head").alias("_far"), F.col("place").alias("_more"))
        new = now.join(ahead, "head", "left").select("node", F.coalesce("_far", "head").alias("head"), (F.col("place") + F.coalesce("_more", F.lit(0))).alias("place"), F.col("_far").isNotNull().alias("_moved")).checkpoint()
        now = new.drop("_moved")
        circle = new.where("_moved").select("node").first()
        if circle is None:
            return now
    raise ValueError(f"links run in a circle at {circle['node']}")


def by_component(edges: DataFrame, a: str, b: str, largest: int) -> tuple[DataFrame, DataFrame]:
    """edges with the component of their ends as Group: those of components of at most ``largest`` edges, and the rest."""
    roots = components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    named = edges.join(roots.select(F.col("node").alias(a), "root"), a, "left").withColumn("Group", F.coalesce("root", F.least(a, b))).drop("root")
    sizes = named.groupBy("Group").agg(F.count("*").alias("_n"))
    sized = named.join(sizes, "Group").checkpoint()
    return sized.where(F.col("_n") <= largest).drop("_n"), sized.where(F.col("_n") > largest).drop("_n", "Group")
