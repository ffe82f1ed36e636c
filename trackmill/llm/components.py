"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round moves every node's neighbours to the least one it has seen. Minima come from
partially aggregated groupBys and the joins are plain equi-joins of two shuffled sides, so a
node with very many neighbours is split by AQE and never gathered in one task. The number of
rounds grows with the logarithm of the component's size, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import discard, settle


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots; root is the least node reachable.

    Edges with a null end and self loops are ignored; repeated edges count once. No edges: no rows.
    Raises RuntimeError if ``max_rounds`` rounds don't settle it.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now = settle(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc", free=False)
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        new = settle(_round(now), "cc", free=False)
        digest = _digest(new)
        discard(spark, now)
        now = new
        if digest == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = digest
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
    return row[0], row[1], row[2]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
    return small.where("hi != lo").distinct()
