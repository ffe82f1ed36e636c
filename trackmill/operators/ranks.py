"""Exact order statistics of groups of any size: values are counted, and ranks are running sums of the counts.

No task holds the values of a group. The range of values is cut at quantiles, so that even one group is summed by many
tasks; what is known of a group's parts is a row for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the range of values is cut into, about.
PARTS = 64


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, N, a column for each of ranks): values at places from 0 in the order of each group's N values, where a place is a function of N.

    Nulls are not counted; a group without values has no row, and a place outside the group gives null.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = counted.agg(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 1000)).first()[0] or []
    part = sum(((F.col("_v") >= c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    placed = counted.withColumn("_part", part)
    group = [F.struct(*keys).alias("_k")] if keys else [F.lit(0).alias("_k")]
    parts = placed.groupBy(*group, "_part").agg(F.sum("_n").alias("_t"))
    of_group = Window.partitionBy("_k")
    before = F.sum("_t").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    known = parts.select("_k", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_t").over(of_group).alias("N"))
    run = F.sum("_n").over(Window.partitionBy("_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    local = placed.select(*group, "_part", "_v", "_n").withColumn("_run", run).alias("l")
    met = local.join(known.alias("r"), F.col("l._k").eqNullSafe(F.col("r._k")) & (F.col("l._part") == F.col("r._part"))).select("l._k", "_v", "N", (F.col("_before") + F.col("_run") - F.col("_n")).alias("_from"), (F.col("_before") + F.col("_run")).alias("_to"))
    at = {name: place(F.col("N")) for name, place in ranks.items()}
    found = met.groupBy("_k").agg(F.max("N").alias("N"), *[F.max(F.when((i >= F.col("_from")) & (i < F.col("_to")), F.col("_v"))).alias(name) for name, i in at.items()])
    return found.select(*[F.col(f"_k.{k}") for k in keys], "N", *ranks)


def share(q: float) -> Callable[[Column], Column]:
    """The place int(n * q), at most the last."""
    return lambda n: F.least(F.floor(n * F.lit(q)), n - 1)


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, N, Median): the middle value, or the mean of the two."""
    found = at_ranks(rows, keys, value, {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)})
    return found.select(*keys, "N", ((F.col("_lo") + F.col("_hi")) / 2).alias("Median"))
