"""Aggregations: robust means, class metrics, cluster statistics, motion metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import graphs
from trackmill.operators.sequences import FRAME, TRACK, in_order


def interquartile_mean(value: Column, low: Column, high: Column, least: int = 100) -> Column:
    """Mean of the values in [low, high]; null for ``least`` values or fewer."""
    return F.when(F.count(value) > least, F.avg(F.when((value >= low) & (value <= high), value)))


def robust_mean(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, RobustMean): mean between the quartiles if they hold over a tenth of the rows, else between the
    10th and 90th percentile, else plain."""
    cuts = rows.groupBy(*keys).agg(F.percentile(column, [0.1, 0.25, 0.75, 0.9]).alias("_c"))
    v, c = F.col(column), [F.get("_c", i) for i in range(4)]
    inner, outer = F.when(v.between(c[1], c[2]), v), F.when(v.between(c[0], c[3]), v)
    found = rows.join(cuts, keys).groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_all"), F.count(inner).alias("_ni"), F.avg(inner).alias("_i"), F.count(outer).alias("_no"), F.avg(outer).alias("_o"))
    return found.select(*keys, F.when(F.col("_ni") > 0.1 * F.col("_n"), F.col("_i")).when(F.col("_no") > 0.1 * F.col("_n"), F.col("_o")).otherwise(F.col("_all")).alias("RobustMean"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("Count"))


def class_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(Class, Support, Precision, Recall, F1) from one pass; a ratio over nothing is 0."""
    counts = confusion(rows, truth, guess)
    hit = F.when(F.col(truth) == F.col(guess), F.col("Count")).otherwise(0)
    both = counts.select(F.explode(F.array(F.struct(F.col(truth).alias("Class"), F.col("Count").alias("t"), F.lit(0).cast("long").alias("g"), hit.cast("long").alias("h")), F.struct(F.col(guess).alias("Class"), F.lit(0).cast("long").alias("t"), F.col("Count").alias("g"), F.lit(0).cast("long").alias("h")))).alias("e")).select("e.*")
    sums = both.groupBy("Class").agg(F.sum("t").alias("Support"), F.sum("g").alias("_g"), F.sum("h").alias("_h"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.withColumns({"Precision": ratio("_h", "_g"), "Recall": ratio("_h", "Support")})
    f1 = F.when(F.col("Precision") + F.col("Recall") > 0, 2 * F.col("Precision") * F.col("Recall") / (F.col("Precision") + F.col("Recall"))).otherwise(0.0)
    return out.withColumn("F1", f1).drop("_g", "_h")


def class_weights(rows: DataFrame, label: str, power: float = 1.0) -> DataFrame:
    """(label, Weight): (largest count / count) ** power, divided by the mean weight."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n").alias("_m"))
    raw = counts.crossJoin(F.broadcast(top)).withColumn("_w", F.pow(F.col("_m") / F.greatest("_n", F.lit(1)), F.lit(power)))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select(label, (F.col("_w") / F.col("_mean")).alias("Weight"))


def cluster_statistics(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, Size, Coverage, Purity): labelled share and the share of the most frequent label among labelled rows."""
    labelled = rows.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("_n")).groupBy(cluster).agg(F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("Size"))
    return sizes.join(labelled, cluster, "left").select(cluster, "Size", (F.coalesce("_all", F.lit(0)) / F.col("Size")).alias("Coverage"), F.coalesce(F.col("_top") / F.col("_all"), F.lit(0.0)).alias("Purity"))


def reversals(rows: DataFrame, body: float) -> DataFrame:
    """(track, Steps, Reversals, MeanStep): steps relative to the body, and turns by over about 107 degrees of two real steps."""
    dx, dy = F.col("X") - F.lag("X").over(in_order()), F.col("Y") - F.lag("Y").over(in_order())
    steps = rows.withColumns({"_dx": dx, "_dy": dy})
    steps = steps.withColumns({"_px": F.lag("_dx").over(in_order()), "_py": F.lag("_dy").over(in_order()), "_s": F.hypot("_dx", "_dy")})
    prior = F.hypot("_px", "_py")
    cosine = (F.col("_dx") * F.col("_px") + F.col("_dy") * F.col("_py")) / F.when(F.col("_s") * prior > 0, F.col("_s") * prior)
    turned = (cosine < -0.3) & (F.col("_s") > 0.2 * body) & (prior > 0.2 * body)
    return steps.groupBy(TRACK).agg(F.count("_s").alias("Steps"), F.sum(F.coalesce(turned.cast("long"), F.lit(0))).alias("Reversals"), (F.avg("_s") / body).alias("MeanStep"))


def rank_percentile(values: Column, share: float) -> Column:
    """Nearest rank: the sorted value at index int(n * share), clipped."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(share)), F.size(ordered) - 1).cast("int"))


def exponential_mean(rows: DataFrame, column: str, keys: list[str], order: list[str], alpha: float) -> DataFrame:
    """(keys, Ewma): exponentially weighted mean along the order, starting at the first value; ties by value.

    In closed form: each value has the weight that all later ones leave it. So ranks from the end are all that is needed.
    """
    backwards = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in [*order, column]])
    aged = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"), (F.row_number().over(backwards) - 1).alias("_age"), F.lead(F.lit(1)).over(backwards).isNull().alias("_first"))
    weight = F.pow(F.lit(1 - alpha), "_age") * F.when(F.col("_first"), 1.0).otherwise(alpha)
    return aged.groupBy(*keys).agg(F.sum(F.col("_v") * weight).alias("Ewma"))


def windowed_majority(rows: DataFrame, value: str, back: int, tie_is_null: bool = True) -> DataFrame:
    """The most frequent value of a track's last frames (from FrameID - back to FrameID); a tie is null, or the least value."""
    recent = F.collect_list(value).over(Window.partitionBy(TRACK).orderBy(FRAME).rangeBetween(-back, 0))
    out = rows.withColumn("_recent", recent)
    counted = F.transform(F.array_distinct("_recent"), lambda v: F.struct((-F.size(F.filter("_recent", lambda x: x == v))).alias("n"), v.alias("v")))
    ranked = out.withColumn("_ranked", F.array_sort(counted))
    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    best = F.when(~F.lit(tie_is_null) | second.isNull() | (first["n"] < second["n"]), first["v"])
    return ranked.withColumn("Majority", best).drop("_recent", "_ranked")


def crossing_score(distance_share: Column, proximity: Column, heading: Column, pose: Column, region: Column, boundary: Column) -> Column:
    """Weighted signals of a suspicious event, clipped to [0, 1]."""
    total = distance_share + 0.45 * proximity + 0.5 * heading + 0.3 * pose - 0.4 * region.cast("double") + 0.25 * boundary.cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def entropy(probabilities: Column) -> Column:
    """In nats, probabilities clipped at 1e-10."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.greatest(p, F.lit(1e-10)) * F.log(F.greatest(p, F.lit(1e-10))))


def margin(probabilities: Column) -> Column:
    """Difference of the two greatest."""
    ordered = F.sort_array(probabilities, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def fit_temperature(rows: DataFrame, logits: str, label: str, coolest: float = 0.1, hottest: float = 10.0, close: float = 1e-9) -> float:
    """The temperature inside [coolest, hottest] by which softmax(logits / T) gives the labels the greatest likelihood.

    The loss is convex in 1 / T, so Newton steps inside a bracket find it; each step is one aggregation of the
    first and second derivative, one row to the driver. Rows with a null, or a label that is no place in its logits, are left
    out; without rows it is 1. Logits that all say the same give no hold and 1 as well.
    """
    graphs.ensure_checkpoints(rows.sparkSession)
    z = F.transform(logits, lambda x: x.cast("double"))
    fine = F.col(label).isNotNull() & F.col(logits).isNotNull() & ~F.exists(logits, lambda x: x.isNull()) & (F.col(label) >= 0) & (F.col(label) < F.size(logits))
    known = rows.where(fine).select(z.alias("z"), F.get(z, F.col(label).cast("int")).alias("y")).checkpoint()

    def slopes(b: float) -> tuple[float, float]:
        top = F.array_max("z")
        w = known.select("y", "z", F.transform("z", lambda x: F.exp((x - top) * b)).alias("w"))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        first = total(F.zip_with("w", "z", lambda p, x: p * x)) / total(F.col("w"))
        second = total(F.zip_with("w", "z", lambda p, x: p * x * x)) / total(F.col("w"))
        found = w.select((first - F.col("y")).alias("g"), (second - first * first).alias("h")).agg(F.sum("g"), F.sum("h")).first()
        return found[0], found[1]

    if known.isEmpty():
        return 1.0
    lo, hi = 1 / hottest, 1 / coolest
    low, high = slopes(lo), slopes(hi)
    if low[0] == high[0] == 0:
        return 1.0
    if low[0] >= 0:
        return hottest
    if high[0] <= 0:
        return coolest
    b = 1.0
    while True:
        g, h = slopes(b)
        lo, hi = (b, hi) if g < 0 else (lo, b)
        new = b - g / h if h > 0 else (lo + hi) / 2
        new = new if lo < new < hi else (lo + hi) / 2
        if g == 0 or abs(new - b) <= close * b:
            return 1 / new
        b = new
