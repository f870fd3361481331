"""Proper scores, calibration, multiple testing and clustered bootstrap as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ranks import ranged, running_before


def log_loss(y: Column, p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def auc(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Area under the curve by rank sums with average ranks: scores are counted by value first, and values are ranked in ranges."""
    v = df.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    ranked = running_before(v, keys, [p], "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    return ranked.groupBy(*keys).agg(((F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))


def scores(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """n, log loss, Brier score, accuracy (a tie predicts the other side), AUC and calibration error of the favourite by ``keys``."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    Y, P = F.col(y), F.col(p)
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(log_loss(Y, P)).alias("log_loss"), F.avg((P - Y) ** 2).alias("brier"), F.avg(((P > 0.5) == (Y == 1)).cast("double")).alias("accuracy"))
    fav = d.select(*keys, F.greatest(P, 1 - P).alias("f"), F.when(P >= 0.5, Y).otherwise(1 - Y).alias("w"))
    fav = fav.withColumn("bin", F.least(F.floor((F.col("f") - 0.5) * 2 * bins), F.lit(bins - 1)))
    ece = fav.groupBy(*keys, "bin").agg(F.count("*").alias("k"), F.avg("f").alias("f"), F.avg("w").alias("w")).groupBy(*keys).agg((F.sum(F.col("k") * F.abs(F.col("f") - F.col("w"))) / F.sum("k")).alias("ece"))
    return base.join(auc(d, keys, y, p), keys).join(ece, keys)


def q_values(df: DataFrame, p: str, name: str, blocks: int = 64) -> DataFrame:
    """Benjamini-Hochberg q-values over a table of hypotheses (one row each; ties in ``p`` in order of ``name``).

    Hypotheses are ranked inside ``blocks`` ranges of about as many rows each, however close their p-values lie, and ranges are counted; then
    the least of later ranges is carried over, so that no window holds more than a range or the ranges.
    """
    rows = ranged(df, [F.col(p).asc_nulls_last(), F.col(name)], blocks).withColumnRenamed("__range", "__b")
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    order = Window.orderBy("__b")
    sizes = sizes.select("__b", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    inside = Window.partitionBy("__b").orderBy(F.col(p).asc_nulls_last(), name)
    ranked = rows.join(F.broadcast(sizes), "__b").withColumn("rank", F.row_number().over(inside) + F.col("__before"))
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("m") / F.col("rank"))
    least = ranked.groupBy("__b").agg(F.min("__raw").alias("__least"))
    later = least.select("__b", F.min("__least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    back = inside.rowsBetween(0, Window.unboundedFollowing)
    q = F.least(F.min("__raw").over(back), F.col("__later"), F.lit(1.0))
    return ranked.join(F.broadcast(later), "__b").withColumn("q", q).drop("__b", "__before", "__raw", "__later")


def clustered_bootstrap(df: DataFrame, cluster: str, num: Column, den: Column, replicates: int, seed: int = 1) -> DataFrame:
    """replicate, value: ratio of sums over clusters that are drawn with Poisson(1) weights, which a hash of cluster and replicate gives.

    Clusters are summed first; each then meets the fixed number of replicates, and sums are combined before the shuffle.
    """
    c = df.groupBy(cluster).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    u = F.pmod(F.xxhash64(F.col(cluster), F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k + 1
    draws = c.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    return draws.groupBy("replicate").agg((F.sum(F.col("w") * F.col("num")) / F.sum(F.col("w") * F.col("den"))).alias("value"))


def class_rates(df: DataFrame, group: str, label: str, labels: list[str] | None = None, k: float = 20.0) -> DataFrame:
    """group, label, p for all of ``labels`` (default: all that occur): their shares in a group, shrunk with weight ``k`` to their shares over all rows."""
    cells = df.groupBy(group, label).agg(F.count("*").alias("__n"))
    sizes = cells.groupBy(group).agg(F.sum("__n").alias("__size"))
    total = cells.agg(F.sum("__n").alias("__all"))
    share = cells.groupBy(label).agg(F.sum("__n").alias("__of")).join(F.broadcast(total)).select(label, (F.col("__of") / F.col("__all")).alias("__share"))
    if labels is None:
        labels = sorted(x[0] for x in df.select(label).distinct().limit(1001).collect() if x[0] is not None)
        if len(labels) > 1000:
            raise ValueError("more than 1000 labels")
    grid = sizes.select(group, "__size", F.explode(F.array(*map(F.lit, labels))).alias(label)).join(share, label, "left").join(cells, [group, label], "left")
    none = F.lit(0.0)
    return grid.select(group, label, ((F.coalesce("__n", F.lit(0)) + k * F.coalesce("__share", none)) / (F.col("__size") + k)).alias("p"))
