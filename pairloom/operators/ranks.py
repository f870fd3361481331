"""Running sums and ranks in an order that no single task holds.

Rows are dealt to ranges by splitters that Spark samples, each range is ordered by itself, and what the ranges before it hold is added,
which a table of a row for each range (and key) tells. So a key with most of the rows, or most rows in a narrow stretch of values, is
many ranges; only rows that are equal in the whole order share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.tables import written


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` plus ``__range``, which rises with ``order``; a written table, as sampled splitters differ from run to run."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))


def running_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before (nulls last; rows that tie come one by one)."""
    ascending = [F.col(c).asc_nulls_last() for c in order]
    r = ranged(df, [*map(F.col, keys), *ascending], parts)
    sums = r.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    on = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*ascending).rowsBetween(Window.unboundedPreceding, -1)
    own = r.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(base, on).select(*df.columns, (F.col("__own") + F.col("__base")).alias(out))
