"""As-of, guarded, interval and near-date joins as equi-joins and windows: never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.tables import written


def asof(left: DataFrame, right: DataFrame, keys: list[str], when: str, value: Column, out: str, guard: int = 1) -> DataFrame:
    """``left`` plus ``out``: ``value`` of the latest ``right`` row of the same keys ``guard`` days before ``when`` or earlier.

    Both sides are put in one ordered stream by key; of several right rows on a day the greatest value counts.
    """
    r = right.groupBy(*keys, F.date_add(when, guard).alias(when)).agg(F.max(value).alias("__v")).select(*keys, when, F.struct("__v").alias("__r"), F.lit(0).alias("__o"), F.lit(None).alias("__l"))
    l = left.select(*keys, when, F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__o"), F.struct(*left.columns).alias("__l"))  # noqa: E741
    w = Window.partitionBy(*keys).orderBy(when, "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)).unionByName(l)
    return both.select("__l", F.last("__r", ignorenulls=True).over(w).alias("__r")).filter("__l IS NOT NULL").select("__l.*", F.col("__r.__v").alias(out))


def _tagged(left: DataFrame) -> DataFrame:
    """Different left rows as one struct, with how often each occurs: joins then neither lose nor merge repeated rows, and null keys stay."""
    return left.groupBy(F.struct(*left.columns).alias("__row")).agg(F.count("*").alias("__times"))


def _again(df: DataFrame, *out: str) -> DataFrame:
    """The rows behind ``_tagged``, each as often as it occurred."""
    return df.select("__row", *out, F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__k")).select("__row.*", *out)


def interval(left: DataFrame, right: DataFrame, keys: list[str], when: str, days: int, last: int, aggs: list[Column], bucket: int = 30) -> DataFrame:
    """``left`` plus ``aggs`` over ``right`` rows from ``days`` to ``last`` days before ``when``: an equi-join on day buckets.

    Repeated left rows get the same values each; where a key or ``when`` is null, nothing matches.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    rows = _tagged(left)
    n = day(F.col(f"__row.{when}"))
    l = rows.select("__row", n.alias("__n"), F.explode(F.sequence(F.floor((n - days) / bucket), F.floor((n - last) / bucket))).alias("__b"), *(F.col(f"__row.{k}").alias(k) for k in keys))  # noqa: E741
    r = right.withColumns({"__b": F.floor(day(F.col(when)) / bucket), "__m": day(F.col(when))}).drop(when)
    hit = l.join(r, [*keys, "__b"]).filter(F.col("__m").between(F.col("__n") - days, F.col("__n") - last)).groupBy("__row").agg(*aggs)
    out = [c for c in hit.columns if c != "__row"]
    found = hit.withColumnRenamed("__row", "__hit")
    return _again(rows.join(found, F.col("__row").eqNullSafe(F.col("__hit")), "left"), *out)


def near_date(left: DataFrame, right: DataFrame, keys: list[str], when: str, offsets: list[int], value: str, out: str) -> DataFrame:
    """``left`` plus ``out``: ``value`` of the right row on the first of the ``offsets`` (in days) that has one; of several there the least."""
    rows = _tagged(left)
    l = rows.select("*", *(F.col(f"__row.{k}").alias(k) for k in keys), F.posexplode(F.array(*(F.date_add(F.col(f"__row.{when}"), o) for o in offsets))).alias("__p", "__d"))  # noqa: E741
    r = right.select(*keys, F.col(when).alias("__d"), F.col(value).alias("__v"))
    hit = l.join(r, [*keys, "__d"], "left")
    best = hit.groupBy("__row", "__times").agg(F.min(F.when(F.col("__v").isNotNull(), F.struct("__p", "__v"))).alias("__best"))
    return _again(best.withColumn(out, F.col("__best.__v")), out)


def upsert(old: DataFrame, new: DataFrame, page: str, key: list[str], order: Column) -> DataFrame:
    """Rows of ``old`` on pages that ``new`` doesn't bring, and ``new`` without repeated keys (the last in ``order`` stays)."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    latest = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return old.join(new.select(page).distinct(), page, "left_anti").unionByName(latest, allowMissingColumns=True)


def frontier(edges: DataFrame, seeds: DataFrame, source: str, target: str, rounds: int | None = None) -> DataFrame:
    """node, depth: what is reached from ``seeds`` (column node) by the least number of steps, in at most ``rounds`` (None: until a round adds none).

    Each round joins only the nodes that the round before added and drops known ones; written tables cut lineage between rounds.
    """
    steps = written(edges.select(F.col(source).alias("node"), F.col(target).alias("__next")).distinct())
    seen = last = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    n = 0
    while rounds is None or n < rounds:
        n += 1
        last = written(last.join(steps, "node").select(F.col("__next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(n)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen
