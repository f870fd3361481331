"""Strictly-prior frames: what was known about an entity before a date. All rows of that date are left out, whatever their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

HALF_LIFE = 548.0
EPOCH = 9131  # 1995-01-01: keeps decay powers near one


def day(date: Column | str) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date"))


def before(keys: list[str], day_column: str = "day", days: int | None = None, guard: int = 1) -> WindowSpec:
    """Rows of ``keys`` dated ``guard`` days before or earlier, at most ``days`` back."""
    return Window.partitionBy(*keys).orderBy(day_column).rangeBetween(Window.unboundedPreceding if days is None else -days, -guard)


def decayed(value: Column, weight_day: str, w: WindowSpec, half_life: float = HALF_LIFE) -> Column:
    """Sum over ``w`` with weight 0.5**(age / half_life), as one window sum: weights factor into a row's and the frame's part."""
    up = F.pow(F.lit(2.0), (F.col(weight_day) - EPOCH) / half_life)
    return F.sum(value * up).over(w) / up


def shrunk(num: Column, den: Column, prior: Column | float, k: float) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (F.coalesce(num, F.lit(0.0)) + prior * k) / (F.coalesce(den, F.lit(0.0)) + k)


def daily_prior(df: DataFrame, day_column: str, sums: dict[str, Column], parts: int = 64) -> DataFrame:
    """For each day the ``sums`` over all earlier days.

    Rows are summed by day first, days by blocks of ``parts`` days; earlier blocks and earlier days of a block are then added, so that
    no task orders more than the number of blocks.
    """
    days = df.groupBy(day_column).agg(*(c.alias(n) for n, c in sums.items())).withColumn("__block", F.floor(F.col(day_column) / parts))
    inside = Window.partitionBy("__block").orderBy(day_column).rowsBetween(Window.unboundedPreceding, -1)
    blocks = days.groupBy("__block").agg(*(F.sum(n).alias("__" + n) for n in sums))
    over = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select("__block", *(F.coalesce(F.sum("__" + n).over(over), F.lit(0)).alias("__" + n) for n in sums))
    return days.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}).join(earlier, "__block").select(day_column, *((F.col(n) + F.col("__" + n)).alias(n) for n in sums))


def streak(results: Column) -> Column:
    """Signed run at the end of an array of results (1 win, 0 loss, 0.5 draw; null: skipped); a draw ends it."""
    known = F.reverse(F.filter(results, lambda r: r.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda a, r: F.struct(
        F.when(a["on"] & (r == 1) & (a["n"] >= 0), a["n"] + 1).when(a["on"] & (r == 0) & (a["n"] <= 0), a["n"] - 1).otherwise(a["n"]).alias("n"),
        (a["on"] & (((r == 1) & (a["n"] >= 0)) | ((r == 0) & (a["n"] <= 0)))).alias("on"),
    )
    return F.aggregate(known, start, step)["n"]


def trailing_mean(df: DataFrame, keys: list[str], day_column: str, value: Column, days: int, k: float, start: float) -> DataFrame:
    """For each of ``keys`` and day the mean of ``value`` over the ``days`` before, shrunk to ``start`` with weight ``k``. Rows are summed by day first."""
    daily = df.groupBy(*keys, day_column).agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    w = before(keys, day_column, days)
    return daily.select(*keys, day_column, shrunk(F.sum("__sum").over(w), F.sum("__n").over(w).cast("double"), start, k).alias("strength"))
