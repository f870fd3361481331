"""Feature blocks: outcome flags and targets, histories before a day with a guard, matchup products, selection by name and assembly."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.prior import shrunk

#: Methods of a result by group; fixed values.
KNOCKOUT, SUBMISSION, DECISION = ["KO", "DOC"], ["SUB"], ["U-DEC", "S-DEC", "M-DEC"]
#: Formats whose rounds all last five minutes; fixed values.
STANDARD = ["3 Rnd (5-5-5)", "5 Rnd (5-5-5-5-5)"]


def outcome_flags(res: Column, method: Column) -> dict[str, Column]:
    """Flags of a side as doubles: what isn't known counts as no."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    groups = {"ko": method.isin(KNOCKOUT), "sub": method.isin(SUBMISSION), "dec": method.isin(DECISION), "split": method == "S-DEC"}
    ways = {f"{g}_{w}": flag((res == v) & c) for g, c in groups.items() for w, v in (("win", 1), ("loss", 0))}
    return {"win": flag(res == 1), "loss": flag(res == 0)} | ways | {"went_dist": flag(groups["dec"]), "finish": flag(groups["ko"] | groups["sub"])}


def decision_margin(res: Column, method: Column, margin: Column) -> Column:
    """The judges' margin (of the winner over the loser) from the side's own view; null unless a decision has a winner."""
    return F.when(method.isin(DECISION) & (res == 1), margin).when(method.isin(DECISION) & (res == 0), -margin)


def targets(method: Column, y: Column, time_format: Column, sched_rounds: Column, secs: Column, unders: int = 4, round_secs: int = 300) -> dict[str, Column]:
    """itd (ended inside the distance), meth3 (KO, SUB or DEC) and under_k (ended in the first half of round k + 1 or before): null outside
    standard formats, and for methods of no group."""
    groups = {m: g for g, ms in (("KO", KNOCKOUT), ("SUB", SUBMISSION), ("DEC", DECISION), ("void", ["DQ"])) for m in ms}
    group = F.when(time_format.isin(STANDARD), F.try_element_at(F.create_map(*(F.lit(x) for pair in groups.items() for x in pair)), method))
    inside = group != "DEC"
    halfway = {k: (k + 0.5) * round_secs for k in range(1, unders + 1)}
    before = {f"under_{k}": F.when(sched_rounds > k, (inside & (secs < end)).cast("double")) for k, end in halfway.items()}
    return {"itd": inside.cast("double"), "meth3": F.when(y.isNotNull() & (group != "void"), group)} | {n: F.when(group.isNotNull(), c) for n, c in before.items()}


def soft_label(y: Column, method: Column, q: float = 0.7) -> Column:
    """Results that could as well have gone the other way count for ``q`` (split decisions, disqualifications) or halfway to one (majority decisions)."""
    weight = F.when(method.isin("S-DEC", "DQ"), q).when(method == "M-DEC", (1 + q) / 2).otherwise(1.0)
    return F.when(y == 1, weight).when(y == 0, 1 - weight).otherwise(y)


def history(rows: DataFrame, events: DataFrame, keys: list[str], day: str, aggs: dict[str, Callable[[object], Column]], guard: int = 1) -> DataFrame:
    """``rows`` plus aggregates over ``events`` of the same keys that lie ``guard`` days before or earlier.

    Each of ``aggs`` gets the window and may use columns of ``events``. Both tables go through one window, so that events need not be
    the rows' own table. Columns that both have, other than keys and day, belong to the events.
    """
    mine = rows.select(*keys, day, F.struct(*rows.columns).alias("__row"))
    theirs = events.select(*keys, day, F.struct(*(c for c in events.columns)).alias("__event"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -guard)
    wide = both.select("__row", *keys, day, *(F.col(f"__event.{c}").alias(c) for c in events.columns if c not in (*keys, day)))
    found = wide.select("__row", *(make(w).alias(n) for n, make in aggs.items()))
    return found.filter("__row IS NOT NULL").select("__row.*", *aggs)


def states(events: DataFrame, keys: list[str], day: str, order: list[str], res: str, last: int = 5) -> DataFrame:
    """The events of known result plus ``state`` (number, streak, mean of the last results, last result) after each."""
    o = Window.partitionBy(*keys).orderBy(day, *order)
    k = events.filter(F.col(res).isNotNull()).withColumns({"__i": F.row_number().over(o), "__mean": F.avg(res).over(o.rowsBetween(1 - last, 0))})
    upto = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    broken = lambda v: F.coalesce(F.max(F.when(F.col(res) != v, F.col("__i"))).over(upto), F.lit(0))
    run = F.when(F.col(res) == 1, F.col("__i") - broken(1)).when(F.col(res) == 0, broken(0) - F.col("__i")).otherwise(0)
    return k.withColumn("state", F.struct(F.col("__i").alias("i"), run.alias("streak"), F.col("__mean").alias("mean"), F.col(res).alias("last"))).drop("__i", "__mean")


def running(events: DataFrame, keys: list[str], day: str, order: list[str], res: str, last: int = 5) -> DataFrame:
    """keys, day and ``state`` after each day's known results: for ``history`` to pick the latest of."""
    return states(events, keys, day, order, res, last).groupBy(*keys, day).agg(F.max("state").alias("state"))


def weighted(value: Column, weight: Column, w, k: float) -> Column:
    """Weighted mean over a window, shrunk to zero by a weight of ``k``; rows without a value don't count."""
    known = value.isNotNull() & (weight > 0)
    return shrunk(F.sum(F.when(known, value * weight)).over(w), F.sum(F.when(known, weight)).over(w), 0.0, k)


def late_ratio(early_rate: Column, early_secs: Column, rate: Column, secs: Column, w, least: float = 60.0) -> Column:
    """Output of late rounds against first rounds, both weighted by time and raised by one; contests with ``least`` seconds of late rounds or fewer don't count."""
    known = rate.isNotNull() & early_rate.isNotNull() & (secs > least)
    mean = lambda r, s: F.sum(F.when(known, r * s)).over(w) / F.sum(F.when(known, s)).over(w)
    return (mean(rate, secs) + 1) / (mean(early_rate, early_secs) + 1)


def versus(df: DataFrame, products: dict[str, Callable[[str, str], Column]]) -> DataFrame:
    """Products of a's strength and b's weakness less the reverse, as halves ``a_`` and ``b_``: each function gets the prefixes of the two sides."""
    gaps = {n: f("a_", "b_") - f("b_", "a_") for n, f in products.items()}
    return df.withColumns({s + n: (g if s == "a_" else -g) / 2 for n, g in gaps.items() for s in ("a_", "b_")})


def selected(df: DataFrame, patterns: list[str], paired: bool = False) -> list[str]:
    """Numeric columns whose names match a pattern, in order; ``paired``: names without a side that both sides have."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if paired:
        numeric = [c[2:] for c in numeric if c.startswith("a_") and "b_" + c[2:] in numeric]
    return [c for c in numeric if any(re.search(p, c) for p in patterns)]


def assembled(blocks: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of feature blocks on their key; a row that only some blocks have keeps nulls for the others."""
    return reduce(lambda a, b: a.join(b, key, "full"), blocks)
