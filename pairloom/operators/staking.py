"""Prices, expected value, Kelly stakes, settlement and policies, as projections and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decimal_odds(american: Column) -> Column:
    return F.when(american > 0, 1 + american / 100).when(american < 0, 1 + 100 / -american)


def american_odds(decimal: Column) -> Column:
    return F.when(decimal >= 2, (decimal - 1) * 100).otherwise(-100 / (decimal - 1))


def logit(p: Column, clip: float = 1e-4) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.ln(q / (1 - q))


def kelly(p: Column, dec: Column, fraction: Column | float, most: Column | float, unit_pct: float = 1.0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(lit(fraction) * (100 / unit_pct) * (p * dec - 1) / (dec - 1), F.lit(0.0)), lit(most))


def simulate(df: DataFrame, p: str, a_dec: str, b_dec: str, y: str, edge: Column | float = 0.0, fraction: Column | float = 0.25, most: Column | float = 5.0, least: float = 0.0, flat: bool = False) -> DataFrame:
    """Bets: of each contest the side with the better expected value (tie: a), if it beats ``edge``. Null ``y``: stake returned; a draw (0.5) loses."""
    P, a, b, Y = F.col(p), F.col(a_dec), F.col(b_dec), F.col(y)
    known = df.filter(P.isNotNull() & a.isNotNull() & b.isNotNull())
    side_a = P * a - 1 >= (1 - P) * b - 1
    bet = known.withColumns({"side": F.when(side_a, F.lit("a")).otherwise(F.lit("b")), "bet_p": F.when(side_a, P).otherwise(1 - P), "price": F.when(side_a, a).otherwise(b)})
    bet = bet.withColumn("ev", F.col("bet_p") * F.col("price") - 1).withColumn("stake", F.lit(1.0) if flat else kelly(F.col("bet_p"), F.col("price"), fraction, most))
    edge = edge if isinstance(edge, Column) else F.lit(edge)
    won = F.when(F.col("side") == "a", Y == 1).otherwise(Y == 0)
    profit = F.when(Y.isNull(), 0.0).when(won, F.col("stake") * (F.col("price") - 1)).otherwise(-F.col("stake"))
    return bet.filter((F.col("ev") > edge) & (F.col("stake") > 0) & (F.col("stake") >= least)).withColumn("profit", profit)


def with_drawdown(df: DataFrame, profit: str, order: list[str], keys: list[str]) -> DataFrame:
    """``df`` plus ``total``, the running profit, and ``down``, how far it lies below its highest value so far (zero at least)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("total", F.sum(profit).over(w))
    return run.withColumn("down", F.greatest(F.max("total").over(w), F.lit(0.0)) - F.col("total"))


def summary(bets: DataFrame, keys: list[str], order: list[str], day: str = "day") -> DataFrame:
    """Bets, stakes, profit, return, hit rate, deepest drawdown, mean price and stake by ``keys``.

    The running total goes by day: bets of a day are ordered inside it, days are summed, and what the days before brought is added, so
    that no task orders more than a day's bets or the number of days.
    """
    inside = with_drawdown(bets.withColumn("__day", F.col(day)), "profit", order, [*keys, "__day"])
    # within a day: its sum, its highest total, its lowest total behind the highest, and how deep it falls below its own high
    w = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = inside.withColumn("__top", F.max("total").over(w))
    days = own.groupBy(*keys, "__day").agg(
        F.count("*").alias("n"), F.sum("stake").alias("staked"), F.sum("profit").alias("profit"), F.sum((F.col("profit") > 0).cast("double")).alias("hits"), F.sum("price").alias("prices"),
        F.max("total").alias("top"), F.min("total").alias("low"), F.max(F.col("__top") - F.col("total")).alias("fall"),
    )
    past = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    at = days.withColumn("__before", F.coalesce(F.sum("profit").over(past), F.lit(0.0)))
    at = at.withColumn("__high", F.greatest(F.max(F.col("__before") + F.col("top")).over(past), F.lit(0.0)))
    # the deepest point of a day lies below the high of earlier days, or below its own
    down = F.greatest(F.col("__high") - (F.col("__before") + F.col("low")), F.col("fall"), F.lit(0.0))
    return at.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("staked").alias("staked"), F.sum("profit").alias("profit"), (F.sum("profit") / F.sum("staked")).alias("roi"), (F.sum("hits") / F.sum("n")).alias("hit"),
        F.max(down).alias("max_drawdown"), (F.sum("prices") / F.sum("n")).alias("avg_price"), (F.sum("staked") / F.sum("n")).alias("avg_units"),
    )


def bankroll_paths(bets: DataFrame, keys: list[str], day: str = "day", floor: float = 1e-9) -> DataFrame:
    """``keys``, day, ``log_bank`` (log growth since the beginning), ``down`` (log distance below the highest so far).

    Stakes are per cent of the bankroll at the day's beginning; all bets of a day settle at its end. Stakes above the whole bankroll are
    scaled to it, and a day never leaves less than ``floor`` of it. Bets are summed by day first, so that a window holds days.
    """
    days = bets.groupBy(*keys, day).agg((F.sum("stake") / 100).alias("__staked"), (F.sum("profit") / 100).alias("__profit"))
    grown = F.ln(F.greatest(1 + F.col("__profit") * F.least(F.lit(1.0), 1 / F.col("__staked")), F.lit(floor)))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("log_bank", F.sum(grown).over(w))
    return run.select(*keys, day, "log_bank", (F.greatest(F.max("log_bank").over(w), F.lit(0.0)) - F.col("log_bank")).alias("down"))


def value_bets(df: DataFrame, p: str, price: str, won: str, edge: float, fraction: float, most: float, least: float = 0.0) -> DataFrame:
    """One-sided bets on rows of long tables (a market and a price each): stake, profit; null ``won`` is void."""
    P, dec = F.col(p), F.col(price)
    b = df.filter(P.isNotNull() & dec.isNotNull()).withColumn("ev", P * dec - 1).withColumn("stake", kelly(P, dec, fraction, most))
    profit = F.when(F.col(won).isNull(), 0.0).when(F.col(won) == 1, F.col("stake") * (dec - 1)).otherwise(-F.col("stake"))
    return b.filter((F.col("ev") > edge) & (F.col("stake") > 0) & (F.col("stake") >= least)).withColumn("profit", profit)


def settled(market: Column, y: Column, outcome: Column, method: Column, secs: Column) -> Column:
    """1 if the market's ``yes`` came about, 0 if not, null where the contest is void.

    Markets: dec, under_k, and a_ or b_ followed by ko, sub, dec or itd.
    """
    from pairloom.operators.features import DECISION, KNOCKOUT, SUBMISSION

    ko, sub, dec = method.isin(KNOCKOUT), method.isin(SUBMISSION), method.isin(DECISION)
    itd = ko | sub | (method == "DQ")
    way = F.substring_index(market, "_", -1)
    by = F.when(way == "ko", ko).when(way == "sub", sub).when(way == "dec", dec).when(way == "itd", itd)
    limit = F.when(market.startswith("under_"), way.try_cast("int") * 300 + 150)
    side_won = F.when(market.startswith("a_"), y == 1).otherwise(y == 0)
    yes = F.when(market == "dec", dec).when(limit.isNotNull(), itd & (secs < limit)).otherwise(F.coalesce(side_won, F.lit(False)) & by)
    return F.when(y.isNull() & (outcome != "D/D"), None).otherwise(F.coalesce(yes, F.lit(False)).cast("double"))


def best_policy(years: DataFrame, least: int = 150, most_down: float | None = None) -> DataFrame:
    """Of policies with their bets by year (policy, n, growth, max_drawdown) the one that grew most over all years; those with few bets or a deeper fall are out."""
    s = years.groupBy("policy").agg(F.sum("n").alias("n"), F.sum("growth").alias("growth"), F.max("max_drawdown").alias("max_drawdown")).filter(F.col("n") >= least)
    if most_down is not None:
        s = s.filter(F.col("max_drawdown") <= most_down)
    return s.orderBy(F.round("growth", 9).desc(), "policy").limit(1)


def starts(days: DataFrame, keys: list[str], horizons: list[int], day: str = "day", growth: str = "growth") -> DataFrame:
    """keys, start, horizon, log growth of every start on a Monday whose horizon ends within the known days.

    ``days`` has a row for each day with bets. Growth between two days is the difference of running sums, which the last day before each
    end tells: a union and a window, no join of days with days.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    run = days.groupBy(*keys, day).agg(F.sum(growth).alias("g")).select(*keys, day, F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    ends = run.groupBy(*keys).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    # 1970-01-05, day 4, was a Monday
    monday = F.explode(F.sequence((F.ceil((F.col("lo") - 4) / 7) * 7 + 4).cast("int"), F.col("hi").cast("int"), F.lit(7)))
    asked = ends.filter("hi - lo >= 7").select(*keys, "hi", monday.alias("start")).select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).filter("start + horizon <= hi + 1")
    points = asked.select(*keys, "start", "horizon", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("start").alias("at")), F.struct(F.lit(1).alias("end"), (F.col("start") + F.col("horizon")).alias("at")))).alias("p")).select(*keys, "start", "horizon", "p.*")
    both = run.select(*keys, F.col(day).cast("int").alias("at"), "sum", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("horizon"), F.lit(None).cast("int").alias("end")).unionByName(points.withColumn("sum", F.lit(None).cast("double")))
    seen = both.withColumn("known", F.coalesce(F.last("sum", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    value = lambda e: F.max(F.when(F.col("end") == e, F.col("known")))
    return seen.filter("start IS NOT NULL").groupBy(*keys, "start", "horizon").agg((value(1) - value(0)).alias("growth"))


def block_paths(months: DataFrame, paths: int, length: int, growth: str = "growth", month: str = "month", seed: int = 1) -> DataFrame:
    """path, final, down: log growth and deepest fall of ``paths`` runs of ``length`` months that are drawn from ``months`` with replacement.

    The months (one row each) are numbered and broadcast behind a check of their number; draws are hashes of path and step.
    """
    n = months.count()
    if not 0 < n <= 100_000:
        raise ValueError(f"{n} months can't be drawn from")
    numbered = months.select(F.col(growth).alias("g"), (F.row_number().over(Window.orderBy(month)) - 1).alias("i"))
    draws = months.sparkSession.range(1, paths + 1).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(length))).alias("step"))
    draws = draws.withColumn("i", F.pmod(F.xxhash64("path", "step", F.lit(seed)), F.lit(n)).cast("int")).join(F.broadcast(numbered), "i")
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = draws.select("path", "step", F.sum("g").over(w).alias("sum"))
    run = run.withColumn("down", F.greatest(F.max("sum").over(w), F.lit(0.0)) - F.col("sum"))
    return run.groupBy("path").agg(F.max_by("sum", "step").alias("final"), F.max("down").alias("down"))
