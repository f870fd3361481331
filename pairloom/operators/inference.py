"""Tests and scans: paired gains, likelihood ratios, binomial and t tests, slopes by grid, and the search for leaks of the future."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import functions as P
from pairloom.operators.evaluate import log_loss
from pairloom.operators.staking import logit
from pairloom.tables import written


def poisson_weight(u: Column, most: int = 8) -> Column:
    """A Poisson(1) number out of a uniform one: how many of the cumulative probabilities it reaches."""
    weight, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(most):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k + 1
    return weight


def uniform(*parts: Column) -> Column:
    """A number from 0 up to 1 that depends on ``parts`` alone: the same on every run and every cluster."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def paired(df: DataFrame, keys: list[str], gain: Column) -> DataFrame:
    """n, mean, sd (sample), t and two-sided normal p of a paired gain by ``keys``."""
    g = df.select(*keys, gain.alias("g")).filter("g IS NOT NULL")
    s = g.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"))
    t = F.col("mean") / F.col("sd") * F.sqrt("n")
    return s.withColumn("t", F.when(F.col("sd") > 0, t)).withColumn("p", 2 * P.normal_tail(F.abs("t")))


def paired_bootstrap(df: DataFrame, row: str, gain: Column, replicates: int, seed: int = 1) -> DataFrame:
    """lo, mid, hi: percentiles 2.5, 50 and 97.5 of the mean gain over ``replicates`` draws of rows, each with Poisson(1) weights of row and replicate."""
    d = df.select(F.col(row).alias("k"), gain.alias("g")).filter("g IS NOT NULL").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(uniform(F.col("k"), F.col("replicate"), F.lit(seed)))
    means = d.groupBy("replicate").agg((F.sum(w * F.col("g")) / F.sum(w)).alias("m"))
    return means.agg(*(F.percentile("m", F.lit(q)).alias(n) for n, q in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))))


def binomial(df: DataFrame, keys: list[str], won: Column, p: float = 0.5) -> DataFrame:
    """n, wins, rate and the exact two-sided p that wins come at rate ``p``; null ``won`` doesn't count."""
    s = df.select(*keys, won.cast("double").alias("w")).filter("w IS NOT NULL").groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum("w").alias("wins"))
    return s.select(*keys, "n", "wins", (F.col("wins") / F.col("n")).alias("rate"), P.binomial_tail(F.col("wins"), F.col("n"), p).alias("p"))


def offset_scan(df: DataFrame, keys: list[str], y: str, offset: str, x: str, steps: int = 12) -> DataFrame:
    """By ``keys``: n, beta of ``x`` in a logistic model with a fixed ``offset``, its standard error, Wald z, likelihood ratio and p values.

    ``df`` is long: one row for each contest and hypothesis. A model has one coefficient, so that a Newton step for all hypotheses at
    once is one aggregate and a small join; nothing is fitted by a task of its own.
    """
    d = df.select(*keys, F.col(y).alias("y"), F.col(offset).alias("o"), F.col(x).alias("x")).filter("y IS NOT NULL AND o IS NOT NULL AND x IS NOT NULL")
    beta = d.select(*keys).distinct().withColumn("beta", F.lit(0.0))
    prob = 1 / (1 + F.exp(-(F.col("o") + F.col("beta") * F.col("x"))))
    d = written(d)
    for _ in range(steps):
        s = d.join(F.broadcast(beta), keys).withColumn("p", prob).groupBy(*keys, "beta").agg(F.sum(F.col("x") * (F.col("y") - F.col("p"))).alias("slope"), F.sum(F.col("x") ** 2 * F.col("p") * (1 - F.col("p"))).alias("curve"))
        step = F.when(F.col("curve") > 0, F.greatest(F.least(F.col("slope") / F.col("curve"), F.lit(2.0)), F.lit(-2.0))).otherwise(0.0)
        new = written(s.select(*keys, (F.col("beta") + step).alias("beta"), F.abs(step).alias("step")))
        beta = new.select(*keys, "beta")
        if (new.agg(F.max("step")).first()[0] or 0.0) < 1e-9:
            break
    full = d.join(F.broadcast(beta), keys).withColumn("p", prob)
    null = 1 / (1 + F.exp(-F.col("o")))
    s = full.groupBy(*keys, "beta").agg(F.count("*").alias("n"), F.sum(F.col("x") ** 2 * F.col("p") * (1 - F.col("p"))).alias("curve"), (2 * F.sum(log_loss(F.col("y"), null, 1e-12) - log_loss(F.col("y"), F.col("p"), 1e-12))).alias("lr"))
    z = F.col("beta") * F.sqrt("curve")
    return s.select(*keys, "n", "beta", (1 / F.sqrt("curve")).alias("se"), z.alias("z"), "lr", (2 * P.normal_tail(F.abs(z))).alias("wald_p"), P.chi2_tail(F.greatest(F.col("lr"), F.lit(0.0))).alias("lr_p"))


def best_slope(df: DataFrame, keys: list[str], y: str, p: str, grid: list[float]) -> DataFrame:
    """By ``keys`` the factor on the log odds of ``p`` with the least log loss (ties: the least factor), and that loss."""
    g = df.select(*keys, F.col(y).alias("y"), logit(F.col(p)).alias("l"), F.explode(F.array(*map(F.lit, grid))).alias("slope"))
    s = g.groupBy(*keys, "slope").agg(F.avg(log_loss(F.col("y"), 1 / (1 + F.exp(-F.col("slope") * F.col("l"))))).alias("loss"))
    return s.groupBy(*keys).agg(F.min(F.struct(F.round("loss", 12).alias("loss"), "slope")).alias("b")).select(*keys, "b.slope", "b.loss")


def leaks(rows: DataFrame, features: Callable[[DataFrame], DataFrame], keys: list[str], day: str, cut: Column, tolerance: float = 1e-9) -> DataFrame:
    """Rows before ``cut`` whose features change when all rows from ``cut`` on are taken away: none, if features look back only."""
    full, part = features(rows), features(rows.filter(F.col(day) < cut))
    both = full.join(part.select(*keys, F.struct(*part.columns).alias("__p")), keys)
    differ = F.lit(False)
    for c, t in full.dtypes:
        if c not in keys:
            a, b = F.col(c), F.col(f"__p.{c}")
            near = F.coalesce(F.abs(a - b) <= tolerance * (1 + F.abs(a)), F.lit(False)) if t in ("double", "float") else F.lit(False)
            differ = differ | ~(a.eqNullSafe(b) | near)
    return both.filter(differ).select(*keys)
