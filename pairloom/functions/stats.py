"""Distribution functions and standardised values that Spark lacks, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["beta_share", "binomial_tail", "chi2_tail", "gaussian_log_density", "ln_gamma", "normal_tail", "poisson_log_probability", "z_score"]

#: Stirling's series: B(2k) / (2k (2k - 1)); fixed values.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
HALF_LN_2PI = 0.9189385332046727


def ln_gamma(x: Column) -> Column:
    """log of the gamma function for x > 0: Stirling's series at x + 8, less the logarithms of what lies between."""
    y = x + 8
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    down = sum((F.ln(x + k) for k in range(8)), F.lit(0.0))
    return F.when(x > 0, (y - 0.5) * F.ln(y) - y + HALF_LN_2PI + series - down)


def poisson_log_probability(count: Column, rate: Column) -> Column:
    return count * F.ln(rate) - rate - ln_gamma(count + 1)


def gaussian_log_density(x: Column, mean: Column, variance: Column) -> Column:
    return -HALF_LN_2PI - F.ln(variance) / 2 - (x - mean) ** 2 / (2 * variance)


def normal_tail(z: Column) -> Column:
    """P(Z > z): the series of the error function near zero, its continued fraction further out; ten digits or more."""
    a = F.abs(z)
    start = F.struct(a.alias("term"), a.alias("sum"))
    step = lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * a * a / (2 * k + 1)).alias("sum"))
    near = 0.5 - F.exp(-a * a / 2) * 0.3989422804014327 * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["sum"]
    far = F.exp(-a * a / 2) * 0.3989422804014327 / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda s, k: a + k / s)
    up = F.when(a < 3, near).otherwise(far)
    return F.when(z >= 0, up).otherwise(1 - up)


def chi2_tail(x: Column) -> Column:
    """P(X > x) for one degree of freedom."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(2 * normal_tail(F.sqrt(x)))


def _bound(use, **values: Column) -> Column:
    """``use`` of the values, each evaluated once."""
    return F.transform(F.array(F.struct(*(v.cast("double").alias(k) for k, v in values.items()))), lambda s: use(*(s[k] for k in values)))[0]


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction; steps grow with the root of a + b."""

    def below(x: Column, a: Column, b: Column) -> Column:
        def term(j: Column) -> Column:
            m = F.floor(j / 2)
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(j % 2 == 1, odd).otherwise(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))

        steps = F.sequence(F.ceil(60 + 8 * F.sqrt(a + b)).cast("int"), F.lit(1), F.lit(-1))
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
        return front / a / F.aggregate(steps, F.lit(1.0), lambda s, j: 1 + term(j) / s)

    def either(x: Column, a: Column, b: Column, low: Column) -> Column:
        # the fraction of the end that lies nearer
        own = _bound(below, x=F.when(low == 1, x).otherwise(1 - x), a=F.when(low == 1, a).otherwise(b), b=F.when(low == 1, b).otherwise(a))
        return F.when(low == 1, own).otherwise(1 - own)

    return _bound(either, x=x, a=a, b=b, low=F.when(x < (a + 1) / (a + b + 2), 1).otherwise(0))


def binomial_tail(k: Column, n: Column, p: float = 0.5) -> Column:
    """Two-sided exact test: the probability of all outcomes no likelier than ``k`` of ``n``.

    Outcomes fall off to both sides of the likeliest one, so that halving finds where the other side is as rare; both ends are then
    incomplete beta functions.
    """
    import math

    def density(i: Column, n: Column) -> Column:
        return F.exp(ln_gamma(n + 1.0) - ln_gamma(i + 1.0) - ln_gamma(n - i + 1.0) + i * math.log(p) + (n - i) * math.log(1 - p))

    def at_most(i: Column, n: Column) -> Column:
        return F.when(i < 0, 0.0).when(i >= n, 1.0).otherwise(beta_share(F.lit(1 - p), n - i, i + 1.0))

    def other_end(k: Column, n: Column, mode: Column, most: Column) -> Column:
        """The outcome nearest to the likeliest one, on the other side of it than ``k``, that is no likelier than ``k``."""
        up = k <= mode

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["near"] + s["far"]) / 2)
            mid = F.when(up, mid).otherwise(F.ceil((s["near"] + s["far"]) / 2)).cast("double")
            return _bound_pair(mid, density(mid, n) <= most, s)

        start = F.struct(mode.alias("near"), F.when(up, n + 1).otherwise(F.lit(-1.0)).alias("far"))
        return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))) + 1), start, halve)["far"]

    def _bound_pair(mid: Column, rare: Column, s: Column) -> Column:
        return F.struct(F.when(rare, s["near"]).otherwise(mid).alias("near"), F.when(rare, mid).otherwise(s["far"]).alias("far"))

    def total(k: Column, n: Column, mode: Column, end: Column) -> Column:
        lower, upper = _bound(at_most, i=F.when(k <= mode, k).otherwise(end), n=n), _bound(at_most, i=F.when(k <= mode, end).otherwise(k) - 1, n=n)
        return F.least(lower + 1 - upper, F.lit(1.0))

    def tested(k: Column, n: Column, mode: Column, most: Column) -> Column:
        two = _bound(total, k=k, n=n, mode=mode, end=_bound(other_end, k=k, n=n, mode=mode, most=most))
        return F.when(most >= density(mode, n), F.lit(1.0)).otherwise(two)

    return _bound(lambda k, n: _bound(tested, k=k, n=n, mode=F.floor((n + 1) * p), most=density(k, n) * (1 + 1e-7)), k=k, n=n)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, zero where nothing varies."""
    return F.when(sd > 0, (x - mean) / sd).when(x.isNotNull(), F.lit(0.0))
