"""Walk-forward learning: symmetric fits, ridge logistic with an offset by aggregated normal equations, yearly refits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pairloom.operators.evaluate import log_loss
from pairloom.tables import written


def ridge_logit(df: DataFrame, x: list[str], y: str, penalty: float, offset: str | None = None, weight: str | None = None, rounds: int = 50, tol: float = 1e-8, free: tuple[str, ...] = ()) -> np.ndarray:
    """Coefficients without intercept of a logistic model with fixed ``offset`` and ridge ``penalty`` toward zero, from which ``free`` columns are exempt.

    Newton steps; each is one aggregate of ``len(x) * (len(x) + 3) / 2`` sums over the data, solved on the driver. ``df`` is read once
    for each step: give it a written table, so that a step is a scan and not the plan behind it.
    """
    k, beta = len(x), np.zeros(len(x))
    w = F.col(weight) if weight else F.lit(1.0)
    base = F.col(offset) if offset else F.lit(0.0)
    for _ in range(rounds):
        eta = sum((F.col(c) * float(b) for c, b in zip(x, beta, strict=True)), base)
        d = df.select(*x, F.col(y).alias("__y"), w.alias("__w"), (1 / (1 + F.exp(-eta))).alias("__p"))
        h = F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        grad = [F.sum(F.col("__w") * F.col(c) * (F.col("__y") - F.col("__p"))) for c in x]
        hess = [F.sum(h * F.col(x[i]) * F.col(x[j])) for i in range(k) for j in range(i, k)]
        got = [v or 0.0 for v in d.agg(*grad, *hess).first()]
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = got[k:]
        ridge = penalty * np.array([c not in free for c in x])
        m = m + np.triu(m, 1).T + np.diag(ridge)
        step = np.linalg.solve(m, np.array(got[:k]) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta


def mirrored(df: DataFrame, x: list[str], y: str, offset: str | None = None) -> DataFrame:
    """Both orientations: differences and offset change sign, the target becomes its complement."""
    signs = {c: -F.col(c) for c in [*x, *([offset] if offset else [])]}
    return df.unionByName(df.withColumns({**signs, y: 1 - F.col(y)}))


def score_logit(x: list[str], beta: np.ndarray, offset: Column | None = None) -> Column:
    eta = sum((F.col(c) * float(b) for c, b in zip(x, beta, strict=True)), offset if offset is not None else F.lit(0.0))
    return 1 / (1 + F.exp(-eta))


def recency(date: str, until: Column, half_life_years: float) -> Column:
    return F.pow(F.lit(0.5), F.datediff(until, F.col(date)) / 365.25 / half_life_years)


def later_years(df: DataFrame, date: str) -> list[int]:
    """All years of ``df`` after the first, so that each has rows to learn from."""
    return sorted(r[0] for r in df.select(F.year(date)).distinct().collect() if r[0] is not None)[1:]


def walk_forward(df: DataFrame, date: str, years: list[int], predict: Callable[[DataFrame, DataFrame], DataFrame], locked_from: int | None = None) -> DataFrame:
    """``predict(train, test)`` for each year: all earlier rows train, the year's rows are scored. Years from ``locked_from`` on are refused.

    The design is written once, so that refits scan it and don't plan it anew.
    """
    if locked_from is not None and any(y >= locked_from for y in years):
        raise PermissionError(f"years from {locked_from} on are locked")
    out, df = None, written(df)
    for y in years:
        train, test = df.filter(F.col(date) < F.lit(f"{y}-01-01").cast("date")), df.filter((F.col(date) >= F.lit(f"{y}-01-01").cast("date")) & (F.col(date) < F.lit(f"{y + 1}-01-01").cast("date")))
        part = predict(train, test)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Scale:
    """What ``x`` is filled with and scaled by; learned from training rows only."""

    x: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]

    def apply(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        """``df`` plus the scaled columns and ``one``; what doesn't vary is zero."""
        z = {prefix + c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - a) / (s or 1.0) for c, m, a, s in zip(self.x, self.medians, self.means, self.deviations, strict=True)}
        return df.withColumns({**z, "one": F.lit(1.0)})


def scale(train: DataFrame, x: list[str], keep: tuple[str, ...] = (), accuracy: int | None = None) -> Scale:
    """Medians (exact, or approximate to 1 / ``accuracy``), then means and deviations (of the population) of the filled values. ``keep`` stay on their own scale."""
    middle = (lambda c: F.percentile(c, F.lit(0.5))) if accuracy is None else (lambda c: F.percentile_approx(c, 0.5, accuracy))
    medians = [m if m is not None else 0.0 for m in train.agg(*(middle(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(x))).first()]
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in zip(x, medians, strict=True)]
    got = list(train.agg(*(F.avg(c).alias(f"a{i}") for i, c in enumerate(filled)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled))).first())
    n = len(x)
    means = [0.0 if c in keep else (got[i] or 0.0) for i, c in enumerate(x)]
    return Scale(x, [float(m) for m in medians], means, [1.0 if c in keep else (got[n + i] or 0.0) for i, c in enumerate(x)])


@dataclass(frozen=True)
class ScaledLogit:
    """Fill, scale, and a logistic model whose intercept is free of the ridge."""

    scale: Scale
    beta: np.ndarray

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        z = ["z_" + c for c in self.scale.x]
        return self.scale.apply(df).withColumn(out, score_logit([*z, "one"], self.beta)).drop(*z, "one")


def scaled_logit(train: DataFrame, x: list[str], y: str, c: float = 0.05, weight: str | None = None) -> ScaledLogit:
    """``c`` is the weight of the data against a unit ridge, as is usual."""
    s = scale(train, x)
    d = written(s.apply(train).select(*("z_" + k for k in x), "one", y, *([weight] if weight else [])))
    return ScaledLogit(s, ridge_logit(d, [*("z_" + k for k in x), "one"], y, 1 / c, weight=weight, free=("one",)))


def soft_rows(df: DataFrame, y: str, soft: str, weight: str = "weight") -> DataFrame:
    """Each row as a win with weight ``soft`` and as a loss with the rest; rows without weight fall out."""
    copies = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col(soft).alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col(soft)).alias("w"))))
    return df.withColumn("__c", copies).filter("__c.w > 0").withColumns({y: F.col("__c.y"), weight: F.col("__c.w")}).drop("__c")


def symmetric(p: Column, p_swapped: Column) -> Column:
    """One probability out of both orientations' predictions."""
    return (p + 1 - p_swapped) / 2


def grouped_logit(df: DataFrame, groups: list[str], x: list[str], y: str, penalty: float, offset: str | None = None, weight: str | None = None, rounds: int = 30, tol: float = 1e-8, most: int = 100_000) -> DataFrame:
    """``groups`` and ``beta`` (array): a ridge logistic model for each group, all fitted at once.

    A Newton step is one aggregate over all groups, whose small systems are solved together on the driver; there may be ``most`` groups.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    d = written(df.select(*groups, *(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias("__y"), (F.col(offset) if offset else F.lit(0.0)).alias("__o"), w.alias("__w")))
    spark, k = df.sparkSession, len(x)
    names = [tuple(r) for r in d.select(*groups).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} groups")
    beta = {g: np.zeros(k) for g in names}
    kinds = StructType([*(d.schema[g] for g in groups), StructField("beta", ArrayType(DoubleType()))])
    table = lambda: spark.createDataFrame([(*g, [float(b) for b in v]) for g, v in beta.items()], kinds)
    for _ in range(rounds):
        eta = sum((F.col(c) * F.get("beta", i) for i, c in enumerate(x)), F.col("__o"))
        p = d.join(F.broadcast(table()), groups).withColumn("__p", 1 / (1 + F.exp(-eta)))
        h = F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        grad = [F.sum(F.col("__w") * F.col(c) * (F.col("__y") - F.col("__p"))).alias(f"g{i}") for i, c in enumerate(x)]
        hess = [F.sum(h * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        moved = 0.0
        for r in p.groupBy(*groups).agg(*grad, *hess).collect():
            g, v = tuple(r[: len(groups)]), np.array([c or 0.0 for c in r[len(groups) :]])
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = v[k:]
            step = np.linalg.solve(m + np.triu(m, 1).T + penalty * np.eye(k), v[:k] - penalty * beta[g])
            beta[g] = beta[g] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return table()


def with_earlier(df: DataFrame, year: str, cut: str, years: list[int]) -> DataFrame:
    """``df`` once for each of ``years`` that lies after its own, as training rows of the year ``cut``."""
    later = F.filter(F.array(*map(F.lit, years)), lambda y: y > F.col(year))
    return df.select("*", F.explode(later).alias(cut))


def chosen_penalty(train: DataFrame, x: list[str], y: str, year: str, grid: list[float], last: int = 3, offset: str | None = None, least: tuple[int, int] = (800, 300), default: float = 1 / 0.003) -> float:
    """The ridge that predicts the ``last`` years best from those before them (ties: the first of ``grid``); ``default`` where either side has few rows."""
    top = train.agg(F.max(year)).first()[0]
    if top is None:
        return default
    late = F.col(year) > top - last
    sizes = train.agg(F.count_if(~late), F.count_if(late)).first()
    if sizes[0] <= least[0] or sizes[1] <= least[1]:
        return default
    d = written(train)
    base = F.col(offset) if offset else F.lit(0.0)
    loss = lambda beta: F.avg(log_loss(F.col(y), score_logit(x, beta, base)))
    betas = [ridge_logit(d.filter(~late), x, y, c, offset=offset) for c in grid]
    got = d.filter(late).agg(*(loss(b).alias(f"l{i}") for i, b in enumerate(betas))).first()
    return grid[int(np.argmin([round(v, 12) for v in got]))]


def ridge_linear(df: DataFrame, x: list[str], y: str, penalty: float) -> np.ndarray:
    """Coefficients without intercept of a linear model with a ridge: one aggregate, one solve."""
    k = len(x)
    xx = [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    got = [v or 0.0 for v in df.agg(*(F.sum(F.col(c) * F.col(y)).alias(f"g{i}") for i, c in enumerate(x)), *xx).first()]
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = got[k:]
    return np.linalg.solve(m + np.triu(m, 1).T + penalty * np.eye(k), np.array(got[:k]))


def spline_basis(x: Column, knots: list[float], degree: int = 2) -> list[Column]:
    """B-splines over sorted ``knots``, as columns; outside the knots x counts as the nearest one. ``len(knots) + degree - 1`` of them, whose sum is one."""
    k = [float(v) for v in knots]
    full = [k[0]] * degree + k + [k[-1]] * degree
    c = F.greatest(F.least(x, F.lit(k[-1])), F.lit(k[0]))
    last = max(i for i in range(len(full) - 1) if full[i] < full[i + 1])
    level = [((c >= a) & (c <= b if i == last else c < b)).cast("double") if a < b else F.lit(0.0) for i, (a, b) in enumerate(zip(full, full[1:], strict=False))]
    for d in range(1, degree + 1):
        up = lambda i, b, d=d: (c - full[i]) / (full[i + d] - full[i]) * b[i] if full[i + d] > full[i] else F.lit(0.0)
        down = lambda i, b, d=d: (full[i + d + 1] - c) / (full[i + d + 1] - full[i + 1]) * b[i + 1] if full[i + d + 1] > full[i + 1] else F.lit(0.0)
        level = [up(i, level) + down(i, level) for i in range(len(level) - 1)]
    return level


def trees_and_line(train: DataFrame, test: DataFrame, x: list[str], y: str, c: float = 0.05, trees: int = 30, depth: int = 3, seed: int = 7) -> DataFrame:
    """``test`` plus ``p_trees``, ``p_line`` and ``p``, their mean: gradient-boosted trees and the scaled logistic model, both from ``train``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    line = scaled_logit(train, x, y, c)
    z = ["z_" + k for k in x]
    assembler = VectorAssembler(inputCols=z, outputCol="__x")
    rows = lambda df: assembler.transform(line.scale.apply(df))
    boost = GBTClassifier(featuresCol="__x", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.6, featureSubsetStrategy="sqrt", minInstancesPerNode=40, seed=seed)
    model = boost.fit(rows(train).select("__x", y))
    scored = model.transform(rows(line.predict(test, "p_line")))
    return scored.select(*test.columns, vector_to_array("probability")[1].alias("p_trees"), "p_line").withColumn("p", (F.col("p_trees") + F.col("p_line")) / 2)


def method_shares(train: DataFrame, test: DataFrame, x: list[str], label: str, labels: list[str], c: float = 0.05, given: Scale | None = None) -> DataFrame:
    """``test`` plus ``p_<label>`` for each of ``labels``: a multinomial logistic model over filled and scaled columns (``given``: their scale, if known)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    s = given or scale(train, x)
    assembler = VectorAssembler(inputCols=["z_" + k for k in x], outputCol="__x")
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    rows = written(assembler.transform(s.apply(train.filter(F.col(label).isin(labels)))).select("__x", number.cast("double").alias("__k")))
    model = LogisticRegression(featuresCol="__x", labelCol="__k", family="multinomial", regParam=1 / (c * max(1, rows.count())), standardization=False, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y").fit(rows)
    scored = model.transform(assembler.transform(s.apply(test)))
    p = vector_to_array("__p")
    return scored.select(*test.columns, *(p[i].alias(f"p_{v}") for i, v in enumerate(labels)))
