"""Queries that learn: layers over a line, methods, props, movements, scans and controls. All score years that they have not learned from."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import evaluate, features, inference, learn, packed, staking
from pairloom.plans.blocks import kind
from pairloom.plans.catalog import C, QUERIES, query, r
from pairloom.plans.contests import contests
from pairloom.tables import written


def design(spark, d) -> DataFrame:
    """Decided contests with their line, form and prices, some of them missing."""
    form = QUERIES["prior_form"](spark, d).select("contest_id", "d_rate", (F.col("d_n") / 100.0).alias("d_n"), (F.col("d_idle") / 100.0).alias("d_idle"))
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    line = lambda p: staking.logit(F.col(p))
    m = c.select("contest_id", "date", F.year("date").alias("year"), "class", "y", kind().alias("method"), line("p_open").alias("opening"), line("p_close").alias("line"), ((F.col("a_price") - F.col("b_price")) / 1e5).alias("d_price"), "p_open", "p_close", "a_dec", "b_dec", "day")
    return written(m.join(form, "contest_id"))


X = ["d_rate", "d_n", "d_idle", "d_price"]


def years_of(m: DataFrame) -> list[int]:
    return sorted(x[0] for x in m.select("year").distinct().collect())


def statistics(m: DataFrame, years: list[int]) -> DataFrame:
    """contest_id, stats: a market-free model of each year from all earlier ones, all years fitted at once."""
    zero = lambda df: df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in X})
    both = learn.mirrored(zero(m).select("year", "y", *X), X, "y")
    beta = learn.grouped_logit(learn.with_earlier(both, "year", "cut", years), ["cut"], X, "y", 20.0)
    eta = sum((F.col(c) * F.get("beta", i) for i, c in enumerate(X)), F.lit(0.0))
    return zero(m).join(F.broadcast(beta.withColumnRenamed("cut", "year")), "year").select("contest_id", (1 / (1 + F.exp(-eta))).alias("stats"))


@query("market_layers")
def market_layers(spark, d):
    """Statistics out of sample from the second year on, then layers around the line, learned from those from the fourth year on: a stack, an offset model, their mean."""
    m = design(spark, d)
    years = years_of(m)
    j = written(m.join(statistics(m, years[1:]), "contest_id").select("contest_id", "date", "year", "y", "line", staking.logit(F.col("stats")).alias("stats"), "opening").withColumns({"gap": F.col("stats") - F.col("line"), "steam": F.col("line") - F.col("opening")}))
    later = [y for y in years if y >= years[0] + 4]
    if not later:
        return j.limit(0).select("contest_id", "date", "year", "y", *(F.lit(None).cast("double").alias(c) for c in ("stack", "edge", "p")))
    train = written(learn.with_earlier(j, "year", "cut", later))
    stack = learn.grouped_logit(learn.mirrored(train.select("cut", "y", "line", "stats"), ["line", "stats"], "y"), ["cut"], ["line", "stats"], "y", 0.1).select(F.col("cut").alias("year"), F.col("beta").alias("b1"))
    edge = learn.grouped_logit(learn.mirrored(train.select("cut", "y", "line", "gap", "steam"), ["gap", "steam"], "y", offset="line"), ["cut"], ["gap", "steam"], "y", 30.0, offset="line").select(F.col("cut").alias("year"), F.col("beta").alias("b2"))
    s = j.join(F.broadcast(stack), "year").join(F.broadcast(edge), "year")
    one = 1 / (1 + F.exp(-(F.col("line") * F.get("b1", 0) + F.col("stats") * F.get("b1", 1))))
    two = 1 / (1 + F.exp(-(F.col("line") + F.col("gap") * F.get("b2", 0) + F.col("steam") * F.get("b2", 1))))
    return s.select("contest_id", "date", "year", "y", one.alias("stack"), two.alias("edge"), ((one + two) / 2).alias("p"))


def each_year(m: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``predict(train, test)`` of every year after the first, from all years before it."""
    return learn.walk_forward(m, "date", years_of(m)[1:], predict) if len(years_of(m)) > 1 else predict(m, m.limit(0))


@query("scaled_model")
def scaled_model(spark, d):
    """Filled, scaled and softly labelled logistic model of each year from all before it, both orientations averaged.

    With its mirror image each row leaves medians, means and the intercept at zero and counts twice, so that the images need not be made,
    and both orientations predict the same. A row whose label is soft is two rows in the deviations.
    """
    x, m = ["opening", *X], design(spark, d)
    n, cuts = len(x), years_of(m)[1:]
    blocks = packed.packed(m.withColumn("soft", features.soft_label(F.col("y"), F.col("method"))), "year", [*x, "soft"])

    def squares(year: int, b):
        for c, cut in enumerate(cuts):
            if year < cut:
                copies = 1.0 + ((b[n] > 0) & (b[n] < 1))
                yield c, np.append((copies * np.nan_to_num(b[:n]) ** 2).sum(axis=1), copies.sum())

    got = packed.summed(blocks, squares, n + 1)
    scales = {cut: learn.Scale(x, [0.0] * n, [0.0] * n, [(got[c].get(i, 0.0) / got[c][n]) ** 0.5 for i in range(n)]) for c, cut in enumerate(cuts)}

    def rows(year: int, b):
        yield from ((cut, packed.scaled(scales[cut], b[:n]), b[n], 2.0, 0.0) for cut in cuts if year < cut)

    beta = packed.logits(blocks, n + 1, rows, cuts, np.full(n, 1 / 0.05))
    return packed.score(m, "year", {cut: (scales[cut], beta[cut]) for cut in cuts}, x, "p").select("contest_id", "date", "y", "p")


@query("boosted_model")
def boosted_model(spark, d):
    """Boosted trees and a logistic model of each year from all before it, and their mean. All years are learned at once."""
    x, m = ["opening", *X], design(spark, d)
    n, cuts = len(x), years_of(m)[1:]
    blocks = packed.packed(m, "year", [*x, "y", "contest_id"])
    scales = packed.scales(blocks, n + 2, list(range(n)), x, cuts)

    def rows(year: int, b):
        yield from ((cut, np.vstack([packed.scaled(scales[cut], b[:n]), np.ones(b.shape[1])]), b[n], 1.0, 0.0) for cut in cuts if year < cut)

    beta = packed.logits(blocks, n + 2, rows, cuts, np.array([1 / 0.05] * n + [0.0]))
    fills = {cut: s.medians for cut, s in scales.items()}
    trees = packed.boosted(blocks, n + 2, n + 1, n, list(range(n)), fills)
    scored = packed.score(m, "year", {cut: (scales[cut], beta[cut]) for cut in cuts}, x, "p_line")
    scored = scored.withColumn("p_trees", packed.boosted_share(trees, fills)("year", *x))
    return scored.select("contest_id", "date", "y", "p_trees", "p_line", ((F.col("p_trees") + F.col("p_line")) / 2).alias("p"))


@query("method_model")
def method_model(spark, d):
    """Shares of knockouts, submissions and decisions in each year, from all before it."""
    label = F.when(F.col("method").isin(features.KNOCKOUT), "KO").when(F.col("method").isin(features.SUBMISSION), "SUB").when(F.col("method").isin(features.DECISION), "DEC")
    x, m = ["line", *X], design(spark, d).withColumn("way", label)
    years = years_of(m)
    scales = packed.scales(packed.packed(m, "year", x), len(x), list(range(len(x))), x, years[1:])
    predict = lambda cut: learn.method_shares(m.filter(F.col("year") < cut), m.filter(F.col("year") == cut), x, "way", ["KO", "SUB", "DEC"], given=scales.get(cut)).select("contest_id", "date", "way", "p_KO", "p_SUB", "p_DEC")
    return reduce(DataFrame.unionByName, map(predict, years[1:])) if len(years) > 1 else m.limit(0).select("contest_id", "date", "way", *(F.lit(None).cast("double").alias(c) for c in ("p_KO", "p_SUB", "p_DEC")))


@query("prop_layer")
def prop_layer(spark, d):
    """For each market and year a layer over the quoted price and a base rate, from all earlier years with 200 rows at least."""
    m = design(spark, d)
    years = years_of(m)
    won = {"dec": F.col("method").isin(features.DECISION), "ko": F.col("method").isin(features.KNOCKOUT), "a_win": F.col("y") == 1}
    long = m.select("contest_id", "year", "line", "opening", F.explode(F.array(*(F.struct(F.lit(k).alias("market"), v.cast("double").alias("yes")) for k, v in won.items()))).alias("m")).select("contest_id", "year", "line", "opening", "m.*").withColumn("one", F.lit(1.0))
    train = learn.with_earlier(long, "year", "cut", years[1:])
    enough = train.groupBy("market", "cut").agg(F.count("*").alias("n")).filter("n >= 200").select("market", "cut")
    beta = learn.grouped_logit(train.join(F.broadcast(enough), ["market", "cut"]), ["market", "cut"], ["one", "line", "opening"], "yes", 1.0)
    eta = F.get("beta", 0) + F.col("line") * F.get("beta", 1) + F.col("opening") * F.get("beta", 2)
    return long.join(F.broadcast(beta.withColumnRenamed("cut", "year")), ["market", "year"]).select("contest_id", "market", "year", "yes", (1 / (1 + F.exp(-eta))).alias("p"))


@query("line_movement")
def line_movement(spark, d):
    """Movement of the line in each year by form and price, learned before it on mirrored rows: out-of-sample R2 and correlation."""
    m = design(spark, d).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in X}).withColumn("moved", F.col("line") - F.col("opening"))
    x = ["opening", *X]

    def predict(train: DataFrame, test: DataFrame) -> DataFrame:
        beta = learn.ridge_linear(train, x, "moved", 50.0)  # mirrored rows only double all sums, as both sides change sign
        return test.select("year", "moved", sum((F.col(c) * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0)).alias("said"))

    return each_year(m, predict).groupBy("year").agg(F.count("*").alias("n"), (1 - F.avg((F.col("moved") - F.col("said")) ** 2) / F.avg(F.col("moved") ** 2)).alias("r2"), F.corr("moved", "said").alias("r"))


@query("spline_scan")
def spline_scan(spark, d):
    """Each feature alone as a smooth curve over the line: log loss gained on the last two years. All features are fitted at once."""
    m = design(spark, d)
    years = years_of(m)
    blocks = packed.packed(m, "year", ["y", "line", *X])
    found = packed.quantiles(blocks, len(X) + 2, lambda _, b: enumerate(b[2:]), [0.0, 0.25, 0.5, 0.75, 1.0])
    usable = [i for i in found if all(a < b for a, b in zip(found[i], found[i][1:], strict=False))]
    empty = spark.createDataFrame([], "feature string, n long, gain double")
    if not usable:
        return empty
    size = len(packed.splines(np.zeros(1), found[usable[0]]))

    def rows(year: int, b, late: bool = False):
        if (year >= years[-1] - 1) == late:
            for i in usable:
                y, line, x = b[[0, 1, i + 2]][:, ~np.isnan(b[:2]).any(axis=0)]
                yield i, packed.splines(np.where(np.isnan(x), found[i][-1], x), found[i]), y, 1.0, line  # not known: counts as the last knot, as in the columns' basis

    beta = packed.logits(blocks, len(X) + 2, rows, usable, np.full(size, 5.0), rounds=30)

    def gains(year: int, b):
        loss = lambda y, eta: -np.log(np.clip(np.where(y == 1, 1 / (1 + np.exp(-eta)), 1 - 1 / (1 + np.exp(-eta))), 1e-6, 1 - 1e-6))
        yield from ((i, np.array([len(y), (loss(y, line) - loss(y, beta[i] @ x + line)).sum(), 0])) for i, x, y, _, line in rows(year, b, True))
        yield from ((i, np.array([0, 0, len(y)])) for i, _, y, _, _ in rows(year, b))

    sums = packed.summed(blocks, gains, len(X) + 2)
    got = [(X[i], int(v[0]), v.get(1, 0.0) / v[0]) for i, v in sorted(sums.items()) if v.get(0) and v.get(2)]
    return spark.createDataFrame(got, empty.schema)


@query("context_scan")
def context_scan(spark, d):
    """Whether features count more in some contexts: feature times context as a correction to the line, with q-values over all of them."""
    m = design(spark, d)
    contexts = {"class 1": F.col("class") == 1, "early years": F.col("year") <= 1997, "favourite a": F.col("line") > 0, "steamed": F.col("line") > F.col("opening")}
    cells = [F.struct(F.lit(f"{f} in {k}").alias("hypothesis"), (F.col(f) * (v.cast("double") - 0.5)).alias("x")) for f in X for k, v in contexts.items()]
    long = m.select("y", "line", F.explode(F.array(*cells)).alias("c")).select("y", "line", "c.*")
    return evaluate.q_values(inference.offset_scan(long, ["hypothesis"], "y", "line", "x"), "lr_p", "hypothesis").select("hypothesis", "n", "beta", "z", "lr_p", "q")


@query("ablation")
def ablation(spark, d):
    """Log loss of all years after the first without each group of features; all variants and years are fitted at once."""
    m = design(spark, d).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in X})
    x = ["opening", *X]
    groups = {"nothing": [], "line": ["opening"], "form": ["d_rate", "d_n"], "rest": ["d_idle"], "price": ["d_price"]}
    blocks, cuts = packed.packed(m, "year", [*x, "y"]), years_of(m)[1:]
    kept = [np.array([[c not in g] for c in x], float) for g in groups.values()]

    def rows(year: int, b):
        yield from ((v * len(cuts) + c, b[:-1] * keep, b[-1], 1.0, 0.0) for v, keep in enumerate(kept) for c, cut in enumerate(cuts) if year < cut)

    beta = packed.logits(blocks, len(x) + 1, rows, list(range(len(kept) * len(cuts))), np.full(len(x), 5.0), rounds=30)
    table = spark.createDataFrame([(g, cut, beta[v * len(cuts) + c].tolist()) for v, g in enumerate(groups) for c, cut in enumerate(cuts)], "without string, year int, beta array<double>")
    eta = sum((F.col(c) * F.get("beta", F.lit(i)) for i, c in enumerate(x)), F.lit(0.0))  # what a variant leaves out has a coefficient of zero
    return m.join(F.broadcast(table), "year").groupBy("without").agg(F.count("*").alias("n"), F.avg(evaluate.log_loss(F.col("y"), 1 / (1 + F.exp(-eta)))).alias("log_loss"))


@query("penalty_search")
def penalty_search(spark, d):
    """The ridge that predicts the last three years best from those before them."""
    m = design(spark, d).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in X})
    best = learn.chosen_penalty(m, X, "y", "year", [1.0, 10.0, 100.0, 1000.0], offset="opening", least=(100, 100))
    return spark.createDataFrame([(float(best),)], "penalty double")


@query("controls", C + """, n AS (SELECT contest_id, day, y, margin, p_close, ((contest_id * 7919) % 1000 / 1000.0::DOUBLE - 0.5) * 0.8 AS noise, ln(greatest(least(p_close, 0.9999), 0.0001) / (1 - greatest(least(p_close, 0.9999), 0.0001))) AS l FROM contests, (VALUES (1.05::DOUBLE), (1.07)) v(margin)),
m AS (SELECT *, 1 / (p_close * margin) AS da, 1 / ((1 - p_close) * margin) AS db, 1 / (1 + exp(-(l + noise))) AS p FROM n), e AS (SELECT *, p * da - 1 >= (1 - p) * db - 1 AS on_a FROM m),
k AS (SELECT margin, CASE WHEN on_a THEN p ELSE 1 - p END AS bp, CASE WHEN on_a THEN da ELSE db END AS price, CASE WHEN on_a THEN y ELSE 1 - y END AS won FROM e), b AS (SELECT *, least(greatest(25 * (bp * price - 1) / (price - 1), 0), 5) AS stake FROM k WHERE bp * price - 1 > 0.02)
SELECT margin, count(*) AS n, round(sum(stake), 4) AS staked, round(sum(CASE WHEN won IS NULL THEN 0 WHEN won = 1 THEN stake * (price - 1) ELSE -stake END) / sum(stake), 6) AS roi FROM b WHERE stake > 0 GROUP BY margin""")
def controls(spark, d):
    """Bets of a model that is the market plus noise, at margins of five and seven per cent: what an empty model earns."""
    noise = (F.col("contest_id") * 7919 % 1000 / 1000.0 - 0.5) * 0.8
    c = contests(spark, d).select("contest_id", "day", "y", "p_close", F.explode(F.array(F.lit(1.05), F.lit(1.07))).alias("margin"), (1 / (1 + F.exp(-(staking.logit(F.col("p_close")) + noise)))).alias("p"))
    c = c.withColumns({"da": 1 / (F.col("p_close") * F.col("margin")), "db": 1 / ((1 - F.col("p_close")) * F.col("margin"))})
    b = staking.simulate(c, "p", "da", "db", "y", edge=0.02)
    return b.groupBy("margin").agg(F.count("*").alias("n"), r(F.sum("stake"), 4).alias("staked"), r(F.sum("profit") / F.sum("stake")).alias("roi"))
