"""Registered queries over the contest view and the SQL that checks them. Floats are rounded on both sides before they are compared."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators import evaluate, folds, joins, learn, match, packed, prior, sides, staking
from pairloom.plans.contests import CONTESTS, contests, participants, table
from pairloom.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = "WITH " + CONTESTS


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: Words of 64 bits in a side's bitmap of opponents.
BITS = 32


def w1():
    return prior.before(["id"])


def win() -> Column:
    return (F.col("res") == 1).cast("double")


_W1 = "OVER (PARTITION BY id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

@query("prior_form", C + f""", f AS (SELECT contest_id, side, count(*) {_W1} AS n, (coalesce(sum(CASE WHEN res = 1 THEN 1 ELSE 0 END) {_W1}, 0) + 1.0::DOUBLE) / (coalesce(sum(CASE WHEN res IN (0, 1) THEN 1 ELSE 0 END) {_W1}, 0) + 2) AS rate, day - max(day) {_W1} AS idle FROM sides)
SELECT c.contest_id, a.n - b.n AS d_n, round(a.rate - b.rate, 6) AS d_rate, (a.idle - b.idle)::DOUBLE AS d_idle, round(a.rate, 6) AS s1_rate, round(b.rate, 6) AS s2_rate, class, y
FROM contests c JOIN f a ON a.contest_id = c.contest_id AND a.side = 'a' JOIN f b ON b.contest_id = c.contest_id AND b.side = 'b'""")
def prior_form(spark, d):
    """Strictly-prior counts, smoothed win rates and rest, as a difference design for each contest."""
    # sides are put back together by the contest's own key, so that the contests are planned once
    rate = (F.coalesce(F.sum(win()).over(w1()), F.lit(0.0)) + 1) / (F.coalesce(F.sum(F.when(F.col("res").isin(0.0, 1.0), 1).otherwise(0)).over(w1()), F.lit(0)) + 2)
    p = participants(contests(spark, d)).select("contest_id", "class", "side", "res", F.count("*").over(w1()).alias("n"), rate.alias("rate"), (F.col("day") - F.max("day").over(w1())).cast("double").alias("idle"))
    of = lambda s, k: F.max(F.when(F.col("side") == s, F.col(k)))
    both = p.groupBy("contest_id", "class").agg(of("a", "res").alias("y"), *(of(s, k).alias(f"{s}_{k}") for s in "ab" for k in ("n", "rate", "idle")))
    return rounded(sides.design(both, ["n", "rate", "idle"], ["rate"], ["contest_id", "class", "y"]))


@query("career_form", C + f""", j AS (SELECT t.contest_id, t.side, count(p.id) AS n, count(p.id) FILTER (WHERE p.day >= t.day - 365) AS n_365, max(p.score) AS best, avg(p.score) AS mean_score,
  sum(CASE WHEN p.method = 'R' AND p.res = 1 THEN 1 ELSE 0 END) / (count(p.id) + 2.0::DOUBLE) AS r_rate, coalesce(sum(p.score * pow(0.5::DOUBLE, (t.day - p.day) / 548.0::DOUBLE)), 0) AS decayed, max(CASE WHEN p.res = 1 THEN p.opp_score END) AS best_beaten, min(t.day) - min(p.day) AS tenure
  FROM sides t LEFT JOIN sides p ON p.id = t.id AND p.day < t.day GROUP BY t.contest_id, t.side)
SELECT contest_id, side, n, n_365, best, round(mean_score, 6) AS mean_score, round(CASE WHEN n > 0 THEN r_rate END, 6) AS r_rate, round(decayed, 4) AS decayed, best_beaten, tenure::DOUBLE AS tenure FROM j""")
def career_form(spark, d):
    """Counts, rates, means, extremes and exponentially decayed sums over strictly-prior contests."""
    n = F.count("*").over(w1())
    return participants(contests(spark, d)).select(
        "contest_id", "side", n.alias("n"), F.count("*").over(prior.before(["id"], days=365)).alias("n_365"), F.max("score").over(w1()).alias("best"), r(F.avg("score").over(w1())).alias("mean_score"),
        r(F.when(n > 0, F.coalesce(F.sum(((F.col("method") == "R") & (F.col("res") == 1)).cast("int")).over(w1()), F.lit(0)) / (n + 2))).alias("r_rate"),
        r(F.coalesce(prior.decayed(F.col("score"), "day", w1()), F.lit(0.0)), 4).alias("decayed"), F.max(F.when(F.col("res") == 1, F.col("opp_score"))).over(w1()).alias("best_beaten"), (F.col("day") - F.min("day").over(w1())).cast("double").alias("tenure"),
    )


@query("streaks", C + """, k AS (SELECT t.contest_id, t.side, p.res, row_number() OVER (PARTITION BY t.contest_id, t.side ORDER BY p.day DESC, p.contest_id DESC) AS i FROM sides t JOIN sides p ON p.id = t.id AND p.day < t.day WHERE p.res IS NOT NULL),
f AS (SELECT contest_id, side, min(i) FILTER (WHERE res <> 1) AS not_win, min(i) FILTER (WHERE res <> 0) AS not_loss, max(i) AS m FROM k GROUP BY contest_id, side),
l AS (SELECT contest_id, side, avg(res) FILTER (WHERE i <= 3) AS last3, max(CASE WHEN i = 1 THEN res END) AS last1 FROM k GROUP BY contest_id, side)
SELECT s.contest_id, s.side, coalesce(CASE WHEN last1 = 1 THEN coalesce(not_win - 1, m) WHEN last1 = 0 THEN -coalesce(not_loss - 1, m) ELSE 0 END, 0)::INT AS streak, round(last3, 6) AS last3, last1
FROM sides s LEFT JOIN f USING (contest_id, side) LEFT JOIN l USING (contest_id, side)""")
def streaks(spark, d):
    """Signed streaks (no contests skipped, a draw ends one), last result and mean of the last three."""
    p = participants(contests(spark, d)).select("contest_id", "side", "id", "day", "res")
    known = p.filter("res IS NOT NULL")
    order = Window.partitionBy("id").orderBy("day", "contest_id")
    # running index of an entity's known results, and the index of the last one that was no win, or no loss, up to there
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    k = known.select("id", "day", "contest_id", "res", F.row_number().over(order).alias("i"), F.avg("res").over(order.rowsBetween(-2, 0)).alias("last3"))
    k = k.select("*", F.coalesce(F.max(F.when(F.col("res") != 1, F.col("i"))).over(upto), F.lit(0)).alias("no_win"), F.coalesce(F.max(F.when(F.col("res") != 0, F.col("i"))).over(upto), F.lit(0)).alias("no_loss"))
    run = F.when(F.col("res") == 1, F.col("i") - F.col("no_win")).when(F.col("res") == 0, F.col("no_loss") - F.col("i")).otherwise(0)
    # each day's last state, seen from all later days
    ends = k.groupBy("id", "day").agg(F.max_by(F.struct(run.alias("run"), "last3", "res"), F.col("i")).alias("end"))
    seen = p.join(ends, ["id", "day"], "left").select("contest_id", "side", F.max(F.when(F.col("end").isNotNull(), F.struct("day", "end"))).over(w1()).alias("s"))
    return seen.select("contest_id", "side", F.coalesce(F.col("s.end.run"), F.lit(0)).cast("int").alias("streak"), r("s.end.last3").alias("last3"), F.col("s.end.res").alias("last1"))


@query("league_priors", C + f""", g AS (SELECT day, sum(score) AS s, count(*) AS n FROM sides GROUP BY day), q AS (SELECT day, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(n) OVER w, 0) AS n FROM g WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, side, round((coalesce(sum(score) {_W1}, 0) + CASE WHEN q.n > 100 THEN q.s / q.n ELSE 25.0::DOUBLE END * 12) / (count(*) {_W1} + 12.0::DOUBLE), 6) AS rate FROM sides JOIN q USING (day)""")
def league_priors(spark, d):
    """Rates shrunk to a running league mean of earlier days, with a default until it has 100 rows."""
    p = participants(contests(spark, d))
    league = prior.daily_prior(p, "day", {"s": F.sum("score"), "n": F.count("*")})
    mean = F.when(F.col("n") > 100, F.col("s") / F.col("n")).otherwise(25.0)
    own = p.select("contest_id", "side", "day", F.sum("score").over(w1()).alias("num"), F.count("*").over(w1()).cast("double").alias("den"))
    return own.join(league, "day").select("contest_id", "side", r(prior.shrunk(F.col("num"), F.col("den"), mean, 12.0)).alias("rate"))


@query("residuals", C + f""", f AS (SELECT contest_id, side, avg(opp_score) {_W1} AS allows FROM sides) SELECT s.contest_id, s.side, round(s.score - f.allows, 6) AS residual FROM sides s JOIN f ON f.contest_id = s.contest_id AND f.side <> s.side""")
def residuals(spark, d):
    """What a side scored beyond what its opponent had allowed before."""
    p = participants(contests(spark, d)).select("contest_id", "side", "score", F.avg("opp_score").over(w1()).alias("allows"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.struct("score", "allows")))
    both = p.groupBy("contest_id").agg(of("a").alias("a"), of("b").alias("b"))
    one = lambda s, o: F.struct(F.lit(s).alias("side"), r(F.col(s)["score"] - F.col(o)["allows"]).alias("residual"))
    return both.select("contest_id", F.explode(F.array(one("a", "b"), one("b", "a"))).alias("s")).select("contest_id", "s.*")


@query("common_opponents", C + """, f AS (SELECT c.contest_id, p.opp, avg(p.res) AS m, p.side2 FROM contests c JOIN (SELECT *, 'a' AS side2 FROM sides) p ON p.id = c.a_id AND p.day < c.day WHERE p.res IS NOT NULL AND p.opp NOT IN (c.a_id, c.b_id) GROUP BY ALL),
g AS (SELECT c.contest_id, p.opp, avg(p.res) AS m FROM contests c JOIN sides p ON p.id = c.b_id AND p.day < c.day WHERE p.res IS NOT NULL AND p.opp NOT IN (c.a_id, c.b_id) GROUP BY ALL),
h AS (SELECT c.contest_id, sum(p.res - 0.5::DOUBLE) AS h2h FROM contests c JOIN sides p ON p.id = c.a_id AND p.opp = c.b_id AND p.day < c.day GROUP BY c.contest_id)
SELECT c.contest_id, count(g.opp) AS n_common, round(avg(f.m - g.m), 9) AS d_common, min(round(h.h2h, 6)) AS h2h FROM contests c LEFT JOIN f ON f.contest_id = c.contest_id LEFT JOIN g ON g.contest_id = c.contest_id AND g.opp = f.opp LEFT JOIN h ON h.contest_id = c.contest_id GROUP BY c.contest_id""")
def common_opponents(spark, d):
    """Mean difference of results against opponents that both sides met before, and earlier meetings of the two."""
    c = contests(spark, d)
    # an entity's record against each opponent, as running sums by day: joins meet pairs, not careers
    p = participants(c).filter("res IS NOT NULL").groupBy("id", "opp", F.col("day").alias("then")).agg(F.sum("res").alias("s"), F.count("*").alias("k"))
    pair = Window.partitionBy("id", "opp").orderBy("then").rowsBetween(Window.unboundedPreceding, 0)
    met = p.select("id", "opp", "then", F.lead("then", 1, 1 << 30).over(Window.partitionBy("id", "opp").orderBy("then")).alias("upto"), F.sum("s").over(pair).alias("s"), F.sum("k").over(pair).alias("k"))
    a = met.select(F.col("id").alias("a_id"), "opp", F.col("then").alias("fa"), F.col("upto").alias("ta"), (F.col("s") / F.col("k")).alias("ma"))
    b = met.select(F.col("id").alias("b_id"), "opp", F.col("then").alias("fb"), F.col("upto").alias("tb"), (F.col("s") / F.col("k")).alias("mb"))
    # most opponents of side a are strangers to side b: a bitmap of those whom b ever meets drops them before rows are shuffled once more
    spot = F.pmod(F.xxhash64("opp"), F.lit(64 * BITS))
    word = lambda i: F.coalesce(F.bit_or(F.when(F.floor(spot / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int")))), F.lit(0).cast("long"))
    known = p.groupBy(F.col("id").alias("b_id")).agg(F.array(*map(word, range(BITS))).alias("known"))
    may_know = F.call_function("getbit", F.get("known", F.floor(spot / 64).cast("int")), F.pmod(spot, F.lit(64)).cast("int")) == 1
    left = c.select("contest_id", "day", "a_id", "b_id").join(known, "b_id").join(a, "a_id").filter((F.col("fa") < F.col("day")) & (F.col("day") <= F.col("ta")) & (F.col("opp") != F.col("b_id")) & (F.col("opp") != F.col("a_id")) & may_know).drop("known")
    both = left.join(b, ["b_id", "opp"]).filter((F.col("fb") < F.col("day")) & (F.col("day") <= F.col("tb"))).groupBy("contest_id").agg(F.count("*").alias("n_common"), F.avg(F.col("ma") - F.col("mb")).alias("d_common"))
    h2h = c.select("contest_id", "day", F.col("a_id").alias("id"), F.col("b_id").alias("opp")).join(met, ["id", "opp"]).filter((F.col("then") < F.col("day")) & (F.col("day") <= F.col("upto"))).select("contest_id", (F.col("s") - F.col("k") * 0.5).alias("h2h"))
    return c.select("contest_id").join(both, "contest_id", "left").join(h2h, "contest_id", "left").select("contest_id", F.coalesce("n_common", F.lit(0)).alias("n_common"), r("d_common", 9).alias("d_common"), r("h2h").alias("h2h"))


@query("prices", C + """SELECT contest_id, round(CASE WHEN a_dec >= 2 THEN (a_dec - 1) * 100 ELSE -100 / (a_dec - 1) END, 4) AS american, round(1 / a_dec + 1 / b_dec, 6) AS overround, round((1 / a_dec) / (1 / a_dec + 1 / b_dec), 6) AS fair, round(ln(greatest(least(p_close, 0.9999), 0.0001) / (1 - greatest(least(p_close, 0.9999), 0.0001))), 6) AS line,
round(greatest(a_dec, a_close), 6) AS best, round(a_dec / a_close - 1, 6) AS clv FROM contests WHERE 1 / a_dec + 1 / b_dec BETWEEN 0.98 AND 1.25 AND p_close BETWEEN 0.01 AND 0.99""")
def prices(spark, d):
    """Odds formats, vig-free probabilities, log odds, best price and closing-line value behind sanity filters."""
    over = 1 / F.col("a_dec") + 1 / F.col("b_dec")
    c = contests(spark, d).filter(over.between(0.98, 1.25) & F.col("p_close").between(0.01, 0.99))
    return c.select("contest_id", r(staking.american_odds(F.col("a_dec")), 4).alias("american"), r(over).alias("overround"), r((1 / F.col("a_dec")) / over).alias("fair"), r(staking.logit(F.col("p_close"))).alias("line"), r(F.greatest("a_dec", "a_close")).alias("best"), r(F.col("a_dec") / F.col("a_close") - 1).alias("clv"))


_BETS = """, e AS (SELECT *, p_close * a_dec - 1 >= (1 - p_close) * b_dec - 1 AS on_a FROM contests), s AS (SELECT contest_id, day, year(date) AS year, CASE WHEN on_a THEN 'a' ELSE 'b' END AS side, CASE WHEN on_a THEN p_close ELSE 1 - p_close END AS bet_p, CASE WHEN on_a THEN a_dec ELSE b_dec END AS price, y FROM e),
k AS (SELECT *, bet_p * price - 1 AS ev, least(greatest(0.25::DOUBLE * 100 * (bet_p * price - 1) / (price - 1), 0), 5) AS stake FROM s),
bets AS (SELECT *, CASE WHEN y IS NULL THEN 0 WHEN (side = 'a' AND y = 1) OR (side = 'b' AND y = 0) THEN stake * (price - 1) ELSE -stake END AS profit FROM k WHERE ev > 0.02 AND stake > 0)"""


def bets(spark: SparkSession, d: str) -> DataFrame:
    return staking.simulate(contests(spark, d), "p_close", "a_dec", "b_dec", "y", edge=0.02).withColumn("year", F.year("date"))


@query("bets", C + _BETS + " SELECT contest_id, side, round(price, 6) AS price, round(ev, 6) AS ev, round(stake, 6) AS stake, round(profit, 6) AS profit FROM bets")
def place_bets(spark, d):
    """Best-value side, Kelly stake, settlement."""
    return rounded(bets(spark, d).select("contest_id", "side", "price", "ev", "stake", "profit"))


@query("bet_summary", C + _BETS + """, t AS (SELECT *, sum(profit) OVER (PARTITION BY year ORDER BY day, contest_id ROWS UNBOUNDED PRECEDING) AS total FROM bets), m AS (SELECT *, greatest(max(total) OVER (PARTITION BY year ORDER BY day, contest_id ROWS UNBOUNDED PRECEDING), 0) - total AS down FROM t)
SELECT year, count(*) AS n, round(sum(stake), 4) AS staked, round(sum(profit), 4) AS profit, round(sum(profit) / sum(stake), 6) AS roi, round(avg(CASE WHEN profit > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit, round(max(down), 4) AS max_drawdown, round(avg(price), 6) AS avg_price, round(avg(stake), 6) AS avg_units FROM m GROUP BY year""")
def bet_summary(spark, d):
    """Stakes, returns and deepest drawdown by year."""
    s = staking.summary(bets(spark, d), ["year"], ["day", "contest_id"])
    return s.select("year", "n", *(r(c, 4).alias(c) for c in ("staked", "profit", "max_drawdown")), *(r(c).alias(c) for c in ("roi", "hit", "avg_price", "avg_units")))


@query("policy_walk_forward", C + """, grid AS (SELECT row_number() OVER (ORDER BY edge, fraction, most) AS policy, * FROM (VALUES (0.0::DOUBLE), (0.02), (0.04), (0.06), (0.08), (0.12)) a(edge), (VALUES (0.1::DOUBLE), (0.25), (0.5)) b(fraction), (VALUES (2.0::DOUBLE), (5.0)) c(most)),
s AS (SELECT contest_id, year(date) AS year, CASE WHEN p_close * a_dec >= (1 - p_close) * b_dec THEN p_close ELSE 1 - p_close END AS p, CASE WHEN p_close * a_dec >= (1 - p_close) * b_dec THEN a_dec ELSE b_dec END AS price, CASE WHEN p_close * a_dec >= (1 - p_close) * b_dec THEN y ELSE 1 - y END AS won FROM contests),
k AS (SELECT policy, year, won, price, least(greatest(fraction * 100 * (p * price - 1) / (price - 1), 0), most) AS stake FROM s, grid WHERE p * price - 1 > edge),
g AS (SELECT policy, year, count(*) AS n, sum(ln(1 + CASE WHEN won IS NULL THEN 0 WHEN won = 1 THEN stake * (price - 1) ELSE -stake END / 100)) AS growth FROM k WHERE stake > 0 GROUP BY policy, year),
h AS (SELECT y.year, g.policy, sum(g.n) AS n, sum(g.growth) AS growth FROM (SELECT DISTINCT year FROM g) y JOIN g ON g.year < y.year GROUP BY y.year, g.policy HAVING sum(g.n) >= 150)
SELECT year, policy, n::BIGINT AS n, round(growth, 4) AS growth FROM h QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(growth, 9) DESC, policy) = 1""")
def policy_walk_forward(spark, d):
    """For each year the policy of a 36-cell grid that grew most in all earlier years (150 bets at least; the first cell wins ties)."""
    cells = [(e, f, m) for e in (0.0, 0.02, 0.04, 0.06, 0.08, 0.12) for f in (0.1, 0.25, 0.5) for m in (2.0, 5.0)]
    grid = F.explode(F.array(*(F.struct(F.lit(i + 1).cast("long").alias("policy"), F.lit(e).alias("edge"), F.lit(f).alias("fraction"), F.lit(m).alias("most")) for i, (e, f, m) in enumerate(cells))))
    c = contests(spark, d).select(F.year("date").alias("year"), "p_close", "a_dec", "b_dec", "y", grid.alias("g")).select("*", "g.*")
    b = staking.simulate(c, "p_close", "a_dec", "b_dec", "y", F.col("edge"), F.col("fraction"), F.col("most"))
    years = b.groupBy("policy", "year").agg(F.count("*").alias("n"), F.sum(F.log1p(F.col("profit") / 100)).alias("growth"))
    w = Window.partitionBy("policy").orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    past = years.select("year", "policy", F.sum("n").over(w).alias("n"), F.sum("growth").over(w).alias("growth")).filter("n >= 150")
    best = Window.partitionBy("year").orderBy(F.round("growth", 9).desc(), "policy")
    return past.withColumn("i", F.row_number().over(best)).filter("i = 1").select("year", "policy", "n", r("growth", 4).alias("growth"))


@query("live_stakes", C + "SELECT contest_id, round_even(least(greatest(0.125::DOUBLE * 100 * (p_close * a_dec - 1) / (a_dec - 1), 0), 1.5) * 2, 0) / 2 AS units FROM contests WHERE p_close * a_dec - 1 > 0.03 AND round_even(least(greatest(0.125::DOUBLE * 100 * (p_close * a_dec - 1) / (a_dec - 1), 0), 1.5) * 2, 0) / 2 >= 0.25")
def live_stakes(spark, d):
    """Eighth Kelly up to 1.5 units in half units, halves to even."""
    u = F.bround(staking.kelly(F.col("p_close"), F.col("a_dec"), 0.125, 1.5) * 2, 0) / 2
    return contests(spark, d).filter(F.col("p_close") * F.col("a_dec") - 1 > 0.03).select("contest_id", u.alias("units")).filter("units >= 0.25")


@query("scores", C + """, d AS (SELECT year(date) AS year, p_close AS p, y FROM contests WHERE y IN (0, 1)), q AS (SELECT *, greatest(least(p, 0.999999), 0.000001) AS c FROM d), k AS (SELECT year, p, y, rank() OVER (PARTITION BY year ORDER BY p) + (count(*) OVER (PARTITION BY year, p) - 1) / 2.0::DOUBLE AS rk FROM d),
a AS (SELECT year, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM k GROUP BY year), f AS (SELECT year, greatest(p, 1 - p) AS f, CASE WHEN p >= 0.5 THEN y ELSE 1 - y END AS w FROM d), e AS (SELECT year, least(floor((f - 0.5) * 20), 9) AS bin, count(*) AS k, avg(f) AS f, avg(w) AS w FROM f GROUP BY ALL), ec AS (SELECT year, sum(k * abs(f - w)) / sum(k) AS ece FROM e GROUP BY year)
SELECT q.year, count(*) AS n, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(min(auc), 6) AS auc, round(min(ece), 6) AS ece FROM q JOIN a USING (year) JOIN ec USING (year) GROUP BY q.year""")
def score_table(spark, d):
    """Log loss, Brier score, accuracy, AUC and calibration error by year."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0)).withColumn("year", F.year("date"))
    return rounded(evaluate.scores(c, ["year"], "y", "p_close"))


@query("calibration", C + """, f AS (SELECT greatest(p_close, 1 - p_close) AS f, CASE WHEN p_close >= 0.5 THEN y ELSE 1 - y END AS w FROM contests WHERE y IN (0, 1))
SELECT CASE WHEN f <= 0.55 THEN 0.55 WHEN f <= 0.6 THEN 0.6 WHEN f <= 0.65 THEN 0.65 WHEN f <= 0.7 THEN 0.7 WHEN f <= 0.75 THEN 0.75 WHEN f <= 0.8 THEN 0.8 WHEN f <= 0.85 THEN 0.85 WHEN f <= 0.9 THEN 0.9 ELSE 1.0 END::DOUBLE AS upto, count(*) AS n, round(avg(f), 6) AS predicted, round(avg(w), 6) AS observed FROM f GROUP BY 1""")
def calibration(spark, d):
    """Right-closed bins of the favourite's probability."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0)).select(F.greatest("p_close", 1 - F.col("p_close")).alias("f"), F.when(F.col("p_close") >= 0.5, F.col("y")).otherwise(1 - F.col("y")).alias("w"))
    edges = [0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]
    upto = F.coalesce(*(F.when(F.col("f") <= e, F.lit(e)) for e in edges), F.lit(1.0))
    return rounded(c.groupBy(upto.alias("upto")).agg(F.count("*").alias("n"), F.avg("f").alias("predicted"), F.avg("w").alias("observed")))


@query("breakdowns", C + """, d AS (SELECT *, greatest(least(p_close, 0.999999), 0.000001) AS c FROM contests WHERE y IN (0, 1)), g AS (SELECT 'class' AS breakdown, class::VARCHAR AS grp, y, c FROM d UNION ALL SELECT 'method', method, y, c FROM d UNION ALL SELECT 'favourite', CASE WHEN p_close >= 0.6 OR p_close <= 0.4 THEN 'clear' ELSE 'close' END, y, c FROM d)
SELECT breakdown, grp, count(*) AS n, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss FROM g GROUP BY ALL HAVING count(*) >= 40""")
def breakdowns(spark, d):
    """Overlapping subgroups in one pass: each contest carries its labels."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    label = lambda b, g: F.struct(F.lit(b).alias("breakdown"), g.cast("string").alias("grp"))
    g = c.select("y", "p_close", F.explode(F.array(label("class", F.col("class")), label("method", F.col("method")), label("favourite", F.when((F.col("p_close") >= 0.6) | (F.col("p_close") <= 0.4), "clear").otherwise("close")))).alias("g"))
    return rounded(g.groupBy("g.breakdown", "g.grp").agg(F.count("*").alias("n"), F.avg(evaluate.log_loss(F.col("y"), F.col("p_close"))).alias("log_loss")).filter("n >= 40"))


@query("matchup_cells", C + """, b AS (SELECT least(a_id % 5, b_id % 5) AS lo, greatest(a_id % 5, b_id % 5) AS hi, CASE WHEN a_id % 5 <= b_id % 5 THEN y ELSE 1 - y END AS w, year(date) < 1998 AS early FROM contests WHERE y IN (0, 1) AND a_id % 5 <> b_id % 5)
SELECT lo, hi, count(*) FILTER (WHERE early) AS n1, count(*) FILTER (WHERE NOT early) AS n2, round(avg(w) FILTER (WHERE early), 6) AS w1, round(avg(w) FILTER (WHERE NOT early), 6) AS w2 FROM b GROUP BY lo, hi HAVING count(*) FILTER (WHERE early) >= 40 AND count(*) FILTER (WHERE NOT early) >= 40""")
def matchup_cells(spark, d):
    """Win rate of the lower bucket against the higher one in two periods."""
    a, b, early = F.col("a_id") % 5, F.col("b_id") % 5, F.year("date") < 1998
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0) & (a != b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(a <= b, F.col("y")).otherwise(1 - F.col("y")).alias("w"), early.alias("early"))
    n = lambda e: F.count(F.when(F.col("early") == e, 1))
    m = lambda e: F.avg(F.when(F.col("early") == e, F.col("w")))
    return rounded(c.groupBy("lo", "hi").agg(n(True).alias("n1"), n(False).alias("n2"), m(True).alias("w1"), m(False).alias("w2")).filter("n1 >= 40 AND n2 >= 40"))


@query("q_values", """WITH p AS (SELECT l_suppkey AS name, (l_suppkey * 7919 % 1000 + 1) / 5000.0::DOUBLE AS p FROM lineitem GROUP BY l_suppkey), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM p)
SELECT name, rank, round(least(min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS q FROM k""")
def q_values(spark, d):
    """False discovery rates of one hypothesis for each supplier."""
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("name")).distinct().withColumn("p", (F.col("name") * 7919 % 1000 + 1) / 5000.0)
    return evaluate.q_values(p, "p", "name").select("name", F.col("rank").cast("long").alias("rank"), r("q", 9).alias("q"))


@query("fit_measures", C + """, d AS (SELECT year(date) AS year, p_open, p_close, y, (p_close - y) * (p_close - y) - (p_open - y) * (p_open - y) AS g FROM contests WHERE y IN (0, 1)) SELECT year, round(corr(p_open, p_close), 6) AS r, round(1 - avg((y - p_close) * (y - p_close)) / avg((y - 0.5) * (y - 0.5)), 6) AS r2, round(avg(g) / stddev_samp(g) * sqrt(count(*)), 6) AS t, round(stddev_pop(g), 6) AS sd FROM d GROUP BY year""")
def fit_measures(spark, d):
    """Correlation, out-of-sample R2 and paired t by year."""
    y, o, c = F.col("y"), F.col("p_open"), F.col("p_close")
    x = contests(spark, d).filter(y.isin(0.0, 1.0)).withColumns({"year": F.year("date"), "g": (c - y) ** 2 - (o - y) ** 2})
    return rounded(x.groupBy("year").agg(F.corr("p_open", "p_close").alias("r"), (1 - F.avg((y - c) ** 2) / F.avg((y - 0.5) ** 2)).alias("r2"), (F.avg("g") / F.stddev_samp("g") * F.sqrt(F.count("*"))).alias("t"), F.stddev_pop("g").alias("sd")))


@query("asof_price", C + """SELECT s.contest_id, s.side, r.p AS last_price FROM sides s ASOF LEFT JOIN (SELECT id, day + 1 AS day, max(price) AS p FROM sides GROUP BY id, day) r ON s.id = r.id AND s.day >= r.day""")
def asof_price(spark, d):
    """The latest earlier value of each participant (the greatest of a day)."""
    p = participants(contests(spark, d))
    return joins.asof(p.select("contest_id", "side", "id", "date"), p.select("id", "date", "price"), ["id"], "date", F.col("price"), "last_price").select("contest_id", "side", "last_price")


@query("asof_guarded", C + """SELECT s.contest_id, s.side, r.p AS last_score FROM sides s ASOF LEFT JOIN (SELECT id, day + 4 AS day, max(score) AS p FROM sides GROUP BY id, day) r ON s.id = r.id AND s.day >= r.day""")
def asof_guarded(spark, d):
    """As-of with a guard of three days for a second source."""
    p = participants(contests(spark, d))
    return joins.asof(p.select("contest_id", "side", "id", "date"), p.select("id", "date", "score"), ["id"], "date", F.col("score"), "last_score", guard=4).select("contest_id", "side", "last_score")


@query("interval_views", """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders) SELECT a.o_orderkey, count(b.o_orderkey) AS n, round(coalesce(sum(b.o_totalprice), 0), 2) AS spent FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.date BETWEEN a.date - 60 AND a.date - 2 GROUP BY a.o_orderkey""")
def interval_views(spark, d):
    """Sums over a span of days before each row, both ends included."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    i = joins.interval(o.select("o_orderkey", "o_custkey", "date"), o.select("o_custkey", "date", F.col("o_totalprice").alias("v")), ["o_custkey"], "date", 60, 2, [F.count("*").alias("n"), F.sum("v").alias("spent")])
    return i.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), r(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("near_date", """WITH o AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders), v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT o.o_custkey, o.date, coalesce(a.v, b.v, c.v) AS near FROM o LEFT JOIN v a ON a.o_custkey = o.o_custkey AND a.date = o.date LEFT JOIN v b ON b.o_custkey = o.o_custkey AND b.date = o.date - 1 LEFT JOIN v c ON c.o_custkey = o.o_custkey AND c.date = o.date + 1""")
def near_date(spark, d):
    """Value on the day, else the day before, else the day after."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    v = o.filter("o_orderkey % 3 = 0").groupBy("o_custkey", "date").agg(F.max("o_totalprice").alias("v"))
    return joins.near_date(o.select("o_custkey", "date").distinct(), v, ["o_custkey"], "date", [0, -1, 1], "v", "near")


@query("canonical_pairs", C + "SELECT date, least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi, count(*) AS n, round(avg(CASE WHEN a_id <= b_id THEN y ELSE 1 - y END), 6) AS res FROM contests GROUP BY ALL")
def canonical_pairs(spark, d):
    """Two perspectives of one meeting become one row with the mean result of the lesser side."""
    c = sides.canonical_pair(contests(spark, d), "a_id", "b_id")
    return rounded(c.groupBy("date", "lo", "hi").agg(F.count("*").alias("n"), F.avg(F.when(F.col("a_id") <= F.col("b_id"), F.col("y")).otherwise(1 - F.col("y"))).alias("res")))


@query("set_operations", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_quantity > 48)
SELECT 'both' AS kind, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only a', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'semi', s_suppkey FROM supplier WHERE s_suppkey IN (SELECT k FROM a) UNION ALL SELECT 'anti', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM b)""")
def set_operations(spark, d):
    """Union, intersection, difference, semi and anti joins of key sets."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")  # noqa: E741
    a = l.filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("k")).distinct()
    b = l.filter("l_shipdate >= TIMESTAMP '1998-06-01' AND l_quantity > 48").select(F.col("l_suppkey").alias("k")).distinct()
    named = lambda n, x: x.select(F.lit(n).alias("kind"), F.col(x.columns[0]).alias("k"))
    k = s.select(F.col("s_suppkey").alias("k"))
    return named("both", a.intersect(b)).union(named("only a", a.subtract(b))).union(named("any", a.union(b).distinct())).union(named("semi", k.join(a, "k", "left_semi"))).union(named("anti", k.join(b, "k", "left_anti")))


@query("upsert_pages", """WITH new AS (SELECT o_custkey AS page, o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 = 0), old AS (SELECT o_custkey AS page, o_orderkey AS k, o_totalprice / 2 AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT page, k, round(v, 4) AS v FROM old WHERE page NOT IN (SELECT page FROM new) UNION ALL SELECT page, k, round(v, 4) FROM new QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1""".replace("UNION ALL SELECT page, k, round(v, 4) FROM new QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1", "UNION ALL SELECT * FROM (SELECT page, k, round(v, 4) FROM new QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)"))
def upsert_pages(spark, d):
    """Refreshed pages replace their old rows; of repeated keys the last stays."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    u = joins.upsert(o.filter("k % 5 <> 0").withColumn("v", F.col("v") / 2), o.filter("k % 5 = 0"), "page", ["page"], F.col("k"))
    return u.select("page", "k", r("v", 4).alias("v"))


@query("stage_panel", C + """, s AS (SELECT contest_id, [p_open + (p_close - p_open) * i / 9.0::DOUBLE for i in range(0, 10)] AS line FROM contests) SELECT contest_id, (i - 1)::INT AS stage, round((i - 1) / 9.0::DOUBLE, 6) AS s, round(line[i], 6) AS p FROM s, unnest(range(1, 11)) AS u(i)""")
def stage_panel(spark, d):
    """A price line at ten stages, from wide to long."""
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("p_open") + (F.col("p_close") - F.col("p_open")) * i / 9.0)
    return contests(spark, d).select("contest_id", F.posexplode(line).alias("stage", "p")).select("contest_id", "stage", r(F.col("stage") / 9.0).alias("s"), r("p").alias("p"))


@query("resampled_lines", """WITH l AS (SELECT l_orderkey AS k, list(l_extendedprice ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS v FROM lineitem GROUP BY 1), n AS (SELECT k, v, len(v) AS n FROM l WHERE len(v) >= 2), p AS (SELECT k, v, n, i, i * (n - 1) / 9.0::DOUBLE AS x FROM n, unnest(range(0, 10)) AS u(i))
SELECT k, i::INT AS i, round(v[floor(x)::INT + 1] + (x - floor(x)) * (coalesce(v[floor(x)::INT + 2], v[floor(x)::INT + 1]) - v[floor(x)::INT + 1]), 4) AS price FROM p""")
def resampled_lines(spark, d):
    """Series of any length interpolated to ten points (two points at least)."""
    keys = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*keys))), lambda x: x["l_extendedprice"]).alias("v")).filter("size(v) >= 2")
    x = v.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).withColumn("x", F.col("i") * (F.size("v") - 1) / 9.0)
    lo = F.get("v", F.floor("x").cast("int"))
    return x.select("k", "i", r(lo + (F.col("x") - F.floor("x")) * (F.coalesce(F.get("v", F.floor("x").cast("int") + 1), lo) - lo), 4).alias("price"))


@query("consensus_prices", """WITH q AS (SELECT l_orderkey AS bout, l_suppkey % 3 AS book, l_returnflag AS side, min(1 + l_tax * 20 + l_quantity / 25) AS price FROM lineitem GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY bout, book) AS sides, sum(1 / price) OVER (PARTITION BY bout, book) AS over FROM q)
SELECT bout, side, count(*) AS books, round(avg(1 / price / over), 6) AS fair, round(median(over), 6) AS overround, round(max(price), 6) AS best FROM f WHERE sides = 2 GROUP BY bout, side""")
def consensus_prices(spark, d):
    """Vig removal by book where all outcomes are quoted, then the consensus over books."""
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("bout"), (F.col("l_suppkey") % 3).alias("book"), F.col("l_returnflag").alias("side")).agg(F.min(1 + F.col("l_tax") * 20 + F.col("l_quantity") / 25).alias("price"))
    w = Window.partitionBy("bout", "book")
    f = q.select("*", F.count("*").over(w).alias("sides"), F.sum(1 / F.col("price")).over(w).alias("over")).filter("sides = 2")
    return rounded(f.groupBy("bout", "side").agg(F.count("*").alias("books"), F.avg(1 / F.col("price") / F.col("over")).alias("fair"), F.percentile("over", F.lit(0.5)).alias("overround"), F.max("price").alias("best")))


@query("period_returns", """WITH e AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(day) FROM e)::TIMESTAMP, (SELECT max(day) FROM e)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day), b AS (SELECT s.day, 1000 + sum(coalesce(v, 0)) OVER (ORDER BY s.day) AS bank FROM s LEFT JOIN e USING (day)),
w AS (SELECT date_trunc('week', day)::DATE AS week, max_by(bank, day) AS bank FROM b GROUP BY 1) SELECT week, round(bank, 4) AS bank, round(bank / lag(bank) OVER (ORDER BY week) - 1, 6) AS ret FROM w""")
def period_returns(spark, d):
    """Weekly closes of a bankroll over a full daily spine, and their returns. Windows run over days, after rows are summed."""
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    spine = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    b = spine.join(e, "day", "left").select("day", (1000 + F.sum(F.coalesce("v", F.lit(0.0))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))).alias("bank"))
    k = b.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.max_by("bank", "day").alias("bank"))
    return k.select("week", r("bank", 4).alias("bank"), r(F.col("bank") / F.lag("bank").over(Window.orderBy("week")) - 1).alias("ret"))


@query("imputed_reach", """WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part WHERE p_partkey % 7 <> 0) SELECT p_partkey, round(CASE WHEN p_partkey % 7 = 0 THEN a + b * p_size ELSE p_retailprice END, 4) AS reach FROM part, m""")
def imputed_reach(spark, d):
    """A missing measure from a line through the known ones."""
    p = table(spark, d, "part").withColumn("known", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")))
    line = p.agg(F.regr_slope("known", "p_size").alias("b"), F.regr_intercept("known", "p_size").alias("a"))
    return p.join(F.broadcast(line)).select("p_partkey", r(F.coalesce("known", F.col("a") + F.col("b") * F.col("p_size")), 4).alias("reach"))


@query("event_props", """SELECT event_id, event_type, round(value, 6) AS value, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_prop, len(json_keys(props))::INT AS n_props, strftime(ts, '%Y-%m') AS month, dayofyear(ts)::INT AS doy FROM events""")
def event_props(spark, d):
    """Nested JSON, month keys and days of year."""
    keys = F.json_object_keys("props")
    first = F.element_at(F.from_json("props", "map<string,string>"), F.get(keys, 0))
    return table(spark, d, "events").select("event_id", "event_type", r("value").alias("value"), first.alias("first_prop"), F.size(keys).alias("n_props"), F.date_format("ts", "yyyy-MM").alias("month"), F.dayofyear("ts").alias("doy"))


@query("page_links", """SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))::INT AS n_links, len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, string_split(url, '/')[-1] AS leaf, sha1(url) AS sha FROM pages""")
def page_links(spark, d):
    """Links, titles and path segments of raw pages, and the key of a page cache."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(h, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("n_links"), F.size(F.regexp_extract_all(h, F.lit("<p[ >]"), F.lit(0))).alias("n_paragraphs"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.substring_index("url", "/", -1).alias("leaf"), F.sha1("url").alias("sha"))


@query("text_scalars", """SELECT p_partkey, lower(trim(p_name)) AS name, regexp_replace(p_name, '\\s+', ' ', 'g') AS spaced, string_split(p_type, ' ')[1] AS first_word, string_split(p_type, ' ')[-1] AS last_word, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, len(string_split(p_type, ' '))::INT AS n_words, p_brand || ' vs. ' || p_type AS bout, (p_size // 12) || '''' || (p_size % 12) AS height,
CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END AS label, least(p_size, 12) // 3 AS bucket FROM part""")
def text_scalars(spark, d):
    """Trims, splits, patterns, slugs, labels in order of precedence and buckets."""
    t = F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.lower(F.trim("p_name")).alias("name"), F.regexp_replace("p_name", r"\s+", " ").alias("spaced"), F.get(F.split(t, " "), 0).alias("first_word"), F.element_at(F.split(t, " "), -1).alias("last_word"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_no"),
        F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-").alias("slug"), F.size(F.split(t, " ")).alias("n_words"), F.concat_ws(" vs. ", "p_brand", t).alias("bout"), F.concat(F.floor(F.col("p_size") / 12).cast("string"), F.lit("'"), (F.col("p_size") % 12).cast("string")).alias("height"),
        F.when(t.contains("BRASS"), "brass").when(t.contains("STEEL"), "steel").otherwise("other").alias("label"), F.floor(F.least(F.col("p_size"), F.lit(12)) / 3).cast("int").alias("bucket"),
    )


@query("travel", """WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, radians(a.s_nationkey * 3.0::DOUBLE) AS la, radians(b.s_nationkey * 3.0::DOUBLE) AS lb, radians((b.s_suppkey % 90)::DOUBLE - (a.s_suppkey % 90)::DOUBLE) AS dl FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1) SELECT a, b, round(12742 * asin(sqrt(pow(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * pow(sin(dl / 2), 2))), 4) AS km FROM p""")
def travel(spark, d):
    """Great-circle distances of neighbours."""
    s = table(spark, d, "supplier").select("s_suppkey", F.radians(F.col("s_nationkey") * 3.0).alias("lat"), (F.col("s_suppkey") % 90).cast("double").alias("lon"))
    b = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    h = F.sin((F.col("lat2") - F.col("lat")) / 2) ** 2 + F.cos("lat") * F.cos("lat2") * F.sin(F.radians(F.col("lon2") - F.col("lon")) / 2) ** 2
    return s.join(b, "s_suppkey").select(F.col("s_suppkey").alias("a"), "b", r(12742 * F.asin(F.sqrt(h)), 4).alias("km"))


def rated_contests(spark, d) -> DataFrame:
    """Contests with what ratings are folded from: a finish, shares of four counts and the log odds of the closing line."""
    c = skill_counts(contests(spark, d))
    share = lambda a, b, least: F.when(a + b > least, a / (a + b))
    grapple = lambda s: F.coalesce(F.col(f"{s}_ctl"), F.lit(0.0)) + 30 * F.col(f"{s}_td")
    shares = {"strike": share(F.col("a_str"), F.col("b_str"), 4), "grapple": share(grapple("a"), grapple("b"), 30)} | {k: share(F.col(f"a_{k}"), F.col(f"b_{k}"), 0) for k in ("kd", "sub")}
    return c.withColumns({"finished": F.col("method") == "R", "line": staking.logit(F.col("p_close"))} | {f"share_{k}": v for k, v in shares.items()})


#: Seven statistics: what a new entity's variance is, how it grows in a year, and the usual rate for each unit of exposure.
SKILLS = {"str": (0.12, 0.03, 1.0), "td": (0.5, 0.08, 0.1), "kd": (0.5, 0.08, 0.03), "sub": (0.5, 0.08, 0.05), "ctl": (0.4, 0.08, 0.5), "kof": (0.6, 0.1, 0.02), "sbf": (0.6, 0.1, 0.01)}


def skill_counts(c: DataFrame) -> DataFrame:
    """Contests with seven counts of both sides, an exposure (missing now and then) and a group."""
    counts = {}
    for s, won in (("a", 1.0), ("b", 0.0)):
        price, score = F.col(f"{s}_price"), F.col(f"{s}_score")
        counts |= {f"{s}_str": score, f"{s}_td": F.floor(price) % 5, f"{s}_kd": F.floor(price / 7) % 2, f"{s}_sub": F.floor(price / 11) % 3, f"{s}_ctl": F.when(F.col("contest_id") % 7 != 0, score / 4)}
        counts |= {f"{s}_{k}": ((F.col("y") == won) & (F.col("method") == m)).cast("double") for k, m in (("kof", "R"), ("sbf", "A"))}
    return c.withColumns(counts | {"exposure": F.when(F.col("contest_id") % 11 != 0, 5.0 + F.col("contest_id") % 21), "group": (F.col("class") % 3).cast("int")})


@query("ratings")
def all_ratings(spark, d):
    """Elo in five settings, Glicko-2, four share ratings and a line filter of all entities, folded by date."""
    made = {"elo": folds.Elo(), "elo_finish": folds.Elo(finish=1.5, finished="finished"), "elo_fast": folds.Elo(k=80.0), "elo_decay": folds.Elo(k=32.0, decay=2.0), "elo_tuned": folds.Elo(k=90.0, decay=2.0)}
    made |= {"glicko": folds.Glicko2(), "market": folds.LineFilter()} | {f"share_{k}": folds.Elo(f"share_{k}", k=v) for k, v in (("strike", 80.0), ("grapple", 80.0), ("kd", 40.0), ("sub", 40.0))}
    return folds.folded(rated_contests(spark, d), made)


@query("elo_by_date")
def elo_by_date(spark, d):
    """Elo of both sides before each contest's date."""
    f = folds.folded(contests(spark, d), {"elo": folds.Elo()})
    return f.select("contest_id", r("a_elo", 3).alias("a_elo"), r("b_elo", 3).alias("b_elo"))


@query("linked_records")
def linked_records(spark, d):
    """Contests linked to a second source with swapped sides, shifted dates and misspelt names."""
    c = contests(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("a_id"), F.concat(F.lit("a"), F.sha1(F.col("s_suppkey").cast("string")).substr(1, 9)).alias("n1")), "a_id").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("b_id"), F.sha1(F.col("s_suppkey").cast("string")).substr(1, 9).alias("n2")), "b_id")
    left = c.select("contest_id", "date", "n1", "n2")
    right = c.select((F.col("contest_id") * 10).alias("page"), F.date_add("date", (F.col("contest_id") % 3 - 1).cast("int")).alias("date"), F.concat(F.col("n2"), F.lit("x")).alias("n1"), F.col("n1").alias("n2"))
    return match.link(left, right, "contest_id", "page")


def two_sources(spark, d, spoil: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Contests with names of two tokens, and the same from a second source: other days, sides swapped, each name as ``spoil`` (name, number) makes it."""
    digest = F.sha1(F.col("s_suppkey").cast("string"))
    name = table(spark, d, "supplier").select("s_suppkey", F.concat(digest.substr(1, 6), F.lit(" "), digest.substr(7, 9)).alias("name"))
    of = lambda key, out: name.select(F.col("s_suppkey").alias(key), F.col("name").alias(out))
    # both sources are read twice
    c = written(contests(spark, d).join(of("a_id", "n1"), "a_id").join(of("b_id", "n2"), "b_id").select("contest_id", "date", "n1", "n2"))
    k = F.col("contest_id")
    right = c.select((k * 10).alias("page"), F.when(k % 50 != 0, F.date_add("date", (k % 3 - 1).cast("int"))).alias("date"), spoil(F.col("n2"), k).alias("n1"), spoil(F.col("n1"), k + 1).alias("n2"))
    return c, right


def spoilt(name: Column, k: Column) -> Column:
    """Tokens swapped, another initial, or a hyphen."""
    x, y = F.get(F.split(name, " "), 0), F.get(F.split(name, " "), 1)
    return F.when(k % 4 == 0, F.concat(y, F.lit(" "), x)).when(k % 4 == 1, F.concat(F.lit("z"), name.substr(F.lit(2), F.length(name)))).when(k % 4 == 2, F.concat(y, F.lit("-"), x)).otherwise(name)


@query("linked_lines")
def linked_lines(spark, d):
    """Lines linked within three days at 80, with a loss for each day apart, and lines without a date to the contests of the last year."""
    left, right = two_sources(spark, d, spoilt)
    return match.link(left, right, "contest_id", "page", days=3, score=match.either_ratio, undated_from="2001-01-01")


@query("linked_quotes")
def linked_quotes(spark, d):
    """Quotes linked within two days at 85, or from 70 on if a single one has one of the names."""
    left, right = two_sources(spark, d, spoilt)
    return match.link(left, right, "contest_id", "page", days=2, threshold=85.0, penalty=0.0, weak=70.0, score=match.either_ratio)


@query("walk_forward_logit")
def walk_forward_logit(spark, d):
    """Yearly refits of a symmetric ridge logistic layer over the opening line, scored on the year after."""
    form = QUERIES["prior_form"](spark, d).select("contest_id", F.coalesce("d_rate", F.lit(0.0)).alias("d_rate"), F.coalesce(F.col("d_n") / 100.0, F.lit(0.0)).alias("d_n"))
    m = contests(spark, d).filter(F.col("y").isin(0.0, 1.0)).select("contest_id", "date", "y", staking.logit(F.col("p_open")).alias("line")).join(form, "contest_id")
    x = ["line", "d_rate", "d_n"]

    def predict(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.select("contest_id", "date", "y", learn.score_logit(x, learn.ridge_logit(learn.mirrored(train, x, "y"), x, "y", 0.1)).alias("p"))

    return learn.walk_forward(m, "date", learn.later_years(m, "date"), predict)


@query("bootstrap_gain")
def bootstrap_gain(spark, d):
    """Event-clustered bootstrap of the log loss gained by the closing line over the opening one."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    gain = evaluate.log_loss(F.col("y"), F.col("p_open")) - evaluate.log_loss(F.col("y"), F.col("p_close"))
    return evaluate.clustered_bootstrap(c, "day", gain, F.lit(1.0), 200)


_BANK = C + """, g AS (SELECT unnest([0.125::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS fraction), s AS (SELECT day, y, p_close * a_dec - 1 >= (1 - p_close) * b_dec - 1 AS on_a, CASE WHEN p_close * a_dec - 1 >= (1 - p_close) * b_dec - 1 THEN p_close ELSE 1 - p_close END AS p, CASE WHEN p_close * a_dec - 1 >= (1 - p_close) * b_dec - 1 THEN a_dec ELSE b_dec END AS price FROM contests),
k AS (SELECT *, least(greatest(fraction * 100 * (p * price - 1) / (price - 1), 0), 5.0::DOUBLE) AS stake FROM s, g WHERE p * price - 1 > 0.05::DOUBLE),
e AS (SELECT fraction, day, sum(stake) / 100 AS staked, sum(CASE WHEN y IS NULL THEN 0 WHEN y = CASE WHEN on_a THEN 1 ELSE 0 END THEN stake * (price - 1) ELSE -stake END) / 100 AS profit FROM k WHERE stake > 0 GROUP BY 1, 2),
b AS (SELECT fraction, day, sum(ln(greatest(1 + profit * least(1.0::DOUBLE, 1 / staked), 1e-9::DOUBLE))) OVER (PARTITION BY fraction ORDER BY day) AS log_bank FROM e)
SELECT fraction, day, round(log_bank, 6) AS log_bank, round(greatest(max(log_bank) OVER (PARTITION BY fraction ORDER BY day), 0) - log_bank, 6) AS down FROM b"""


@query("bankroll_paths", _BANK)
def bankroll_paths(spark, d):
    """Growth and drawdown of a bankroll in three Kelly fractions."""
    grid = contests(spark, d).select("contest_id", "day", "p_close", "a_dec", "b_dec", "y", F.explode(F.array(*(F.lit(f) for f in (0.125, 0.25, 0.5)))).alias("fraction"))
    return rounded(staking.bankroll_paths(staking.simulate(grid, "p_close", "a_dec", "b_dec", "y", 0.05, F.col("fraction")), ["fraction"]))


@query("promotion_strength", C + """, s AS (SELECT class, day, sum(round(a_price)) AS v, count(*) AS n FROM contests GROUP BY 1, 2), w AS (SELECT class, day, (coalesce(sum(v) OVER w, 0) + 10 * 1500.0::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 10) AS strength FROM s WINDOW w AS (PARTITION BY class ORDER BY day RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING))
SELECT class, day, round(strength, 4) AS strength FROM w""")
def promotion_strength(spark, d):
    """Strength of a promotion: mean rating of who met there in the three years before, shrunk to the starting rating."""
    return rounded(prior.trailing_mean(contests(spark, d), ["class"], "day", F.round("a_price"), 1095, 10.0, 1500.0), 4)


@query("promotion_names", """WITH n AS (SELECT p_partkey, trim(regexp_replace(string_split(p_brand || ' ' || (p_size % 20) || ' - ' || p_name, ' - ')[1], '[ #]*([0-9]+|[IVX]+)$', '')) AS name FROM part) SELECT p_partkey, CASE regexp_replace(name, '[ #]*[0-9]+$', '') WHEN 'Brand' THEN 'House Brand' ELSE regexp_replace(name, '[ #]*[0-9]+$', '') END AS promotion FROM n""")
def promotion_names(spark, d):
    """Canonical promotions: the part before a dash, without numbers at its end, by an alias map."""
    end = lambda c: F.regexp_replace(c, "[ #]*([0-9]+|[IVX]+)$", "")
    title = F.concat("p_brand", F.lit(" "), (F.col("p_size") % 20).cast("string"), F.lit(" - "), "p_name")
    name = end(F.trim(end(F.get(F.split(title, " - "), 0))))
    alias = F.create_map(F.lit("Brand"), F.lit("House Brand"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(alias, name), name).alias("promotion"))


_METHOD = C + """, tr AS (SELECT class, method FROM contests WHERE year(date) <= 1996), n AS (SELECT class, method, count(*) AS n FROM tr GROUP BY 1, 2), z AS (SELECT class, sum(n) AS size FROM n GROUP BY 1), h AS (SELECT method, sum(n) / (SELECT sum(n) FROM n)::DOUBLE AS share FROM n GROUP BY 1),
p AS (SELECT z.class, h.method, (coalesce(n.n, 0) + 20 * share) / (size + 20)::DOUBLE AS p FROM z CROSS JOIN h LEFT JOIN n ON n.class = z.class AND n.method = h.method)
SELECT year(date)::INT AS year, count(*) AS n, round(avg(-ln(p)), 6) AS log_loss, round(avg((p > 0.34::DOUBLE)::INT), 6) AS likely FROM contests JOIN p USING (class, method) WHERE year(date) > 1996 GROUP BY 1"""


@query("method_rates", _METHOD)
def method_rates(spark, d):
    """Shrunk rates of methods by class, learned before 1997; multiclass log loss in the years after."""
    c = contests(spark, d).select(F.year("date").alias("year"), "class", "method")
    p = evaluate.class_rates(c.filter("year <= 1996"), "class", "method")
    return rounded(c.filter("year > 1996").join(p, ["class", "method"]).groupBy("year").agg(F.count("*").alias("n"), F.avg(-F.ln("p")).alias("log_loss"), F.avg((F.col("p") > 0.34).cast("double")).alias("likely")))


@query("hypotheses", C + """, s AS (SELECT y, a_dec, b_dec, unnest([CASE WHEN p_open >= 0.5 THEN 'favourite a' ELSE 'favourite b' END, CASE WHEN p_close > p_open THEN 'steam a' ELSE 'steam b' END, CASE WHEN class = 0 THEN 'class a' END, CASE WHEN a_price > b_price THEN 'dear a' ELSE 'dear b' END]) AS bet FROM contests),
b AS (SELECT string_split(bet, ' ')[1] AS hypothesis, CASE WHEN y IS NULL THEN 0 WHEN y = CASE WHEN bet LIKE '% a' THEN 1 ELSE 0 END THEN CASE WHEN bet LIKE '% a' THEN a_dec ELSE b_dec END - 1 ELSE -1 END AS profit FROM s WHERE bet IS NOT NULL)
SELECT hypothesis, count(*) AS n, round(avg(profit), 6) AS roi, round(avg((profit > 0)::INT), 6) AS hit, round(sqrt(count(*)) * avg(profit) / stddev_samp(profit), 4) AS t FROM b GROUP BY 1""")
def hypotheses(spark, d):
    """Folk rules as flat bets, all in one pass: each contest is exploded to the rules that bet on it."""
    name = lambda label, a: F.struct(F.lit(label).alias("hypothesis"), a.alias("on_a"))
    rules = F.array(name("favourite", F.col("p_open") >= 0.5), name("steam", F.col("p_close") > F.col("p_open")), F.when(F.col("class") == 0, name("class", F.lit(True))), name("dear", F.col("a_price") > F.col("b_price")))
    b = contests(spark, d).select("y", "a_dec", "b_dec", F.explode(F.array_compact(rules)).alias("r")).select("y", "r.hypothesis", "r.on_a", F.when(F.col("r.on_a"), F.col("a_dec")).otherwise(F.col("b_dec")).alias("dec"))
    profit = F.when(F.col("y").isNull(), 0.0).when(F.col("y") == F.col("on_a").cast("double"), F.col("dec") - 1).otherwise(-1.0)
    g = b.select("hypothesis", profit.alias("profit")).groupBy("hypothesis")
    return g.agg(F.count("*").alias("n"), r(F.avg("profit")).alias("roi"), r(F.avg((F.col("profit") > 0).cast("double"))).alias("hit"), r(F.sqrt(F.count("*")) * F.avg("profit") / F.stddev_samp("profit"), 4).alias("t"))


@query("page_items", """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS names FROM pages), x AS (SELECT page_id, unnest(range(len(hrefs))) AS item, hrefs, names FROM l)
SELECT page_id, item::INT AS item, hrefs[item + 1] AS href, replace(names[item + 1], '&amp;', '&') AS name FROM x""")
def page_items(spark, d):
    """Rows of list markup as records, in order, with references resolved."""
    item = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    found = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(item), F.lit(i)).alias(n) for i, n in ((1, "href"), (2, "name"))))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("item", "x")).select("page_id", "item", F.col("x.href").alias("href"), F.replace(F.col("x.name"), F.lit("&amp;"), F.lit("&")).alias("name"))


@query("news_sentences", """WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\n\\t]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents) SELECT doc_id, count(*) AS n_sentences, sum(CASE WHEN regexp_matches(lower(sentence), '(licen[cs]e|copyright|password)') THEN 1 ELSE 0 END)::BIGINT AS n_notices, max(length(sentence))::INT AS longest FROM s GROUP BY 1""")
def news_sentences(spark, d):
    """Sentences of texts and those that hold a trigger."""
    s = F.split("text", r"(?<=[.!?])[ \n\t]+")
    hit = lambda x: F.lower(x).rlike("(licen[cs]e|copyright|password)")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.size(F.filter(s, hit)).cast("long").alias("n_notices"), F.array_max(F.transform(s, F.length)).alias("longest"))


@query("opponent_reach", "WITH RECURSIVE " + CONTESTS + """, e AS (SELECT DISTINCT class, a_id, b_id FROM contests WHERE y = 1), r AS (SELECT class, min(a_id) AS node, 0 AS depth FROM e GROUP BY class UNION SELECT e.class, b_id, depth + 1 FROM e JOIN r ON e.class = r.class AND a_id = node WHERE depth < (SELECT count(DISTINCT a_id) FROM e))
SELECT class::INT AS class, node, min(depth)::INT AS depth FROM r GROUP BY class, node""")
def opponent_reach(spark, d):
    """Whom a crawl over beaten opponents reaches in each class, until a round finds nobody new."""
    place = lambda c: F.col("class").cast("long") * F.lit(1 << 40) + F.col(c)
    e = contests(spark, d).filter("y = 1").select("class", "a_id", "b_id").distinct()
    first = e.groupBy("class").agg(F.min("a_id").alias("a_id")).select(place("a_id").alias("node"))
    found = joins.frontier(e.select(place("a_id").alias("a"), place("b_id").alias("b")), first, "a", "b")
    return found.select(F.shiftright("node", 40).cast("int").alias("class"), F.col("node").bitwiseAND(F.lit((1 << 40) - 1)).alias("node"), "depth")


@query("opponent_reach_all", "WITH RECURSIVE " + CONTESTS + """, e AS (SELECT DISTINCT a_id, b_id FROM contests WHERE y = 1), r AS (SELECT min(a_id) AS node, 0 AS depth FROM e UNION SELECT b_id, depth + 1 FROM e JOIN r ON a_id = node WHERE depth < (SELECT count(DISTINCT a_id) FROM e)) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def opponent_reach_all(spark, d):
    """Whom a crawl over beaten opponents of all classes reaches, until a round finds nobody new."""
    e = contests(spark, d).filter("y = 1").select("a_id", "b_id").distinct()
    return joins.frontier(e, e.agg(F.min("a_id").alias("node")), "a_id", "b_id")


def skills(spark, d) -> tuple[DataFrame, folds.Skills]:
    """Contests with league levels, and the model of their seven statistics."""
    counts = [f"{s}_{n}" for s in "ab" for n in SKILLS]
    c = written(skill_counts(contests(spark, d)).select("contest_id", "day", "a_id", "b_id", "group", "exposure", *counts))
    c = folds.league_levels(c, {n: (f"a_{n}", f"b_{n}", rate) for n, (*_, rate) in SKILLS.items()}, "group")
    return c, folds.Skills({n: (f"a_{n}", f"b_{n}", f"level_{n}", p0, q, 1.0) for n, (p0, q, _) in SKILLS.items()})


@query("skill_filters")
def skill_filters(spark, d):
    """Attack and defence in seven statistics, over league levels that fade, of all entities before each contest's date."""
    c, model = skills(spark, d)
    return folds.folded(c, {"skill": model})


def stacked(spark, d, years=None):
    """A stack of line and ratings over stages of a line, with interactions, learned without an intercept on mirrored rows before each year (default: all after the first)."""
    form = QUERIES["prior_form"](spark, d).select("contest_id", F.coalesce("d_rate", F.lit(0.0)).alias("model"))
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0)).join(form, "contest_id")
    stages = [i / 9 for i in (0, 3, 6, 9)]
    lines = [f"line{i}" for i in range(len(stages))]
    m = written(c.select("contest_id", "date", F.year("date").alias("year"), "y", "model", *(staking.logit(F.col("p_open") + (F.col("p_close") - F.col("p_open")) * k).alias(n) for n, k in zip(lines, stages, strict=True))))
    years = years or learn.later_years(m, "date")
    # a row's mirror image only doubles what the row gives, and its stages are made in each pass
    x = lambda line, model, k: (line, model, line * k, model * k)

    def rows(year: int, b):
        for cut in years:
            if year < cut:
                yield from ((cut, np.stack(x(line, b[1], k)), b[0], 2.0, 0.0) for line, k in zip(b[2:], stages, strict=True))

    beta = packed.logits(packed.packed(m, "year", ["y", "model", *lines]), len(lines) + 2, rows, years, np.full(4, 0.1))
    table = spark.createDataFrame([(y, b.tolist()) for y, b in beta.items()], "year int, beta array<double>")
    long = m.join(F.broadcast(table), "year").select("contest_id", "date", "y", "model", "beta", F.explode(F.array(*(F.struct(F.lit(k).alias("s"), F.col(n).alias("line")) for n, k in zip(lines, stages, strict=True)))).alias("l")).select("*", "l.*")
    eta = sum((c * F.get("beta", F.lit(i)) for i, c in enumerate(x(F.col("line"), F.col("model"), F.col("s")))), F.lit(0.0))
    return long.select("contest_id", "s", "date", "y", (1 / (1 + F.exp(-eta))).alias("p"))


@query("stage_stack")
def stage_stack(spark, d):
    """The stack in every year with an earlier one, with each contest's stages in order."""
    return stacked(spark, d).orderBy("date", "contest_id", "s")


@query("stage_stack_years")
def stage_stack_years(spark, d):
    """The stack in every year with an earlier one."""
    return stacked(spark, d)

from pairloom.plans import blocks, models, raw  # noqa: E402, F401  (their queries register themselves)
