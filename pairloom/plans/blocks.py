"""Queries over feature blocks, tests and bets, and the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import functions as P
from pairloom.operators import bankroll, evaluate, features, folds, inference, prior, staking
from pairloom.plans.catalog import SKILLS, C, bets, query, r, rounded, skills
from pairloom.plans.contests import contests, participants, table

KIND = "CASE method WHEN 'R' THEN CASE WHEN contest_id % 2 = 0 THEN 'KO' ELSE 'DOC' END WHEN 'A' THEN CASE WHEN contest_id % 13 = 0 THEN 'DQ' ELSE 'SUB' END ELSE CASE contest_id % 3 WHEN 0 THEN 'U-DEC' WHEN 1 THEN 'S-DEC' ELSE 'M-DEC' END END"
FORM = "CASE WHEN contest_id % 7 = 0 THEN 'No Limit' WHEN contest_id % 5 = 0 THEN '5 Rnd (5-5-5-5-5)' ELSE '3 Rnd (5-5-5)' END"
ROUNDS = "CASE WHEN contest_id % 7 = 0 THEN 0 WHEN contest_id % 5 = 0 THEN 5 ELSE 3 END"
SECS = "contest_id * 37 % (CASE WHEN contest_id % 5 = 0 THEN 1500 ELSE 900 END)"


def kind() -> Column:
    return F.expr(KIND)


@query("outcome_flags", C + f""", k AS (SELECT *, {KIND} AS m, ((contest_id % 5) + (contest_id % 4)) / 2.0::DOUBLE AS margin FROM sides), f AS (SELECT *, m IN ('KO', 'DOC') AS ko, m = 'SUB' AS sub, m IN ('U-DEC', 'S-DEC', 'M-DEC') AS dec FROM k)
SELECT id, count(*) AS n, sum(CASE WHEN res = 1 THEN 1 ELSE 0 END)::DOUBLE AS win, sum(CASE WHEN res = 0 THEN 1 ELSE 0 END)::DOUBLE AS loss, sum(CASE WHEN ko AND res = 1 THEN 1 ELSE 0 END)::DOUBLE AS ko_win, sum(CASE WHEN ko AND res = 0 THEN 1 ELSE 0 END)::DOUBLE AS ko_loss,
sum(CASE WHEN sub AND res = 1 THEN 1 ELSE 0 END)::DOUBLE AS sub_win, sum(CASE WHEN sub AND res = 0 THEN 1 ELSE 0 END)::DOUBLE AS sub_loss, sum(CASE WHEN dec AND res = 1 THEN 1 ELSE 0 END)::DOUBLE AS dec_win, sum(CASE WHEN dec AND res = 0 THEN 1 ELSE 0 END)::DOUBLE AS dec_loss,
sum(CASE WHEN m = 'S-DEC' AND res = 1 THEN 1 ELSE 0 END)::DOUBLE AS split_win, sum(CASE WHEN m = 'S-DEC' AND res = 0 THEN 1 ELSE 0 END)::DOUBLE AS split_loss, sum(CASE WHEN dec THEN 1 ELSE 0 END)::DOUBLE AS went_dist, sum(CASE WHEN ko OR sub THEN 1 ELSE 0 END)::DOUBLE AS finish,
round(avg(CASE WHEN dec AND res = 1 THEN margin WHEN dec AND res = 0 THEN -margin END), 6) AS margin FROM f GROUP BY id""")
def outcome_flags(spark, d):
    """Flags of wins and losses by method, and judges' margins, summed by side."""
    cards = F.concat(F.lit("20 - "), 20 + F.col("contest_id") % 5, F.lit("; 20 - "), 20 + F.col("contest_id") % 4)
    p = participants(contests(spark, d)).withColumns({"m": kind(), "margin": P.judge_margin(cards)})
    flags = features.outcome_flags(F.col("res"), F.col("m"))
    return p.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in flags.items()), r(F.avg(features.decision_margin(F.col("res"), F.col("m"), F.col("margin")))).alias("margin"))


@query("method_targets", C + f""", k AS (SELECT contest_id, y, {KIND} AS m, {FORM} LIKE '% Rnd%' AS std, {ROUNDS} AS rounds, {SECS} AS secs FROM contests), f AS (SELECT *, m IN ('KO', 'DOC', 'SUB', 'DQ') AS fin, std AND (m IN ('KO', 'DOC', 'SUB', 'DQ', 'U-DEC', 'S-DEC', 'M-DEC')) AS known FROM k)
SELECT contest_id, CASE WHEN known THEN fin::INT::DOUBLE END AS itd, CASE WHEN std AND y IS NOT NULL THEN CASE WHEN m IN ('KO', 'DOC') THEN 'KO' WHEN m = 'SUB' THEN 'SUB' WHEN m LIKE '%DEC' THEN 'DEC' END END AS meth3,
CASE WHEN known AND rounds > 1 THEN (fin AND secs < 450)::INT::DOUBLE END AS under_1, CASE WHEN known AND rounds > 2 THEN (fin AND secs < 750)::INT::DOUBLE END AS under_2, CASE WHEN known AND rounds > 3 THEN (fin AND secs < 1050)::INT::DOUBLE END AS under_3, CASE WHEN known AND rounds > 4 THEN (fin AND secs < 1350)::INT::DOUBLE END AS under_4,
round(CASE WHEN y IN (0, 1) THEN CASE WHEN m IN ('S-DEC', 'DQ') THEN CASE WHEN y = 1 THEN 0.7 ELSE 0.3 END WHEN m = 'M-DEC' THEN CASE WHEN y = 1 THEN 0.85 ELSE 0.15 END ELSE y END ELSE y END, 6)::DOUBLE AS soft FROM f""")
def method_targets(spark, d):
    """Targets of method and time markets, and softened winners."""
    c = contests(spark, d).select("contest_id", "y", kind().alias("m"), F.expr(FORM).alias("form"), F.expr(ROUNDS).alias("rounds"), F.expr(SECS).alias("secs"))
    t = features.targets(F.col("m"), F.col("y"), F.col("form"), F.col("rounds"), F.col("secs"))
    return c.select("contest_id", *(x.alias(n) for n, x in t.items()), r(features.soft_label(F.col("y"), F.col("m"))).alias("soft"))


@query("record_block", C + """, rec AS (SELECT id, opp, day, res, method = 'R' AS ko, method = 'A' AS sub, class = 1 AS top FROM sides), debut AS (SELECT id, min(day) AS first_top FROM rec WHERE top GROUP BY id),
j AS (SELECT s.contest_id, s.side, s.day AS d0, q.*, e.first_top FROM sides s LEFT JOIN rec q ON q.id = s.id AND q.day < s.day - 3 LEFT JOIN debut e ON e.id = q.opp),
k AS (SELECT contest_id, side, row_number() OVER (PARTITION BY contest_id, side ORDER BY day DESC, opp DESC, ko DESC, sub DESC, res DESC) AS i, res FROM j WHERE res IS NOT NULL),
l AS (SELECT contest_id, side, avg(res) FILTER (WHERE i <= 5) AS last5, CASE max(CASE WHEN i = 1 THEN res END) WHEN 1 THEN coalesce(min(i) FILTER (WHERE res <> 1) - 1, max(i)) WHEN 0 THEN -coalesce(min(i) FILTER (WHERE res <> 0) - 1, max(i)) ELSE 0 END AS streak FROM k GROUP BY ALL)
SELECT contest_id, side, count(id) AS n, coalesce(sum(CASE WHEN res = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS wins, round((coalesce(sum(CASE WHEN res = 1 THEN 1 ELSE 0 END), 0) + 1) / (coalesce(sum(CASE WHEN res IN (0, 1) THEN 1 ELSE 0 END), 0) + 2.0::DOUBLE), 6) AS winrate, coalesce(sum(CASE WHEN ko AND res = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS ko_wins,
round(coalesce(sum(CASE WHEN (ko OR sub) AND res = 1 THEN 1 ELSE 0 END), 0) / greatest(coalesce(sum(CASE WHEN res = 1 THEN 1 ELSE 0 END), 0), 1)::DOUBLE, 6) AS finish_rate, count(id) FILTER (WHERE NOT top) AS other_n, round(CASE WHEN count(id) > 0 THEN (min(d0) - min(day)) / 365.25::DOUBLE ELSE 0 END, 6) AS years,
(min(d0) - max(day))::INT AS idle, count(id) FILTER (WHERE day > d0 - 730) AS n_2y, count(id) FILTER (WHERE res = 1 AND first_top < d0 - 3) AS top_wins, round(min(last5), 6) AS last5, coalesce(min(streak), 0)::BIGINT AS streak FROM j LEFT JOIN l USING (contest_id, side) GROUP BY contest_id, side""")
def record_block(spark, d):
    """A side's record up to four days before: counts, rates, form, and wins over those who had been in the top class by then."""
    p = participants(contests(spark, d))
    rec = p.select("contest_id", "side", "id", "opp", "day", "res", (F.col("method") == "R").alias("ko"), (F.col("method") == "A").alias("sub"), (F.col("class") == 1).alias("top"))
    won = F.col("res") == 1
    some = lambda c: F.coalesce(c, F.lit(0))
    count = lambda c: some(F.sum(F.when(c, 1).otherwise(0)).over(w))
    # a win counts from the day on which the beaten side had been in the top class, if that is later
    debut = rec.filter("top").groupBy(F.col("id").alias("opp")).agg(F.min("day").alias("first_top"))
    beaten = rec.filter(won).join(debut, "opp").select("id", F.greatest("day", "first_top").alias("day"), F.lit(1).alias("one"))
    # rows are their own events, so that they go through one window; only wins that count later are rows of their own
    known = features.states(rec, ["id"], "day", ["opp", "ko", "sub", "res"], "res")
    events = known.unionByName(rec.filter("res IS NULL"), allowMissingColumns=True).drop("opp").unionByName(beaten, allowMissingColumns=True)
    w, older = prior.before(["id"], guard=4), prior.before(["id"], guard=730)
    fought = F.col("contest_id").isNotNull()
    n = lambda w: some(F.sum(F.when(fought, 1)).over(w))
    latest = F.max(F.when(F.col("state").isNotNull(), F.struct("day", "state"))).over(w)
    j = events.select(
        "contest_id", "side", "day", n(w).alias("n"), count(won).alias("wins"), count(F.col("res").isin(0.0, 1.0)).alias("decided"), count(F.col("ko") & won).alias("ko_wins"), count((F.col("ko") | F.col("sub")) & won).alias("finishes"),
        count(~F.col("top")).alias("other_n"), F.min(F.when(fought, F.col("day"))).over(w).alias("first"), F.max(F.when(fought, F.col("day"))).over(w).alias("latest"), (n(w) - n(older)).alias("n_2y"), some(F.sum("one").over(w)).alias("top_wins"), latest.alias("s"),
    ).filter(fought)
    return j.select(
        "contest_id", "side", F.col("n").cast("long").alias("n"), F.col("wins").cast("long").alias("wins"), r((F.col("wins") + 1) / (F.col("decided") + 2)).alias("winrate"), F.col("ko_wins").cast("long").alias("ko_wins"), r(F.col("finishes") / F.greatest("wins", F.lit(1))).alias("finish_rate"),
        F.col("other_n").cast("long").alias("other_n"), r(F.when(F.col("n") > 0, (F.col("day") - F.col("first")) / 365.25).otherwise(0.0)).alias("years"), (F.col("day") - F.col("latest")).alias("idle"), F.col("n_2y").cast("long").alias("n_2y"), F.col("top_wins").cast("long").alias("top_wins"),
        r("s.state.mean").alias("last5"), F.coalesce("s.state.streak", F.lit(0)).cast("long").alias("streak"),
    )


@query("career_blocks", C + """, x AS (SELECT *, score / 25 AS early, CASE WHEN contest_id % 3 = 0 THEN opp_score / 20 END AS late, contest_id % 300 AS secs, 5 + contest_id % 10 AS mins, CASE WHEN contest_id % 4 <> 0 THEN score - opp_score END AS adj FROM sides),
j AS (SELECT t.contest_id, t.side, t.day AS d0, p.* EXCLUDE (contest_id, side) FROM x t LEFT JOIN x p ON p.id = t.id AND p.day < t.day)
SELECT contest_id, side, round(CASE WHEN count(id) > 1 THEN (max(day) - min(day)) / (count(id) - 1.0::DOUBLE) END, 6) AS mean_gap, count(id) FILTER (WHERE day >= d0 - 730) AS n_730, min(CASE WHEN res = 0 THEN opp_score END) AS worst_loss, max(CASE WHEN res = 1 THEN opp_score END) AS best_win,
round(coalesce(sum(adj * mins), 0) / (coalesce(sum(CASE WHEN adj IS NOT NULL THEN mins END), 0) + 12.0::DOUBLE), 6) AS adj, round((sum(late * secs) FILTER (WHERE secs > 60) / sum(secs) FILTER (WHERE secs > 60 AND late IS NOT NULL) + 1) / (sum(early * 300) FILTER (WHERE secs > 60 AND late IS NOT NULL) / sum(300.0::DOUBLE) FILTER (WHERE secs > 60 AND late IS NOT NULL) + 1), 6) AS late_ratio
FROM j GROUP BY contest_id, side""")
def career_blocks(spark, d):
    """Mean gaps, two-year counts, extremes by result, weighted residuals and the ratio of late to early output."""
    k = F.col("contest_id")
    x = participants(contests(spark, d)).withColumns({"early": F.col("score") / 25, "late": F.when(k % 3 == 0, F.col("opp_score") / 20), "secs": k % 300, "mins": 5 + k % 10, "adj": F.when(k % 4 != 0, F.col("score") - F.col("opp_score"))})
    w, n = prior.before(["id"]), F.count("*").over(prior.before(["id"]))
    return x.select(
        "contest_id", "side", r(F.when(n > 1, (F.max("day").over(w) - F.min("day").over(w)) / (n - 1))).alias("mean_gap"), F.count("*").over(prior.before(["id"], days=730)).alias("n_730"),
        F.min(F.when(F.col("res") == 0, F.col("opp_score"))).over(w).alias("worst_loss"), F.max(F.when(F.col("res") == 1, F.col("opp_score"))).over(w).alias("best_win"),
        r(features.weighted(F.col("adj"), F.col("mins").cast("double"), w, 12.0)).alias("adj"), r(features.late_ratio(F.col("early"), F.lit(300.0), F.col("late"), F.col("secs"), w)).alias("late_ratio"),
    )


def assembly(spark, d) -> DataFrame:
    """Blocks that hold different contests, outer-joined, with products, gaps and halves."""
    c = contests(spark, d)
    k = F.col("contest_id")
    form = c.filter(k % 4 != 0).select("contest_id", *((F.col(f"{s}_score") / 50).alias(f"{s}_rate") for s in "ab"), *((F.col(f"{s}_price") / 1e5).alias(f"{s}_def") for s in "ab"))
    flags = c.filter(k % 3 != 0).select("contest_id", (k % 2).cast("double").alias("a_flag"), (k % 5).cast("double").alias("b_flag"))
    line = c.filter(k % 5 != 0).select("contest_id", staking.logit(F.col("p_open")).alias("line"), F.lit(0.1).alias("a_mr"), F.lit(-0.1).alias("b_mr"))
    j = features.assembled([form, flags, line], "contest_id")
    j = features.versus(j, {"mu_rate": lambda x, y: F.col(x + "rate") * (1 - F.col(y + "def")), "mu_flag": lambda x, y: F.coalesce(F.col(x + "flag"), F.lit(0.0)) * F.coalesce(F.col(y + "rate"), F.lit(0.0))})
    gap = F.col("line") - (F.col("a_mr") - F.col("b_mr"))
    return j.withColumns({"a_line_gap": gap / 2, "b_line_gap": -gap / 2})


@query("assembled", C + """, form AS (SELECT contest_id, a_score / 50 AS ar, b_score / 50 AS br, a_price / 100000 AS ad, b_price / 100000 AS bd FROM contests WHERE contest_id % 4 <> 0), flags AS (SELECT contest_id, (contest_id % 2)::DOUBLE AS af, (contest_id % 5)::DOUBLE AS bf FROM contests WHERE contest_id % 3 <> 0),
line AS (SELECT contest_id, ln(greatest(least(p_open, 0.9999), 0.0001) / (1 - greatest(least(p_open, 0.9999), 0.0001))) AS line FROM contests WHERE contest_id % 5 <> 0),
j AS (SELECT * FROM form FULL JOIN flags USING (contest_id) FULL JOIN line USING (contest_id))
SELECT contest_id, round((ar * (1 - bd) - br * (1 - ad)) / 2, 6) AS a_mu_rate, round((coalesce(af, 0) * coalesce(br, 0) - coalesce(bf, 0) * coalesce(ar, 0)) / 2, 6) AS a_mu_flag, round((line - 0.2) / 2, 6)::DOUBLE AS a_line_gap, round((0.2 - line) / 2, 6)::DOUBLE AS b_line_gap FROM j""")
def assembled(spark, d):
    """Full outer assembly of blocks, matchup products and the line's gap to its history."""
    return rounded(assembly(spark, d).select("contest_id", "a_mu_rate", "a_mu_flag", "a_line_gap", "b_line_gap"))


@query("promotion_block", C + """, s AS (SELECT class, day, sum(round(a_price)) AS v, count(*) AS n FROM contests GROUP BY 1, 2), w AS (SELECT class, day, (coalesce(sum(v) OVER w, 0) + 10 * 1500.0::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 10) AS strength FROM s WINDOW w AS (PARTITION BY class ORDER BY day RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
p AS (SELECT sides.*, strength FROM sides JOIN w USING (class, day)), j AS (SELECT t.contest_id, t.side, p.day, p.contest_id AS c2, p.strength, p.res, p.class, row_number() OVER (PARTITION BY t.contest_id, t.side ORDER BY p.day DESC, p.contest_id DESC) AS i FROM sides t JOIN p ON p.id = t.id AND p.day < t.day - 3)
SELECT s.contest_id, s.side, round(avg(j.strength) FILTER (WHERE i <= 5), 4) AS str_last5, round(max(j.strength) FILTER (WHERE j.res = 1), 4) AS str_max_win, round(coalesce(sum(greatest(j.strength - 1500, 0)) FILTER (WHERE j.res = 1), 0) / 100, 4) AS strong_wins, count(*) FILTER (WHERE j.class IN (1, 2)) AS major_n
FROM sides s LEFT JOIN j ON j.contest_id = s.contest_id AND j.side = s.side GROUP BY s.contest_id, s.side""")
def promotion_block(spark, d):
    """Strength of the promotions that a side has been in: last five, best won, and the sum of strong wins."""
    c = contests(spark, d)
    strength = prior.trailing_mean(c, ["class"], "day", F.round("a_price"), 1095, 10.0, 1500.0)
    p = participants(c)
    e = p.join(strength, ["class", "day"]).select("id", "day", "contest_id", "res", "class", "strength")
    o = Window.partitionBy("id").orderBy("day", "contest_id").rowsBetween(-4, 0)
    last = e.select("id", "day", F.struct("contest_id", F.avg("strength").over(o).alias("mean")).alias("m")).groupBy("id", "day").agg(F.max("m").alias("m"))
    rows = p.select("contest_id", "side", "id", "day")
    won = F.col("res") == 1
    a = features.history(rows, e.drop("contest_id"), ["id"], "day", {"str_max_win": lambda w: F.max(F.when(won, F.col("strength"))).over(w), "strong_wins": lambda w: F.coalesce(F.sum(F.when(won, F.greatest(F.col("strength") - 1500, F.lit(0.0)))).over(w), F.lit(0.0)) / 100, "major_n": lambda w: F.coalesce(F.sum(F.when(F.col("class").isin(1, 2), 1)).over(w), F.lit(0))}, guard=4)
    b = features.history(rows, last, ["id"], "day", {"l": lambda w: F.max(F.when(F.col("m").isNotNull(), F.struct("day", "m"))).over(w)}, guard=4)
    return a.join(b, ["contest_id", "side", "id", "day"]).select("contest_id", "side", r("l.m.mean", 4).alias("str_last5"), r("str_max_win", 4).alias("str_max_win"), r("strong_wins", 4).alias("strong_wins"), F.col("major_n").cast("long").alias("major_n"))


@query("six_way_prices", """WITH q AS (SELECT l_orderkey // 4 AS bout, l_suppkey % 2 AS book, l_linenumber AS outcome, max(1 + l_quantity / 5) AS price FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL), o AS (SELECT *, count(*) OVER (PARTITION BY bout, book) AS k, sum(1 / price) OVER (PARTITION BY bout, book) AS over FROM q)
SELECT bout, outcome, count(*) AS books, round(avg(1 / price / over), 6) AS fair, round(median(over), 6) AS overround, round(max(price), 6) AS best FROM o WHERE k = 6 GROUP BY bout, outcome""")
def six_way_prices(spark, d):
    """Fair shares of six outcomes from books that quote all six."""
    l = table(spark, d, "lineitem").filter("l_linenumber <= 6")  # noqa: E741
    q = l.groupBy(F.floor(F.col("l_orderkey") / 4).alias("bout"), (F.col("l_suppkey") % 2).alias("book"), F.col("l_linenumber").alias("outcome")).agg(F.max(1 + F.col("l_quantity") / 5).alias("price"))
    w = Window.partitionBy("bout", "book")
    o = q.withColumns({"k": F.count("*").over(w), "over": F.sum(1 / F.col("price")).over(w)}).filter("k = 6")
    return rounded(o.groupBy("bout", "outcome").agg(F.count("*").alias("books"), F.avg(1 / F.col("price") / F.col("over")).alias("fair"), F.median("over").alias("overround"), F.max("price").alias("best")))


@query("predictive_scores", C + """SELECT class, round(avg(a_score * ln(20 + b_score / 10) - (20 + b_score / 10) - lgamma(a_score + 1)), 6) AS poisson, round(avg(-0.9189385332046727 - ln(0.04::DOUBLE) / 2 - (p_close - p_open) * (p_close - p_open) / (2 * 0.04::DOUBLE)), 6) AS gauss FROM contests GROUP BY class""")
def predictive_scores(spark, d):
    """Mean log likelihoods of counts and of lines."""
    poisson = P.poisson_log_probability(F.col("a_score"), 20 + F.col("b_score") / 10)
    gauss = P.gaussian_log_density(F.col("p_close"), F.col("p_open"), F.lit(0.04))
    return contests(spark, d).groupBy("class").agg(r(F.avg(poisson)).alias("poisson"), r(F.avg(gauss)).alias("gauss"))


@query("z_scores", C + """, m AS (SELECT class, avg(a_price) AS m, stddev_pop(a_price) AS s FROM contests WHERE contest_id % 6 <> 0 GROUP BY class) SELECT contest_id, round(CASE WHEN contest_id % 6 <> 0 THEN (a_price - m) / s END, 6) AS z, CASE WHEN contest_id % 6 <> 0 THEN 0.0::DOUBLE END AS flat FROM contests JOIN m USING (class)""")
def z_scores(spark, d):
    """Standardised by class; missing values stay missing, and what doesn't vary is zero."""
    c = contests(spark, d).select("contest_id", "class", F.when(F.col("contest_id") % 6 != 0, F.col("a_price")).alias("x"), F.when(F.col("contest_id") % 6 != 0, F.lit(3.0)).alias("k"))
    of = c.groupBy("class").agg(*(f(v).alias(f"{n}_{v}") for v in ("x", "k") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    z = lambda v: P.z_score(F.col(v), F.col(f"mean_{v}"), F.col(f"sd_{v}"))
    return c.join(of, "class").select("contest_id", r(z("x")).alias("z"), z("k").alias("flat"))


@query("paired_gain", C + """, g AS (SELECT class, -(y * ln(p_open) + (1 - y) * ln(1 - p_open)) + (y * ln(p_close) + (1 - y) * ln(1 - p_close)) AS g FROM contests WHERE y IN (0, 1)) SELECT class, count(*) AS n, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd, round(avg(g) / stddev_samp(g) * sqrt(count(*)), 5) AS t FROM g GROUP BY class""")
def paired_gain(spark, d):
    """Mean, deviation and t of the log loss that the closing line gains over the opening one."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    return inference.paired(c, ["class"], evaluate.log_loss(F.col("y"), F.col("p_open")) - evaluate.log_loss(F.col("y"), F.col("p_close"))).select("class", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("t", 5).alias("t"))


@query("gain_interval")
def gain_interval(spark, d):
    """Bootstrap interval of that gain over single contests."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    return inference.paired_bootstrap(c, "contest_id", evaluate.log_loss(F.col("y"), F.col("p_open")) - evaluate.log_loss(F.col("y"), F.col("p_close")), 200)


@query("win_counts", C + """, n AS (SELECT class, count(*)::DOUBLE AS n, sum(y) AS wins FROM contests WHERE y IN (0, 1) GROUP BY class), k AS (SELECT class, n, wins, i, exp(lgamma(n + 1) - lgamma(i + 1.0) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE)) AS p FROM n, unnest(range(0, n::BIGINT + 1)) u(i))
SELECT class, n, wins, round(wins / n, 6) AS rate, round(least(sum(CASE WHEN p <= o * (1 + 1e-7) THEN p ELSE 0 END), 1), 6) AS p FROM k JOIN (SELECT class, p AS o FROM k WHERE i = wins) USING (class) GROUP BY class, n, wins""")
def win_counts(spark, d):
    """Exact test that side a wins half of the contests."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    return inference.binomial(c, ["class"], F.col("y")).select("class", "n", "wins", r("rate").alias("rate"), r("p").alias("p"))


@query("residual_scan")
def residual_scan(spark, d):
    """Each of several features as a correction to the closing line, in all classes at once: coefficient, Wald and likelihood-ratio tests."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    names = {"steam": staking.logit(F.col("p_close")) - staking.logit(F.col("p_open")), "price": (F.col("a_price") - F.col("b_price")) / 1e5, "parity": (F.col("contest_id") % 2).cast("double") - 0.5, "score": (F.col("a_score") - F.col("b_score")) / 50}
    long = c.select("class", "y", staking.logit(F.col("p_close")).alias("line"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), x.alias("x")) for n, x in names.items()))).alias("f")).select("class", "y", "line", "f.*")
    return inference.offset_scan(long, ["feature", "class"], "y", "line", "x")


@query("line_slopes", C + """, l AS (SELECT class, y, ln(greatest(least(p_open, 0.9999), 0.0001) / (1 - greatest(least(p_open, 0.9999), 0.0001))) AS l FROM contests WHERE y IN (0, 1)), s AS (SELECT class, k / 10.0::DOUBLE AS slope, avg(-(y * ln(greatest(least(1 / (1 + exp(-k / 10.0::DOUBLE * l)), 0.999999), 0.000001)) + (1 - y) * ln(1 - greatest(least(1 / (1 + exp(-k / 10.0::DOUBLE * l)), 0.999999), 0.000001)))) AS loss FROM l, unnest(range(0, 21)) u(k) GROUP BY ALL)
SELECT class, slope, round(loss, 6) AS loss FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(loss, 12), slope) = 1""")
def line_slopes(spark, d):
    """The factor on the opening line's log odds that fits each class best."""
    c = contests(spark, d).filter(F.col("y").isin(0.0, 1.0))
    return rounded(inference.best_slope(c, ["class"], "y", "p_open", [k / 10 for k in range(21)]))


@query("market_margins", C + """, m AS (SELECT year(date) AS year, CASE WHEN greatest(p_close, 1 - p_close) < 0.55 THEN 'even' WHEN greatest(p_close, 1 - p_close) < 0.65 THEN 'light' ELSE 'heavy' END AS band, 1 / a_close + 1 / b_close AS over, abs(p_close - p_open) AS moved FROM contests)
SELECT year, band, count(*) AS n, round(median(over), 6) AS margin, round(avg(moved), 6) AS moved FROM m GROUP BY year, band""")
def market_margins(spark, d):
    """Median overround and mean movement by year and strength of the favourite."""
    f = F.greatest("p_close", 1 - F.col("p_close"))
    band = F.when(f < 0.55, "even").when(f < 0.65, "light").otherwise("heavy")
    m = contests(spark, d).select(F.year("date").alias("year"), band.alias("band"), (1 / F.col("a_close") + 1 / F.col("b_close")).alias("over"), F.abs(F.col("p_close") - F.col("p_open")).alias("moved"))
    return m.groupBy("year", "band").agg(F.count("*").alias("n"), r(F.median("over")).alias("margin"), r(F.avg("moved")).alias("moved"))


_BY_YEAR = """, e AS (SELECT *, p_close * a_dec - 1 >= (1 - p_close) * b_dec - 1 AS on_a FROM contests), s AS (SELECT class, year(date) AS year, CASE WHEN on_a THEN p_close ELSE 1 - p_close END AS p, CASE WHEN on_a THEN a_dec ELSE b_dec END AS price, CASE WHEN on_a THEN y ELSE 1 - y END AS won FROM e),
k AS (SELECT *, least(greatest(25 * (p * price - 1) / (price - 1), 0), 5) AS stake FROM s WHERE p * price - 1 > 0.02), b AS (SELECT class, year, stake, CASE WHEN won IS NULL THEN 0 WHEN won = 1 THEN stake * (price - 1) ELSE -stake END AS profit FROM k WHERE stake > 0)"""


@query("years_positive", C + _BY_YEAR + """, y AS (SELECT class, year, sum(profit) AS profit, sum(profit) / sum(stake) AS roi FROM b GROUP BY ALL) SELECT class, count(*) FILTER (WHERE profit > 0) || '/' || count(*) AS years_up, round(min(roi), 6) AS worst, round(max(roi), 6) AS best FROM y GROUP BY class""")
def years_positive(spark, d):
    """In how many of the years each class's bets paid, and the worst and best return."""
    y = bets(spark, d).groupBy("class", "year").agg(F.sum("profit").alias("profit"), (F.sum("profit") / F.sum("stake")).alias("roi"))
    return y.groupBy("class").agg(F.concat_ws("/", F.count_if(F.col("profit") > 0).cast("string"), F.count("*").cast("string")).alias("years_up"), r(F.min("roi")).alias("worst"), r(F.max("roi")).alias("best"))


@query("stage_bets", C + """, s AS (SELECT contest_id, y, p_close, i AS stage, p_open + (p_close - p_open) * i / 9.0::DOUBLE AS p FROM contests, (VALUES (0), (3), (6), (9)) v(i)), m AS (SELECT *, p_close AS q, 1 / (p * CASE WHEN stage <= 3 THEN 1.045 ELSE 1.035 END::DOUBLE) AS da, 1 / ((1 - p) * CASE WHEN stage <= 3 THEN 1.045 ELSE 1.035 END::DOUBLE) AS db FROM s),
e AS (SELECT *, q * da - 1 >= (1 - q) * db - 1 AS on_a FROM m), k AS (SELECT stage, CASE WHEN on_a THEN q ELSE 1 - q END AS bp, CASE WHEN on_a THEN da ELSE db END AS price, CASE WHEN on_a THEN y ELSE 1 - y END AS won, CASE WHEN on_a THEN 1 / (p_close * 1.035) ELSE 1 / ((1 - p_close) * 1.035) END::DOUBLE AS closing FROM e),
b AS (SELECT *, least(greatest(25 * (bp * price - 1) / (price - 1), 0), 5) AS stake FROM k WHERE bp * price - 1 > 0.02)
SELECT stage, count(*) AS n, round(sum(stake), 4) AS staked, round(sum(CASE WHEN won IS NULL THEN 0 WHEN won = 1 THEN stake * (price - 1) ELSE -stake END) / sum(stake), 6) AS roi, round(avg(price / closing - 1), 6) AS clv, round(avg(CASE WHEN price / closing > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS beat FROM b WHERE stake > 0 GROUP BY stage""")
def stage_bets(spark, d):
    """Bets at the prices of four stages of the line, and how they fare against the close."""
    c = contests(spark, d).select("contest_id", "y", "p_close", "p_open", F.explode(F.array(*map(F.lit, (0, 3, 6, 9)))).alias("stage"))
    p = F.col("p_open") + (F.col("p_close") - F.col("p_open")) * F.col("stage") / 9.0
    m = F.when(F.col("stage") <= 3, 1.045).otherwise(1.035)
    c = c.select("*", (1 / (p * m)).alias("da"), (1 / ((1 - p) * m)).alias("db"))
    b = staking.simulate(c, "p_close", "da", "db", "y", edge=0.02)
    closing = 1 / (F.when(F.col("side") == "a", F.col("p_close")).otherwise(1 - F.col("p_close")) * 1.035)
    clv = F.col("price") / closing - 1
    return b.groupBy("stage").agg(F.count("*").alias("n"), r(F.sum("stake"), 4).alias("staked"), r(F.sum("profit") / F.sum("stake")).alias("roi"), r(F.avg(clv)).alias("clv"), r(F.avg((clv > 0).cast("double"))).alias("beat"))


MARKETS = ["dec", "under_1", "under_2", "a_ko", "b_ko", "a_sub", "b_dec", "a_itd"]


@query("prop_bets", C + f""", x AS (SELECT contest_id, y, outcome, {KIND} AS m, {SECS} AS secs, market, 0.2::DOUBLE + 0.1 * ((contest_id + length(market)) % 6) AS p, 1.5::DOUBLE + (contest_id * length(market) % 30) / 10 AS price FROM contests, unnest({MARKETS}) u(market)),
s AS (SELECT *, CASE WHEN y IS NULL AND outcome <> 'D/D' THEN NULL WHEN market = 'dec' THEN m LIKE '%DEC' WHEN market LIKE 'under%' THEN m IN ('KO', 'DOC', 'SUB', 'DQ') AND secs < right(market, 1)::INT * 300 + 150 ELSE coalesce(CASE WHEN market LIKE 'a%' THEN y = 1 ELSE y = 0 END, false) AND CASE split_part(market, '_', 2) WHEN 'ko' THEN m IN ('KO', 'DOC') WHEN 'sub' THEN m = 'SUB' WHEN 'dec' THEN m LIKE '%DEC' ELSE m IN ('KO', 'DOC', 'SUB', 'DQ') END END AS yes FROM x),
b AS (SELECT *, least(greatest(25 * (p * price - 1) / (price - 1), 0), 3) AS stake FROM s WHERE p * price - 1 > 0.05)
SELECT market, count(*) AS n, count(*) FILTER (WHERE yes) AS hits, count(*) FILTER (WHERE yes IS NULL) AS void, round(sum(stake), 4) AS staked, round(sum(CASE WHEN yes IS NULL THEN 0 WHEN yes THEN stake * (price - 1) ELSE -stake END), 4) AS profit FROM b WHERE stake >= 0.25 GROUP BY market""")
def prop_bets(spark, d):
    """Bets on methods and times, settled by what happened."""
    size = F.length("market")
    c = contests(spark, d).select("contest_id", "y", "outcome", kind().alias("m"), F.expr(SECS).alias("secs"), F.explode(F.array(*map(F.lit, MARKETS))).alias("market"))
    c = c.withColumns({"p": 0.2 + 0.1 * ((F.col("contest_id") + size) % 6), "price": 1.5 + (F.col("contest_id") * size % 30) / 10, "yes": staking.settled(F.col("market"), F.col("y"), F.col("outcome"), F.col("m"), F.col("secs"))})
    b = staking.value_bets(c, "p", "price", "yes", 0.05, 0.25, 3.0, least=0.25)
    return b.groupBy("market").agg(F.count("*").alias("n"), F.count_if(F.col("yes") == 1).alias("hits"), F.count_if(F.col("yes").isNull()).alias("void"), r(F.sum("stake"), 4).alias("staked"), r(F.sum("profit"), 4).alias("profit"))


@query("whole_history_policy", C + """, grid AS (SELECT row_number() OVER (ORDER BY edge, fraction) AS policy, * FROM (VALUES (0.0::DOUBLE), (0.04), (0.08)) a(edge), (VALUES (0.1::DOUBLE), (0.5)) b(fraction)),
s AS (SELECT CASE WHEN p_close * a_dec >= (1 - p_close) * b_dec THEN p_close ELSE 1 - p_close END AS p, CASE WHEN p_close * a_dec >= (1 - p_close) * b_dec THEN a_dec ELSE b_dec END AS price, CASE WHEN p_close * a_dec >= (1 - p_close) * b_dec THEN y ELSE 1 - y END AS won FROM contests),
k AS (SELECT policy, won, price, least(greatest(fraction * 100 * (p * price - 1) / (price - 1), 0), 5) AS stake FROM s, grid WHERE p * price - 1 > edge)
SELECT policy, count(*) AS n, round(sum(ln(1 + CASE WHEN won IS NULL THEN 0 WHEN won = 1 THEN stake * (price - 1) ELSE -stake END / 100)), 4) AS growth FROM k WHERE stake > 0 GROUP BY policy HAVING count(*) >= 150 ORDER BY round(sum(ln(1 + CASE WHEN won IS NULL THEN 0 WHEN won = 1 THEN stake * (price - 1) ELSE -stake END / 100)), 9) DESC, policy LIMIT 1""")
def whole_history_policy(spark, d):
    """The policy of a small grid that grew most over all years."""
    cells = [(e, f) for e in (0.0, 0.04, 0.08) for f in (0.1, 0.5)]
    grid = F.explode(F.array(*(F.struct(F.lit(i + 1).cast("long").alias("policy"), F.lit(e).alias("edge"), F.lit(f).alias("fraction")) for i, (e, f) in enumerate(cells))))
    c = contests(spark, d).select("contest_id", "day", F.year("date").alias("year"), "p_close", "a_dec", "b_dec", "y", grid.alias("g")).select("*", "g.*")
    b = staking.simulate(c, "p_close", "a_dec", "b_dec", "y", F.col("edge"), F.col("fraction"))
    s = staking.summary(b, ["policy", "year"], ["day", "contest_id"]).select("policy", "year", "n", "max_drawdown")
    g = b.groupBy("policy", "year").agg(F.sum(F.log1p(F.col("profit") / 100)).alias("growth"))
    return staking.best_policy(s.join(g, ["policy", "year"])).select("policy", "n", r("growth", 4).alias("growth"))


@query("any_week_starts", C + _BY_YEAR.replace("class, year(date) AS year", "class, day") .replace("SELECT class, year, stake", "SELECT class, day, stake") + """, g AS (SELECT class, day, sum(ln(1 + profit / 100)) AS g FROM b GROUP BY ALL), span AS (SELECT class, min(day) AS lo, max(day) AS hi FROM g GROUP BY class HAVING max(day) - min(day) >= 7),
m AS (SELECT class, start, horizon FROM span, LATERAL (SELECT unnest(range(lo::BIGINT, hi::BIGINT + 1)) AS start), (VALUES (7), (30), (91), (365)) h(horizon) WHERE (start - 4) % 7 = 0 AND start + horizon <= hi + 1)
SELECT m.class, m.start::INT AS start, horizon::INT AS horizon, round(coalesce(sum(g), 0), 6) AS growth FROM m LEFT JOIN g ON g.class = m.class AND g.day >= m.start AND g.day < m.start + horizon GROUP BY ALL""")
def any_week_starts(spark, d):
    """Growth from every Monday over four horizons."""
    days = bets(spark, d).groupBy("class", "day").agg(F.sum(F.log1p(F.col("profit") / 100)).alias("growth"))
    return rounded(staking.starts(days, ["class"], [7, 30, 91, 365]))


@query("bankroll_systems")
def bankroll_systems(spark, d):
    """Bankrolls of each class and of all bets in three systems, placed 14, 3 and 0 days ahead, and with a cap, a least stake and deposits."""
    b = bets(spark, d).withColumns({"month": F.year("date") * 12 + F.month("date"), "units": F.when(F.col("stake") >= 0.25, F.round(F.col("stake") * 2) / 2), "gain": F.col("profit") / F.col("stake")})
    made = {f"{name} {lead}": bankroll.System(start, unit, lead=lead) for name, start, unit in (("hundreds", 100.0, bankroll.whole_hundreds), ("bold", 200.0, bankroll.bold), ("flat", 100.0, bankroll.one)) for lead in (14, 3, 0)}
    made["saver"] = bankroll.System(300.0, bankroll.whole_hundreds, lead=3, least=1.0, most=50.0, deposit=25.0)
    each = b.select(F.explode(F.array(F.lit(-1), F.col("class").cast("int"))).alias("class"), "day", "month", "units", "gain")
    return bankroll.bankrolls(each, made, ["class"], "day", "month", "units", "gain")


@query("resampled_paths")
def resampled_paths(spark, d):
    """Percentiles of growth and deepest fall over paths of 36 months drawn from the months of all bets."""
    months = bets(spark, d).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.log1p(F.col("profit") / 100)).alias("growth"))
    paths = staking.block_paths(months, 4000, 36)
    return paths.agg(F.count("*").alias("paths"), *(F.percentile(c, F.lit(q)).alias(f"{c}_{int(q * 100)}") for c in ("final", "down") for q in (0.05, 0.5, 0.95)))


@query("leakage_canary", C + "SELECT contest_id, side FROM sides WHERE false")
def leakage_canary(spark, d):
    """Contests before the middle day whose form, careers or records change when everything from that day on is taken away: none."""
    p = participants(contests(spark, d))
    w, n = prior.before(["id"]), F.count("*").over(prior.before(["id"]))

    def block(rows: DataFrame) -> DataFrame:
        return rows.select("contest_id", "side", n.alias("n"), F.avg("score").over(w).alias("mean"), prior.decayed(F.col("score"), "day", w).alias("decayed"), F.max("opp_score").over(w).alias("most"), features.weighted(F.col("score"), F.lit(5.0), w, 12.0).alias("shrunk"), (F.col("day") - F.max("day").over(w)).alias("idle"))

    middle = p.agg(F.percentile_approx("day", 0.5)).first()[0] or 0
    return inference.leaks(p, block, ["contest_id", "side"], "day", F.lit(middle))


@query("fresh_quotes", """WITH q AS (SELECT event_type, ts, value FROM events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 36 HOUR AND (SELECT max(ts) FROM events)) SELECT event_type, round(arg_max(value, (ts, value)), 6) AS value, max(ts) AS at FROM q GROUP BY event_type""")
def fresh_quotes(spark, d):
    """The newest value of each kind that is at most 36 hours old at the end of the stream."""
    from pairloom.streaming import quotes

    e = table(spark, d, "events")
    now = e.agg(F.max("ts").cast("string")).first()[0]
    return quotes.latest(e, "event_type", "ts", "value", now).select("event_type", r("value").alias("value"), F.col("at").cast("timestamp_ntz").alias("at"))


@query("skill_snapshot")
def skill_snapshot(spark, d):
    """Expected rates of both sides and their shares in seven statistics, before each contest's date."""
    c, model = skills(spark, d)
    s = folds.folded(c, {"skill": model}, keep=[f"before_{n}" for n in SKILLS])
    return s.select("contest_id", *(v.alias(n) for n, v in model.expected({n: F.col(f"before_{n}") for n in SKILLS}, "skill").items()))


@query("record_ratings")
def record_ratings(spark, d):
    """Ratings over all records and how many lie before: one result for each date and pair (the mean, if records differ)."""
    p = contests(spark, d).filter("y IS NOT NULL").withColumns({"lo": F.least("a_id", "b_id"), "hi": F.greatest("a_id", "b_id"), "own": F.when(F.col("a_id") <= F.col("b_id"), F.col("y")).otherwise(1 - F.col("y"))})
    pairs = p.groupBy("day", F.col("lo").alias("a_id"), F.col("hi").alias("b_id")).agg(F.avg("own").alias("y"), F.min("contest_id").alias("contest_id"))
    return folds.folded(pairs, {"elo": folds.Elo(k=80.0, decay=2.0)}, order=["a_id", "b_id"])


@query("rating_grid")
def rating_grid(spark, d):
    """Log loss of Elo in 64 settings (steps, start, weight of finishes, rust, steps of new entities), all folded in one pass."""
    c = contests(spark, d).withColumn("finished", F.col("method") == "R")
    cells = {f"k{k}_i{i}_f{int(10 * f)}_r{int(10 * rust)}_n{int(n)}": folds.Elo(k=float(k), initial=float(i), finish=f, finished="finished", fade=rust, decay=n) for k in (20, 40, 60, 90) for i in (1450, 1500) for f in (1.0, 1.5) for rust in (0.0, 0.1) for n in (0.0, 2.0)}

    def losses(v: folds.Arrays) -> folds.Arrays:
        y = np.where((v["y"] == 0) | (v["y"] == 1), v["y"], np.nan)
        p = {n: np.clip(folds.expectation(v[f"a_{n}"], v[f"b_{n}"]), 1e-6, 1 - 1e-6) for n in cells}
        return {n: -np.log(np.where(y == 0, 1 - q, q)) + 0 * y for n, q in p.items()}

    s = folds.measured(c, cells, losses, keep=["y"]).filter("n > 0")
    return s.select(F.col("name").alias("setting"), "n", (F.col("total") / F.col("n")).alias("log_loss"))
