"""Ratings by period: published values, properties, and plain folds over dictionaries."""

import math

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate, joins, ratings, staking


def table(spark, rows):
    """(contest, day, a, b, y): each day is a period."""
    return spark.createDataFrame([(*r, r[1]) for r in rows], "contest_id long, day int, a_id string, b_id string, y double, period int")


def after(spark, rating, rows, day, *who):
    """Values of a rating on a later day."""
    probes = [(1000 + i, day, w, "nobody" + str(i), None) for i, w in enumerate(who)]
    got = {r.contest_id: r.a_x for r in ratings.rated(table(spark, [*rows, *probes]), {"x": rating}, "period").collect()}
    return [got[1000 + i] for i in range(len(who))]


def test_elo_moves_by_half_of_k_between_equals(spark):
    a, b = after(spark, ratings.Elo(k=32.0), [(1, 10, "a", "b", 1.0), (2, 11, "a", "b", None)], 20, "a", "b")
    assert (a, b) == (pytest.approx(1516.0), pytest.approx(1484.0))


def test_glicko_gives_the_published_example():
    """Glickman's worked example: 1500/200 meets 1400/30 (wins), 1550/100 and 1700/300 (loses)."""
    from pairloom.session import local_session

    spark, g, s = local_session(), ratings.Glicko2(), ratings.GLICKO_SCALE
    rows = spark.createDataFrame([(1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 0.0)], "r double, rd double, s double")
    own = {"mu": F.lit(0.0), "phi": F.lit(200 / s), "sigma": F.lit(0.06)}
    sums = g.sums(own, {"mu": (F.col("r") - 1500) / s, "phi": F.col("rd") / s}, {"score": F.col("s")})
    total = rows.agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    got = total.select(*(c.alias(k) for k, c in g.update(own, {k: F.col(k) for k in sums}).items())).first()
    assert 1500 + s * got.mu == pytest.approx(1464.06, abs=0.01)
    assert s * got.phi == pytest.approx(151.52, abs=0.01)
    assert got.sigma == pytest.approx(0.05999, abs=1e-5)


def test_glicko_doubts_who_rests():
    from pairloom.session import local_session

    g = ratings.Glicko2()
    state = {"mu": F.lit(0.0), "phi": F.lit(0.5), "sigma": F.lit(0.06)}
    row = local_session().range(1).select(*(g.drift(state, F.lit(d))["phi"].alias(f"d{d}") for d in (0, 400, 10**7))).first()
    assert row.d0 == 0.5 < row.d400 < row.d10000000 == pytest.approx(350 / ratings.GLICKO_SCALE)


def test_elo_and_line_filter_are_plain_folds(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, 10 + i // 3, *rnd.sample("abcdefgh", 2), rnd.choice([0.0, 0.5, 1.0, None])) for i in range(60)]
    df = table(spark, rows).withColumns({"line": F.col("contest_id") % 7 / 5.0 - 0.5, "finished": F.col("contest_id") % 2 == 0})
    got = {r.contest_id: r for r in ratings.rated(df, {"e": ratings.Elo(k=20.0, finish=1.5, decay=2.0, finished="finished"), "m": ratings.LineFilter()}, "period").collect()}
    elo, seen, mean, var, last = {}, {}, {}, {}, {}
    doubt = lambda e, day: min(var.get(e, 0.3) + 0.05 * max(0, day - last.get(e, day)) / 365.25, 0.6)
    for day in sorted({r[1] for r in rows}):
        today, gain, count, prec, pull = [r for r in rows if r[1] == day], {}, {}, {}, {}
        for i, _, a, b, y in today:
            assert got[i].a_e == pytest.approx(elo.get(a, 1500.0)) and got[i].b_e == pytest.approx(elo.get(b, 1500.0))
            assert got[i].a_m == pytest.approx(mean.get(a, 0.0)) and got[i].b_m == pytest.approx(mean.get(b, 0.0))
            line = i % 7 / 5.0 - 0.5
            for me, other, s, z in ((a, b, y, line), (b, a, None if y is None else 1 - y, -line)):
                if s is not None:
                    e = 1 / (1 + 10 ** ((elo.get(other, 1500.0) - elo.get(me, 1500.0)) / 400))
                    gain[me] = gain.get(me, 0) + 20 * (1.5 if i % 2 == 0 else 1) * (1 + 2 / (1 + seen.get(me, 0))) * (s - e)
                    count[me] = count.get(me, 0) + 1
                noise = 0.2 + doubt(other, day)
                prec[me] = prec.get(me, 0) + 1 / noise
                pull[me] = pull.get(me, 0) + (z + mean.get(other, 0.0)) / noise
        new = {}
        for me, p in prec.items():
            v = 1 / (1 / doubt(me, day) + p)
            new[me] = v * (mean.get(me, 0.0) / doubt(me, day) + pull[me]), v
        for me in new:
            elo[me], seen[me] = elo.get(me, 1500.0) + gain.get(me, 0), seen.get(me, 0) + count.get(me, 0)
            mean[me], var[me] = new[me]
            last[me] = day


def test_skills_follow_counts(spark):
    rows = []
    for i in range(6):
        rows += [(2 * i, 90 * i, "good", f"opp{i}", 90, 30, 15.0), (2 * i + 1, 90 * i, "bad", f"opq{i}", 25, 80, 15.0)]
    rows.append((100, 1240, "good", "bad", None, None, 15.0))
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "contest_id long, day int, a_id string, b_id string, a_count int, b_count int, exposure double, period int")
    leveled = ratings.league_level(df, "period", ["a_count", "b_count"], "exposure", rate=4.0, weight=500.0)
    got = {r.contest_id: r for r in ratings.rated(leveled, {"s": ratings.PoissonSkills()}, "period").collect()}
    assert got[100].a_s > 0.4 and got[100].b_s < -0.4
    assert got[0].a_s == got[0].b_s == 0.0


def test_no_future_in_ratings(spark):
    rows = [(i, 10 + i, "abcd"[i % 4], "bcda"[i % 4], float(i % 2)) for i in range(12)]
    full = {r.contest_id: r.a_x for r in ratings.rated(table(spark, rows), {"x": ratings.Elo()}, "period").collect()}
    part = {r.contest_id: r.a_x for r in ratings.rated(table(spark, rows[:7]), {"x": ratings.Elo()}, "period").collect()}
    assert all(full[i] == part[i] for i in part)


def test_joins_keep_repeated_rows_and_null_keys(spark):
    left = spark.createDataFrame([(1, "2001-01-10")] * 2 + [(1, "2001-02-01"), (None, "2001-01-10"), (2, None)], "k int, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([(1, "2001-01-05", 3.0), (1, "2001-01-09", 4.0), (1, "2001-01-09", 2.0), (None, "2001-01-05", 9.0)], "k int, d string, v double").withColumn("d", F.to_date("d"))
    got = joins.interval(left, right, ["k"], "d", 30, 1, [F.count("*").alias("n"), F.sum("v").alias("s")]).collect()
    assert sorted((str(r.k), str(r.d), r.n, r.s) for r in got) == [("1", "2001-01-10", 3, 9.0), ("1", "2001-01-10", 3, 9.0), ("1", "2001-02-01", 3, 9.0), ("2", "None", None, None), ("None", "2001-01-10", None, None)]
    near = joins.near_date(left, right, ["k"], "d", [0, -1], "v", "x").collect()
    assert sorted((str(r.k), str(r.d), r.x) for r in near if r.x is not None) == [("1", "2001-01-10", 2.0)] * 2 and len(near) == 5


def test_summary_finds_the_deepest_drawdown(spark):
    import random

    rnd = random.Random(2)
    rows = [(k, day, i, rnd.choice([-1.0, -2.0, 1.5, 0.5]), 1.0, 2.0) for k in range(2) for day in range(15) for i in range(rnd.randint(0, 5))]
    df = spark.createDataFrame(rows, "k int, day int, i int, profit double, stake double, price double")
    got = {r.k: r for r in staking.summary(df, ["k"], ["i"]).collect()}
    for k in range(2):
        total = high = deep = 0.0
        mine = sorted(r for r in rows if r[0] == k)
        for r in mine:
            total += r[3]
            high = max(high, total)
            deep = max(deep, high - total)
        assert got[k].max_drawdown == pytest.approx(deep) and got[k].n == len(mine) and got[k].profit == pytest.approx(total)


def test_q_values_over_blocks(spark):
    import random

    rnd = random.Random(3)
    ps = [(f"h{i}", rnd.random() ** 3) for i in range(200)] + [("tie1", 0.25), ("tie2", 0.25)]
    got = {r.h: r.q for r in evaluate.q_values(spark.createDataFrame(ps, "h string, p double"), "p", "h", blocks=16).collect()}
    order = sorted(ps, key=lambda x: (x[1], x[0]))
    least = math.inf
    for i in range(len(order), 0, -1):
        least = min(least, order[i - 1][1] * len(order) / i)
        assert got[order[i - 1][0]] == pytest.approx(min(least, 1.0))


def test_rust_takes_ratings_toward_the_start(spark):
    rows = [(1, 10, "a", "b", 1.0)]
    assert after(spark, ratings.Elo(k=32.0, layoff=100, keep=0.5), rows, 400, "a", "b") == [pytest.approx(1508.0), pytest.approx(1492.0)]
    assert after(spark, ratings.Elo(k=32.0, layoff=100, keep=0.5), rows, 100, "a") == [pytest.approx(1516.0)]


def test_bootstrap_lies_around_the_ratio(spark):
    df = spark.createDataFrame([(i, float(i % 7), 1.0) for i in range(700)], "c int, v double, one double")
    draws = [r.value for r in evaluate.clustered_bootstrap(df, "c", F.col("v"), F.col("one"), 200).collect()]
    assert len(draws) == 200 and abs(sum(draws) / 200 - 3.0) < 0.03 and 0.05 < (sum((x - 3) ** 2 for x in draws) / 200) ** 0.5 < 0.1
    again = [r.value for r in evaluate.clustered_bootstrap(df.repartition(7), "c", F.col("v"), F.col("one"), 200).collect()]
    assert sorted(map(lambda x: round(x, 9), draws)) == sorted(map(lambda x: round(x, 9), again))


def test_levels_fade_by_period(spark):
    rows = [(0, 3996, 10, 20, 5.0), (1, 3997, 30, 30, 5.0), (2, 3999, 1, 1, 5.0)]
    df = spark.createDataFrame(rows, "contest_id int, period int, a_count int, b_count int, exposure double")
    got = {r.contest_id: r.level for r in ratings.league_level(df, "period", ["a_count", "b_count"], "exposure", rate=2.0, weight=10.0).collect()}
    assert got == pytest.approx({0: math.log(2.0), 1: math.log((15 + 20) / (5 + 10)), 2: math.log((7.5 + 30 + 20) / (2.5 + 5 + 10))})
