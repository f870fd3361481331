import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import learn, match, prior, staking
from pairloom.plans.contests import contests, participants

SF = "/root/testdata/sf0.001"


def test_kelly_and_bets(spark):
    rows = spark.createDataFrame([(0.6, 2.2, 1.7, y) for y in (1.0, 1.0, 0.0, 1.0)] + [(0.6, None, 1.7, 1.0)], "p double, a double, b double, y double")
    bets = staking.simulate(rows, "p", "a", "b", "y", edge=0.05, fraction=0.5)
    got = bets.agg(F.count("*"), F.min("side"), F.max("side"), F.sum("profit")).first()
    assert got[0] == 4 and got[1] == got[2] == "a" and got[3] > 0
    k = spark.range(1).select(staking.kelly(F.lit(0.6), F.lit(2.2), 1.0, 100.0)).first()[0]
    assert k == pytest.approx(0.32 / 1.2 * 100)


def test_streak(spark):
    cases = [([1.0, 1.0], 2), ([1.0, 0.0, None, 0.0], -2), ([1.0, 0.5], 0), ([], 0), ([0.0, 1.0], 1)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "x array<double>").select(prior.streak(F.col("x"))).collect()
    assert [r[0] for r in rows] == [w for _, w in cases]


def test_later_rows_do_not_change_earlier_features(spark):
    p = participants(contests(spark, SF))
    w = prior.before(["id"])
    feature = lambda df: df.select("contest_id", "side", "day", F.sum("score").over(w).alias("s"))
    cut = p.approxQuantile("day", [0.5], 0.0)[0]
    full, part = feature(p).filter(F.col("day") < cut), feature(p.filter(F.col("day") < cut).orderBy(F.rand(1)))
    assert full.join(part, ["contest_id", "side"]).filter(~full.s.eqNullSafe(part.s)).count() == 0


def test_ridge_logit_is_the_optimum(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-x @ [1.0, -0.5]))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), 0.1) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double, o double")
    beta = learn.ridge_logit(df, ["a", "b"], "y", 2.0, offset="o")
    p = 1 / (1 + np.exp(-(x @ beta + 0.1)))
    assert np.abs(x.T @ (y - p) - 2.0 * beta).max() < 1e-6


def test_swapped_sides_give_the_complement(spark):
    df = spark.createDataFrame([(0.4, 1.0), (-0.2, 0.0), (1.0, 1.0)], "a double, y double")
    m = learn.mirrored(df, ["a"], "y")
    p = m.select(learn.score_logit(["a"], np.array([0.7])).alias("p")).collect()
    assert all(math.isclose(x.p + y.p, 1.0) for x, y in zip(p[:3], p[3:], strict=True))


def test_locked_years_are_refused(spark):
    with pytest.raises(PermissionError):
        learn.walk_forward(spark.range(1), "id", [2024, 2025], lambda a, b: b, locked_from=2025)


def test_ratio():
    assert match.ratio("", "") == 100 and match.ratio("abc", "abc") == 100 and match.ratio("abcd", "abxd") == 75
    assert match.token_sort_ratio("jon smith", "smith jon") == 100


def test_stream_equals_batch(spark, tmp_path):
    from pairloom.streaming import quotes

    src = str(tmp_path / "in")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(src)
    quotes.run_once(quotes.daily(spark.readStream.schema(e.schema).parquet(src), "ts", "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert out.join(batch, ["day", "event_type", "n"]).count() == out.count() > 0


def test_crawl_goes_on_to_the_end_of_a_chain(spark):
    from pairloom.operators import joins

    edges = [(i, i + 1) for i in range(7)] + [(7, 2), (20, 21)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.depth for r in joins.frontier(e, spark.createDataFrame([(0,)], "node long"), "a", "b").collect()}
    assert got == {i: i for i in range(8)}


def test_links_find_swapped_tokens_and_misspelt_initials(spark):
    kinds = "id long, date date, n1 string, n2 string"
    day = date(2001, 1, 1)
    left = [(1, day, "Kim Dong Hyun", "Park Jun Yong"), (2, day, "Anderson", "Bernstein"), (3, day, "Ann  Lee", ""), (4, date(2002, 1, 1), "Zed Q", "Yan W"), (5, date(2003, 1, 1), "Smith", None)]
    right = [(10, date(2001, 1, 2), "Dong Hyun Kim", "Yong Park Jun"), (20, day, "Wernstein", "Enderson"), (30, day, None, "Lee Ann"), (40, day, "Zed Q", "Yan W"), (50, date(2003, 1, 1), "Smith", "x")]
    got = {r.id: (r.page, r.score) for r in match.link(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds).withColumnRenamed("id", "page"), "id", "page", threshold=50.0).collect()}
    best = lambda p, q: max(match.token_sort_ratio(p[2], q[2]) + match.token_sort_ratio(p[3], q[3]), match.token_sort_ratio(p[2], q[3]) + match.token_sort_ratio(p[3], q[2])) / 2 - 2 * abs((p[1] - q[1]).days)
    assert {i: p for i, (p, _) in got.items()} == {1: 10, 2: 20, 3: 30, 5: 50}
    assert all(got[i][1] == pytest.approx(best(left[i - 1], next(q for q in right if q[0] == p))) for i, (p, _) in got.items())


def test_partial_ratio():
    assert match.partial_ratio("smith", "jon smith jr") == 100 and match.partial_ratio("", "") == 100 and match.partial_ratio("", "x") == 0
    assert match.partial_ratio("abcd", "xxabyd") == max(match.ratio("abcd", w) for w in ("a", "xxab", "xaby", "abyd", "byd"))


def test_weak_links_need_one_strong_name(spark):
    kinds = "id long, date date, n1 string, n2 string"
    day = date(2001, 1, 1)
    left = spark.createDataFrame([(1, day, "Anderson Silva", "Chris Weidman"), (2, date(2001, 5, 1), "John Smith", "Bob Stone")], kinds)
    right = [(10, day, "Anderson Silva", "Weidmann C."), (20, date(2001, 5, 1), "John Smith", "Bb Stn Jr. III"), (21, date(2001, 5, 1), "John Smith", "Rob Sten")]
    pages = spark.createDataFrame(right, kinds).withColumnRenamed("id", "page")
    got = {r.id: r.page for r in match.link(left, pages, "id", "page", threshold=95.0, weak=60.0).collect()}
    assert got == {1: 10}
    assert match.link(left, pages, "id", "page", threshold=95.0).count() == 0
