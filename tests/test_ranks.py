"""Running sums and AUC over ranges against plain sorting, with a key and a value that most rows have."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate, ranks


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_over_ranges(spark, parts):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 0.5, rnd.random() / 1000]), i, rnd.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, i int, n int").repartition(5)
    got = {r.i: r.before for r in ranks.running_before(df, ["k"], ["v", "i"], "n", "before", parts).collect()}
    for k in ("a", "b", None):
        total = 0
        for _, v, i, n in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            assert got[i] == total
            total += n
    assert len(got) == 400


def test_area_is_the_share_of_ordered_pairs(spark):
    rnd = random.Random(2)
    rows = [(k, float(rnd.random() < 0.4), rnd.choice([0.5, round(rnd.random(), 2), rnd.random() / 1e6])) for k in ("x", "y") for _ in range(150)]
    got = {r.k: r.auc for r in evaluate.auc(spark.createDataFrame(rows, "k string, y double, p double"), ["k"], "y", "p").collect()}
    for k in ("x", "y"):
        pos, neg = ([p for g, y, p in rows if g == k and y == v] for v in (1.0, 0.0))
        assert got[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_close_p_values_are_many_ranges(spark):
    ps = [(f"h{i}", i / 1e7) for i in range(500)] + [("late", 0.9), ("none", None)]
    got = {r.h: r.q for r in evaluate.q_values(spark.createDataFrame(ps, "h string, p double").withColumn("p", F.col("p")), "p", "h", blocks=8).collect()}
    assert got["h499"] == pytest.approx(499e-7 * 502 / 500) and got["h0"] == 0.0 and got["late"] == pytest.approx(0.9 * 502 / 501)
