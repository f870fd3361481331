"""Bankrolls against a plain loop over days, whatever the batches; ruin, caps, deposits and tied-up cash."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import bankroll


def plain(rows, s):
    """(day, month, units, gain) rows in order; the queue of open days as a list."""
    held, pending, seen_month, bets, staked, deposited, low, high, down, ruined = s.start, [], None, 0, 0.0, s.start, s.start, s.start, 0.0, False
    for day in sorted({r[0] for r in rows}):
        today = [r for r in rows if r[0] == day]
        for p in [p for p in pending if p[0] < day - s.lead]:
            held += p[2]
            low, high = min(low, held), max(high, held)
            down = max(down, 1 - held / high)
        pending = [p for p in pending if p[0] >= day - s.lead]
        if seen_month is not None and s.deposit:
            held += s.deposit * (today[0][1] - seen_month)
            deposited += s.deposit * (today[0][1] - seen_month)
        seen_month = today[0][1]
        if held < s.ruin:
            ruined = True
            break
        stakes = [(min(r[2] * s.unit(held), s.most or math.inf), r[3]) for r in today]
        stakes = [x for x in stakes if x[0] >= s.least]
        cash, total = held - sum(p[1] for p in pending), sum(x[0] for x in stakes)
        if total <= 0 or cash <= 0:
            continue
        f = min(1.0, cash / total)
        pending.append((day, total * f, sum(x * f * g for x, g in stakes)))
        bets, staked = bets + len(stakes), staked + total * f
    for p in pending:
        held += p[2]
        low, high = min(low, held), max(high, held)
        down = max(down, 1 - held / high)
    return held, bets, staked, deposited, low, down, ruined or held < s.ruin


SYSTEMS = {
    "hundreds": bankroll.System(100.0, bankroll.whole_hundreds, lead=14), "bold": bankroll.System(200.0, bankroll.bold, lead=3), "flat": bankroll.System(100.0, bankroll.one),
    "saver": bankroll.System(300.0, bankroll.whole_hundreds, lead=2, least=1.0, most=4.0, deposit=25.0), "reckless": bankroll.System(50.0, bankroll.bold, ruin=40.0, lead=1),
}


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_bankrolls_are_plain_loops(spark, batch):
    rnd = random.Random(5)
    rows = [(k, day, 24000 + day // 30, rnd.choice([0.5, 1.0, 2.5, 5.0]), rnd.choice([-1.0, -1.0, 0.0, 0.9, 1.4, 2.0] if k != "y" else [-1.0, -1.0, -1.0, 0.9])) for k in ("x", "y", None) for day in range(0, 200, 3) for _ in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "k string, day int, month int, units double, gain double")
    df = df.unionByName(df.limit(1).withColumn("units", F.lit(None).cast("double")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.system): tuple(r)[2:] for r in bankroll.bankrolls(df, SYSTEMS, ["k"], "day", "month", "units", "gain").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 3 * len(SYSTEMS) and any(v[-1] for v in got.values()) and not all(v[-1] for v in got.values())
    for (k, name), v in got.items():
        assert v == pytest.approx(plain([r[1:] for r in rows if r[0] == k], SYSTEMS[name])), (k, name)
    assert bankroll.bankrolls(df.limit(0), SYSTEMS, ["k"], "day", "month", "units", "gain").count() == 0


def test_query_has_a_row_for_each_path(spark):
    from pairloom.plans import catalog

    r = catalog.QUERIES["bankroll_systems"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(r) == 50 and r.bets.gt(0).all() and r.down.between(0, 2).all()


def test_a_bankroll_beyond_1e155_keeps_growing_and_one_beyond_doubles_is_infinite(spark):
    rows = spark.createDataFrame([(k, day, 0, 300.0, gain) for k, days in (("a", 200), ("b", 400)) for day in range(days) for gain in (9.0, 7.0, -1.0)], "k string, day int, month int, units double, gain double")
    got = {r.k: r for r in bankroll.bankrolls(rows, {"hundreds": bankroll.System(100.0, bankroll.whole_hundreds)}, ["k"], "day", "month", "units", "gain").collect()}
    assert got["a"].final == pytest.approx(100 * 6.0**200, rel=1e-9) and got["a"].bets == 600
    assert got["b"].final == float("inf") and not got["b"].ruined


def test_a_path_gets_a_row_for_a_days_equal_units(spark):
    rows = spark.range(5000).selectExpr("cast(id % 3 as int) AS day", "0 AS month", "double(id % 2) AS units", "double(id % 5) - 1 AS gain")
    done = bankroll.bankrolls(rows, {"flat": bankroll.System(1e6, bankroll.one)}, [], "day", "month", "units", "gain")
    assert "HashAggregate" in done._jdf.queryExecution().executedPlan().toString()
    assert [r.bets for r in done.collect()] == [5000]
