"""Every query with SQL gives DuckDB's rows; the others keep their invariants."""

import glob
import os

import duckdb
import pytest

from pairloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(rows, cols):
    one = lambda v: "null" if v is None or v != v else (round(float(v), 3) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(str(one(r[c])) for c in cols) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    names = want.columns
    assert normal([r.asDict() for r in got.collect()], cols) == normal([dict(zip(names, r, strict=True)) for r in want.fetchall()], cols)


def test_ratings_keep_their_sum_and_see_no_future(spark):
    r = catalog.QUERIES["ratings"](spark, SF).toPandas()
    first = r.sort_values("contest_id").iloc[0]
    assert len(r) and first.a_elo > 0
    assert abs(r.a_elo.mean() - 1500) < 100


def test_links_find_the_shifted_and_swapped_records(spark):
    r = catalog.QUERIES["linked_records"](spark, SF).toPandas()
    assert (r.page == r.contest_id * 10).mean() > 0.95
    assert r.page.is_unique and r.contest_id.is_unique


def test_stage_stack_scores_each_stage_of_later_years(spark):
    r = catalog.QUERIES["stage_stack"](spark, SF).toPandas()
    assert len(r) and r.p.between(0, 1).all()
    assert not r.duplicated(["contest_id", "s"]).any()
    assert len({d.year for d in r.date}) > 2 and r.date.is_monotonic_increasing


@pytest.mark.parametrize("name, rows", [("walk_forward_logit", 1), ("stage_stack_years", 4)])
def test_every_year_with_a_history_is_scored(spark, name, rows):
    from collections import Counter

    from pairloom.plans.contests import contests

    all_rows = Counter(r.date.year for r in contests(spark, SF).filter("y IN (0, 1)").select("date").collect())
    del all_rows[min(all_rows)]
    r = catalog.QUERIES[name](spark, SF).toPandas()
    assert Counter(d.year for d in r.date) == {y: rows * n for y, n in all_rows.items()} and len(all_rows) > 2
    assert r.p.between(0, 1).all()


def test_common_opponents_drop_strangers_before_the_second_join(spark):
    """The rows of a side's record meet a bitmap of the other side's opponents, so that the join on opponents is not given all of them."""
    plan = catalog.QUERIES["common_opponents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan or "bit_get" in plan
