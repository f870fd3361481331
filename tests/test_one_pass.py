"""Queries that read the contests once, and what their operators give for it."""

from pairloom.plans import catalog
from pairloom.sources import bouts

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [l_orderkey")


def test_market_lines_are_counted_where_they_collapse(spark):
    assert scans(catalog.QUERIES["market_lines"](spark, SF)) == 1
    rows = [("1999-01-02", "b", "a", "+100", "+120", "1.5"), ("1999-01-02", "a", "b", "+120", "+300", "1.5"), ("1999-01-02", "A", "c", "", "+5", ""), ("1999-01-03", "a", "b", "+1", "+2", "2"), ("1999-01-03", "a", "b", "+3", "+2", "2")]
    raw = spark.createDataFrame(rows, "date string, f1_url string, f2_url string, f1_open string, f2_open string, spark string").selectExpr("*", "'' AS f1_close", "'' AS f2_close")
    got = {(str(r.date), r.f2_url): (r.n_rows, r.one_open, r.f1_open) for r in bouts.lines(raw).collect()}
    assert got == {("1999-01-02", "b"): (2, True, 120), ("1999-01-02", "c"): (1, None, None), ("1999-01-03", "b"): (2, False, 1)}


def test_rows_of_a_record_block_are_their_own_events(spark):
    # known and void results, wins, and the debuts of the beaten
    assert scans(catalog.QUERIES["record_block"](spark, SF)) <= 4
