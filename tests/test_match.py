"""Linkage against all pairs: swapped tokens, misspelt initials, empty and undated rows; work on full days."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import match

RND = random.Random(9)
TOKENS = ["kim", "dong", "hyun", "jon", "smith", "smyth", "anderson", "andersen", "silva", "da", "o-neil", "wang", "cong", "é", "x"]


def name():
    return " ".join(RND.choice(TOKENS) for _ in range(RND.randint(0, 3)))


def spoilt(n):
    w = n.split()
    RND.shuffle(w)
    n = list(" ".join(w))
    for _ in range(RND.randint(0, 2)):
        if n:
            i = RND.randrange(len(n))
            n[i : i + 1] = RND.choice([[], ["q"], [n[i], n[i]]])
    return "".join(n)


@pytest.mark.parametrize("threshold", [40.0, 80.0, 92.0, 100.0])
@pytest.mark.parametrize("score", [match.ratio, match.token_sort_ratio, match.either_ratio])
def test_similar_names_are_those_of_all_pairs(spark, threshold, score):
    xs = {name() for _ in range(40)} | {"", "a", "ab"}
    ys = {spoilt(x) for x in xs for _ in range(2)} | {"", "b", "long name of somebody else"}
    df = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {(r.x, r.y) for r in match.similar_names(df(xs, "x"), df(ys, "y"), threshold, score).collect()}
    assert got == {(x, y) for x in xs for y in ys if score(x, y) >= threshold - 1e-9}


@pytest.mark.parametrize("more", [{}, {"threshold": 85.0, "weak": 70.0, "days": 2, "penalty": 0.0, "score": match.either_ratio}, {"score": match.either_ratio, "days": 3, "undated_from": "2001-01-04"}])
def test_links_are_those_of_all_pairs(spark, more):
    day = lambda k: datetime.date(2001, 1, 1) + datetime.timedelta(days=k)
    left = [(i, day(RND.randrange(8)), name(), name()) for i in range(50)]
    right = []
    for i, d, p, q in left:
        p, q = RND.choice([(p, q), (q, p)])
        right.append((1000 + i, None if i % 9 == 0 else d + datetime.timedelta(days=RND.randint(-2, 2)), spoilt(p), spoilt(q)))
    kinds = "id long, date date, n1 string, n2 string"
    got = {(r.id, r.page): r.score for r in match.link(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds).withColumnRenamed("id", "page"), "id", "page", **more).collect()}
    f, days, penalty, limit, weak = more.get("score", match.token_sort_ratio), more.get("days", 1), more.get("penalty", 2.0), more.get("threshold", 80.0), more.get("weak")
    found = []
    for i, d, p, q in left:
        mine = []
        for j, e, r, s in right:
            if e is None:
                loss = 5.0 if "undated_from" in more and d >= day(3) else None
            else:
                loss = penalty * abs((d - e).days) if abs((d - e).days) <= days else None
            if loss is not None:
                mine.append((max(f(p, r) + f(q, s), f(p, s) + f(q, r)) / 2 - loss, j, max(f(x, y) for x in (p, q) for y in (r, s)) >= 92))
        if weak is None:
            mine = [(v, j) for v, j, _ in mine if v >= limit]
        else:
            mine = [m for m in mine if m[0] >= weak]
            alone = sum(m[2] for m in mine) == 1
            mine = [(v, j) for v, j, strong in mine if v >= limit or strong and alone]
        if mine:
            v, j = min(mine, key=lambda m: (-m[0], m[1]))
            found.append((j, -v, i))
    want = {}
    for j, v, i in sorted(found):
        if j not in {b for _, b in want}:
            want[i, j] = -v
    assert got == pytest.approx(want) and len(want) > 15


def test_work_follows_the_rows_of_a_day(spark):
    """Names of one day that are not alike never meet: 20 times the rows are about 20 times the scored pairs."""
    def pairs(n):
        rows = [(i, "2001-01-01", "".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)), "".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, date string, n1 string, n2 string").withColumn("date", F.to_date("date"))
        seen = spark.sparkContext.accumulator(0)

        def counted(a, b):
            seen.add(1)
            return match.token_sort_ratio(a, b)

        match.SCORES[counted] = match.SCORES[match.token_sort_ratio]
        assert match.link(df, df.withColumnRenamed("id", "page"), "id", "page", score=counted).filter("id = page").count() == n
        return seen.value

    few, many = pairs(30), pairs(600)
    assert many < 0.2 * 4 * 600 * 600 and few > 0


def test_linked_queries_find_the_spoilt_names(spark):
    from pairloom.plans import catalog

    for name in ("linked_lines", "linked_quotes"):
        r = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
        assert (r.page == r.contest_id * 10).mean() > 0.95 and r.page.is_unique and r.contest_id.is_unique and len(r) > 900


@pytest.mark.parametrize("threshold", [67.0, 85.0])
@pytest.mark.parametrize("score", [match.ratio, match.either_ratio])
def test_no_similar_name_is_lost(spark, threshold, score):
    rnd = random.Random(threshold)

    def near(s):
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randint(0, len(s))
            s = s[:i] + rnd.choice(["", "a", "- "]) + s[i + rnd.randint(0, 2) :]
        return s

    left = {"".join(rnd.choice("abc -é") for _ in range(rnd.choice([0, 1, 3, 8, 16, 16, 30]))) for _ in range(40)}
    right = {near(s) for s in left} | {near(s) for s in left}
    frame = lambda names: spark.createDataFrame([(s,) for s in names], "name string")
    got = {(r.x, r.y) for r in match.similar_names(frame(left), frame(right), threshold, score).collect()}
    assert got == {(a, b) for a in left for b in right if score(a, b) >= threshold - 1e-9}


def test_keys_of_names_are_not_sent_to_the_driver(spark, monkeypatch):
    """Exploded keys have no size that Spark knows: their joins go by sort and merge, however small the names' table."""
    plans, write = [], match.written
    monkeypatch.setattr(match, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    names = spark.createDataFrame([("ann lee",), ("bo chan",)], "name string")
    assert match.similar_names(names, names, 80.0).count() == 2
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]


def test_rows_are_multiplied_on_the_side_with_more_names(spark):
    """Four spoilt names for each name of the left side: left rows meet by their own two names."""
    left = spark.createDataFrame([(i, f"name{i}", f"other{i}") for i in range(5)], "__l long, a1 string, a2 string")
    right = spark.createDataFrame([(i, f"name{i % 5}{i}", f"other{i % 5}") for i in range(20)], "__r long, b1 string, b2 string")
    near = spark.createDataFrame([(f"name{i % 5}", f"name{i % 5}{i}") for i in range(20)] + [(f"other{i}", f"other{i}") for i in range(5)], "x string, y string")
    mine, theirs, name = match._by_name(left, right, near)
    assert name == "x" and mine.count() == 10 and theirs.count() == 40
    back = match._by_name(right.toDF("__l", "a1", "a2"), left.toDF("__r", "b1", "b2"), near.select(near.y.alias("x"), near.x.alias("y")))
    assert back[2] == "y" and back[0].count() == 40 and back[1].count() == 10


def test_sources_of_links_are_made_once(spark):
    from pairloom.plans import catalog

    for df in catalog.two_sources(spark, "/root/testdata/sf0.001", catalog.spoilt):
        assert "lineitem" not in df._jdf.queryExecution().toString() and df.count() > 900
