"""Parsing, distributions, learning helpers, sinks and streams on small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import functions as P
from pairloom.operators import features, inference, learn, staking
from pairloom.sources import bouts, pages, sinks

SF = "/root/testdata/sf0.001"


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("text, want", [("4:07", 247), ("0:00", 0), ("x", None), ("", None), (None, None), ("12:5", 725)])
def test_clocks(spark, text, want):
    assert value(spark, P.clock_seconds(F.lit(text).cast("string"))) == want


def test_scalars_of_odd_texts(spark):
    r = spark.range(1).select(
        P.height_inches(F.lit("--")).alias("a"), P.height_inches(F.lit("6'")).alias("b"), P.signed_int(F.lit("EVEN")).alias("c"), P.any_date(F.lit("February 30, 2001")).alias("d"), P.number_pair(F.lit("3 of")).alias("e"),
        P.slug(F.lit("  Łukasz  Öz-Çelik ")).alias("f"), P.judge_margin(F.lit("none")).alias("g"), P.round_lengths(F.lit("No Time Limit")).alias("h"), P.utc_offset_hours(F.lit("2001-01-15").cast("date"), "Asia/Tokyo").alias("i"),
        P.longest_named(F.lit("nothing"), {"Heavyweight": 1}).alias("j"), P.html_text(F.lit("&amp;lt; <br> x")).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e.landed, r.f, r.g, r.h, r.i, r.j, r.k) == (None, 72.0, None, None, None, "lukasz-oz-celik", None, [], 9.0, None, "&lt; x")


@pytest.mark.parametrize("x", [0.1, 0.5, 1.0, 2.0, 7.3, 50.0, 1e4])
def test_ln_gamma(spark, x):
    assert value(spark, P.ln_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)


@pytest.mark.parametrize("z", [-6.0, -1.0, 0.0, 0.3, 1.96, 2.99, 3.01, 5.0, 8.0])
def test_normal_tail(spark, z):
    assert value(spark, P.normal_tail(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-8)


@pytest.mark.parametrize("k, n, p", [(15, 20, 0.5), (3, 10, 0.3), (0, 5, 0.5), (10, 20, 0.5)])
def test_binomial_tail(spark, k, n, p):
    d = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    assert value(spark, P.binomial_tail(F.lit(float(k)), F.lit(float(n)), p)) == pytest.approx(sum(x for x in d if x <= d[k] * (1 + 1e-7)))


def test_all_groups_are_fitted_as_if_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(b), float(rng.random() < 1 / (1 + math.exp(-(a - g * b)))), 0.1) for g in range(3) for a, b in rng.normal(size=(150, 2))]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double, o double")
    got = {r.g: r.beta for r in learn.grouped_logit(df, ["g"], ["a", "b"], "y", 2.0, offset="o").collect()}
    for g in range(3):
        assert got[g] == pytest.approx(learn.ridge_logit(df.filter(F.col("g") == g), ["a", "b"], "y", 2.0, offset="o").tolist(), abs=1e-6)


def test_scaling_fills_with_the_middle_and_leaves_the_intercept_free(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 0.0), (4.0, 5.0, 1.0), (10.0, None, 1.0), (None, 5.0, 1.0)], "a double, b double, y double")
    s = learn.scale(df, ["a", "b"])
    assert s.medians == [3.0, 5.0] and s.means == [4.0, 5.0] and s.deviations[1] == 0.0
    z = [r.z_b for r in s.apply(df).collect()]
    assert z == [0.0] * 5
    p = [r.p for r in learn.scaled_logit(df, ["a", "b"], "y", c=1e-9).predict(df).collect()]
    assert p == pytest.approx([0.8] * 5, abs=1e-3)


def test_splines_sum_to_one(spark):
    basis = learn.spline_basis(F.col("x"), [0.0, 1.0, 2.0, 5.0, 9.0])
    rows = spark.createDataFrame([(x,) for x in (-3.0, 0.0, 0.5, 1.0, 4.9, 9.0, 20.0)], "x double").select(F.array(*basis).alias("b")).collect()
    assert len(basis) == 6 and all(sum(r.b) == pytest.approx(1.0) and min(r.b) >= 0 for r in rows)


def test_soft_rows_keep_their_weight(spark):
    df = spark.createDataFrame([(1, 0.7), (2, 1.0), (3, 0.0)], "k int, s double")
    got = sorted((r.k, r.y, round(r.weight, 6)) for r in learn.soft_rows(df.withColumn("y", F.lit(9.0)), "y", "s").collect())
    assert got == [(1, 0.0, 0.3), (1, 1.0, 0.7), (2, 1.0, 1.0), (3, 0.0, 1.0)]


def test_penalty_is_chosen_on_later_years(spark):
    rng = np.random.default_rng(5)
    rows = [(2000 + i % 6, float(x), float(rng.random() < 1 / (1 + math.exp(-2 * x)))) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "year int, x double, y double")
    assert learn.chosen_penalty(df, ["x"], "y", "year", [1e4, 1.0], least=(100, 100)) == 1.0
    assert learn.chosen_penalty(df, ["x"], "y", "year", [1e4, 1.0]) == 1 / 0.003


def test_offset_scan_finds_what_was_put_in(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(x), 0.3, float(rng.random() < 1 / (1 + math.exp(-(0.3 + k * x))))) for k in (0, 1) for x in rng.normal(size=3000)]
    got = {r.k: r for r in inference.offset_scan(spark.createDataFrame(rows, "k int, x double, o double, y double"), ["k"], "y", "o", "x").collect()}
    assert abs(got[1].beta - 1) < 0.15 and got[1].lr_p < 1e-6 and got[0].lr_p > 0.001
    assert abs(got[0].z ** 2 - got[0].lr) < 0.2


def test_leaks_are_seen(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "k int, e int, x double")
    back = Window.partitionBy("e").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    both = Window.partitionBy("e")
    assert inference.leaks(rows, lambda d: d.select("k", F.sum("x").over(back).alias("s")), ["k"], "k", F.lit(15)).count() == 0
    assert inference.leaks(rows, lambda d: d.select("k", F.sum("x").over(both).alias("s")), ["k"], "k", F.lit(15)).count() == 15


def test_history_of_another_table(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (2, 5, "b"), (None, 5, "c")], "id int, day int, x string")
    events = spark.createDataFrame([(1, 6, 2.0), (1, 7, 3.0), (1, 10, 9.0), (None, 1, 5.0)], "id int, day int, v double")
    got = sorted((str(r.id), r.x, r.s) for r in features.history(rows, events, ["id"], "day", {"s": lambda w: F.sum("v").over(w)}, guard=4).collect())
    assert got[:2] == [("1", "a", 2.0)] * 2 and got[2] == ("2", "b", None)


def test_paths_and_starts(spark):
    days = spark.createDataFrame([(0, d, 0.01 * d) for d in (3, 4, 5, 12, 20)], "k int, day int, growth double")
    got = {(r.start, r.horizon): r.growth for r in staking.starts(days, ["k"], [7, 14]).collect()}
    assert got == pytest.approx({(4, 7): 0.09, (4, 14): 0.21, (11, 7): 0.12})
    months = spark.createDataFrame([(f"m{i}", 0.1) for i in range(5)], "month string, growth double")
    p = staking.block_paths(months, 20, 12).collect()
    assert len(p) == 20 and all(r.final == pytest.approx(1.2) and r.down == 0 for r in p)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"x')], "k int, t string")
    for _ in range(2):
        sinks.replace_csv(df, str(tmp_path / "r"))
        sinks.append_csv(df, str(tmp_path / "a"))
    read = lambda p: bouts.raw_csv(spark, str(tmp_path / p))
    assert read("r").count() == 2 and read("a").count() == 4
    assert sorted(r.k for r in read("a").collect()) == ["1", "1", "2", "2"]
    sinks.json_document(df, str(tmp_path / "j"), n=F.count("*"), most=F.max("k"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"n":2,"most":2}']
    assert [sinks.append_numbered(df, str(tmp_path / "log")) for _ in range(3)] == [1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_csv_folder_to_bouts(spark, tmp_path):
    from pairloom.plans import raw

    tables = raw.raw_bouts(spark, SF)
    for name, df in zip(("events", "details", "results"), tables, strict=True):
        sinks.append_csv(df, str(tmp_path / name))
    direct = bouts.fights(*tables)
    again = bouts.fights(*(bouts.raw_csv(spark, str(tmp_path / n)) for n in ("events", "details", "results")))
    assert again.exceptAll(direct).count() == 0 and again.count() == direct.count() > 0


def test_attribution_is_to_the_closer_name(spark):
    s = F.lit("Ann Lee was there. Bob Ray missed weight by a pound.")
    assert value(spark, pages.attributed(s, "missed weight", F.lit("Bob Ray"), F.lit("Ann Lee")))
    assert not value(spark, pages.attributed(s, "missed weight", F.lit("Ann Lee"), F.lit("Bob Ray")))
    assert not value(spark, pages.attributed(s, "stepped in", F.lit("Bob Ray"), F.lit("Ann Lee")))


def test_votes_take_the_greatest_sum(spark):
    from pairloom.operators import match

    df = spark.createDataFrame([("a", "x", 80.0), ("a", "y", 50.0), ("a", "y", 45.0), ("b", "z", 70.0), ("b", "w", 70.0)], "e string, c string, score double")
    assert {r.e: r.c for r in match.vote(df, "e", "c").collect()} == {"a": "y", "b": "w"}


def test_latest_quote_is_not_stale(spark):
    from pairloom.streaming import quotes

    df = spark.createDataFrame([("a", "2001-01-01 00:00:00", 1.0), ("a", "2001-01-03 00:00:00", 2.0), ("b", "2001-01-01 00:00:00", 3.0), ("a", "2001-01-05 00:00:00", 9.0)], "k string, ts string, v double")
    assert [(r.k, r.v) for r in quotes.latest(df, "k", "ts", "v", "2001-01-03 12:00:00").collect()] == [("a", 2.0)]


@pytest.mark.parametrize("name", ["market_layers", "scaled_model", "boosted_model", "method_model", "prop_layer"])
def test_learned_probabilities(spark, name):
    from pairloom.plans import catalog

    r = catalog.QUERIES[name](spark, SF).toPandas()
    ps = [c for c in r.columns if c == "p" or c.startswith("p_") or c in ("stack", "edge")]
    assert len(r) and all(r[c].between(0, 1).all() for c in ps)
    if name == "method_model":
        assert np.allclose(r[ps].sum(axis=1), 1)


def test_upsert_stream_replaces_pages(spark, tmp_path):
    from pairloom.streaming import quotes

    kinds = "page int, k int, v int, at int"
    put = lambda rows, n: spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: quotes.upsert_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "page", ["page", "k"], "at")
    put([(1, 1, 10, 0), (1, 2, 20, 0), (2, 1, 30, 0), (2, 1, 31, 1)], 0)
    run()
    assert sorted((r.page, r.k, r.v) for r in quotes.newest(spark, str(tmp_path / "out")).collect()) == [(1, 1, 10), (1, 2, 20), (2, 1, 31)]
    put([(1, 3, 40, 0)], 1)
    run()
    assert sorted((r.page, r.k, r.v) for r in quotes.newest(spark, str(tmp_path / "out")).collect()) == [(1, 3, 40), (2, 1, 31)]
    assert quotes.newest(spark, str(tmp_path / "none")) is None


def test_commands(spark, tmp_path, capsys):
    from pairloom.__main__ import main

    assert main(["list"]) == 0 and "prior_form: " in capsys.readouterr().out
    assert main(["run", "travel", SF, str(tmp_path / "t")]) == 0 and spark.read.parquet(str(tmp_path / "t")).count() > 0
    assert main(["run", "travel", str(tmp_path / "nowhere"), str(tmp_path / "u")]) == 1 and "travel" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["run", "no_such", SF, str(tmp_path / "v")])


def test_markup_goes_at_any_depth(spark):
    cases = {"a{{b{{c{{d}}e}}f}}g": "ag", "x {y} {{z {1} }}w": "x {y} w", "open {{ stays": "open {{ stays", "}} here": "}} here", "a<ref name=\"p/q\"/>b<ref>c\nd</ref>e<references/>": "abe<references/>", "": ""}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in df.select("want", P.strip_markup("t").alias("got")).collect())


def test_promotions_lose_their_numbers(spark):
    from pairloom.sources import bouts

    cases = {"Cage 12.5 - A vs B": "Cage", "Arena 7": "Arena", "Arena7": "Arena", "Deep #12": "Deep", "King of IX": "King of", "Titan FC": "Titan FC", "Bellator XX1": "Bellator XX", "9": ""}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert {r.t: r.got for r in df.select("t", bouts.promotion("t").alias("got")).collect()} == cases


@pytest.mark.parametrize("name", ["scaled_model", "boosted_model", "method_model"])
def test_models_score_every_year_after_the_first(spark, name):
    from collections import Counter

    from pairloom.plans import catalog, contests

    rows = contests.contests(spark, SF).filter("y IN (0, 1)").select("contest_id", "date").collect()
    first = min(r.date.year for r in rows)
    got = Counter(r.contest_id for r in catalog.QUERIES[name](spark, SF).select("contest_id").collect())
    assert set(got) == {r.contest_id for r in rows if r.date.year > first} and set(got.values()) == {1}
