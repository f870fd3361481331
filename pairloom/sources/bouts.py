"""Bouts, rounds, profiles, lines and records from tables of raw strings. Whatever doesn't parse is null; no reader counts on an order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import functions as P

#: Weight classes and their limits in pounds; fixed values.
WEIGHT_CLASSES = {"Strawweight": 115, "Flyweight": 125, "Bantamweight": 135, "Featherweight": 145, "Lightweight": 155, "Welterweight": 170, "Middleweight": 185, "Light Heavyweight": 205, "Heavyweight": 245, "Super Heavyweight": 265}


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header; quoted fields may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def one_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, so that the choice hangs on no order of input."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fights(events: DataFrame, details: DataFrame, results: DataFrame) -> DataFrame:
    """One typed row for each bout.

    ``events`` (event, date, url, location), ``details`` (event, bout, url, position) and ``results`` (event, url, outcome, weightclass,
    method, round, time, time_format) hold raw strings. ``bout_order`` counts a card's bouts from 0 by position; bouts whose event or
    result is not known fall out.
    """
    e = one_of(events.select(F.trim("event").alias("event"), P.any_date("date").alias("date"), P.last_part("url").alias("event_id"), F.trim("location").alias("location")), ["event"], ["event_id"])
    d = one_of(details.select(F.trim("event").alias("event"), P.vs_names("bout").alias("names"), "url", F.col("position").try_cast("int").alias("position")), ["url"], ["event", "position"])
    d = d.join(e.select("event"), "event", "left_semi")
    card = Window.partitionBy("event")
    d = d.select("*", (F.row_number().over(card.orderBy("position", "url")) - 1).alias("bout_order"), F.count("*").over(card).alias("n_bouts"))
    r = one_of(results.withColumn("event", F.trim("event")), ["event", "url"], ["outcome", "time"])
    f = d.join(r, ["event", "url"]).join(e, "event")
    lengths, end_round, end_time = P.round_lengths("time_format"), F.col("round").try_cast("int"), P.clock_seconds("time")
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x * 60)
    has = lambda word: F.contains(F.lower("weightclass"), F.lit(word))
    return f.select(
        P.last_part("url").alias("fight_id"), "event", "event_id", "date", "location", "bout_order", "n_bouts", F.get("names", 0).alias("f1_name"), F.get("names", 1).alias("f2_name"),
        P.slug(F.get("names", 0)).alias("f1_id"), P.slug(F.get("names", 1)).alias("f2_id"), F.trim("outcome").alias("outcome"), F.trim("method").alias("method"), end_round.alias("end_round"),
        end_time.alias("end_time"), F.trim("time_format").alias("time_format"), (has("title") | has("championship")).alias("title"), has("women").alias("women"),
        P.longest_named("weightclass", WEIGHT_CLASSES).alias("weight_lbs"), F.size(lengths).alias("sched_rounds"), F.when(total > 0, total).alias("sched_secs"),
        P.elapsed_seconds(lengths, end_round, end_time).alias("fight_secs"), F.when(F.trim("outcome") == "W/L", 1.0).when(F.trim("outcome") == "L/W", 0.0).alias("winner"),
    )


def rounds(stats: DataFrame, bouts: DataFrame, pairs: list[str], counts: list[str]) -> DataFrame:
    """fight_id, fighter_id, round and, for each of ``pairs`` (``x of y``), ``<name>_l`` and ``<name>_a``, for each of ``counts`` a number.

    Exact repeats fall out, then one row for each key stays (the least in its raw values). Fighters are found by their names on the bout.
    """
    s = stats.distinct().withColumns({"round": F.col("round").try_cast("int"), "slug": P.slug("fighter")})
    b = bouts.select("fight_id", F.explode(F.array("f1_id", "f2_id")).alias("slug"))
    typed = [x for p in pairs for x in (P.number_pair(p)["landed"].alias(f"{p}_l"), P.number_pair(p)["attempted"].alias(f"{p}_a"))] + [F.col(c).try_cast("double").alias(c) for c in counts]
    return one_of(s.join(b, ["fight_id", "slug"]), ["fight_id", "slug", "round"], [*pairs, *counts]).select("fight_id", F.col("slug").alias("fighter_id"), "round", *typed)


def bout_totals(perf: DataFrame, columns: list[str]) -> DataFrame:
    """Sums by bout and fighter: null where every value is null; ``<name>_r1`` of the first round, ``<name>_late`` from the third on, zero where there is none."""
    late, first = F.col("round") >= 3, F.col("round") == 1
    part = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    return perf.groupBy("fight_id", "fighter_id").agg(F.count("*").alias("n_rounds"), *(x for c in columns for x in (F.sum(c).alias(c), part(c, first).alias(f"{c}_r1"), part(c, late).alias(f"{c}_late"))))


def profiles(raw: DataFrame) -> DataFrame:
    """fighter_id, height and reach in inches, dob, stance (Unknown where blank)."""
    stance = F.trim("stance")
    return raw.select(P.slug("fighter").alias("fighter_id"), P.height_inches("height").alias("height"), P.inches("reach").alias("reach"), P.any_date("dob").alias("dob"), F.when((stance == "") | stance.isNull() | (stance == "--"), "Unknown").otherwise(stance).alias("stance"))


def filled(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``first`` with the gaps of ``columns`` filled from ``second``."""
    other = second.select(key, *(F.col(c).alias("__" + c) for c in columns))
    return first.join(other, key, "left").withColumns({c: F.coalesce(c, "__" + c) for c in columns}).drop(*("__" + c for c in columns))


def lines(raw: DataFrame) -> DataFrame:
    """One row for each date and pair of pages, oriented by the lesser lower-cased url.

    ``raw`` has date, and for each side f1, f2: _url, _open, _close (American odds) and ``spark`` (prices of f1, joined by commas). Rows
    of both pages collapse: of each value the first that is known, rows in order of their own text. ``n_rows`` is how many there were,
    and ``one_open`` whether all known openings of f1 are one number.
    """
    r = raw.filter("f1_url IS NOT NULL AND f2_url IS NOT NULL").withColumn("swap", F.lower("f1_url") > F.lower("f2_url"))
    side = lambda k, c: F.when(F.col("swap"), F.col(f"f{3 - k}_{c}")).otherwise(F.col(f"f{k}_{c}"))
    prices = F.transform(F.split("spark", ","), lambda x: x.try_cast("double"))
    o = r.select(
        P.any_date("date").alias("date"), *(side(k, c).alias(f"f{k}_{c}") for c in ("url", "open", "close") for k in (1, 2)), F.concat_ws("|", "f1_url", "spark", "f1_open", "f1_close").alias("__order"),
        *(F.when(F.col("swap") == (k == 2), F.element_at(prices, -1)).alias(f"f{k}_last") for k in (1, 2)), F.when(F.col("spark") != "", F.size(prices)).otherwise(0).alias("n_spark"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__order"))).alias(c)
    odds = [P.signed_int(f"f{k}_{c}").alias(f"f{k}_{c}") for c in ("open", "close") for k in (1, 2)]
    opened = P.signed_int("f1_open")
    g = o.groupBy("date", "f1_url", "f2_url").agg(*(first(f"f{k}_{c}") for c in ("open", "close") for k in (1, 2)), F.max("f1_last").alias("f1_last"), F.max("f2_last").alias("f2_last"), F.max("n_spark").alias("n_spark"), F.count("*").alias("n_rows"), (F.min(opened) == F.max(opened)).alias("one_open"))
    return g.select("date", "f1_url", "f2_url", *odds, "f1_last", "f2_last", "n_spark", "n_rows", "one_open")


def line_stage(days: Column, now: Column, opened: Column, horizon: float = 28.0, stages: int = 9, still: float = 0.003) -> Column:
    """Where a line stands between its opening (0) and its close (1): by the days that are left, or 0 if it has not moved."""
    by_days = F.least(F.greatest(1 - days / horizon, F.lit(1.0 / stages)), F.lit(1.0))
    return F.when(F.abs(now - opened) < still, 0.0).otherwise(by_days)


def records(raw: DataFrame, flag: str) -> DataFrame:
    """entity, opponent, date, kind, res (1, 0, 0.5; null: no contest), is_ko, is_sub, promo and flagged (its event matches ``flag``) of each record, repeats dropped."""
    result, method = F.lower(F.trim("result")), F.upper(F.trim("method"))
    res = F.when(result == "win", 1.0).when(result == "loss", 0.0).when(result == "draw", 0.5)
    promo = promotion("event")
    rows = raw.select("entity", "opponent", P.any_date("date").alias("date"), F.lower(F.trim("kind")).alias("kind"), res.alias("res"), (method.startswith("KO") | method.startswith("TKO")).alias("is_ko"), method.startswith("SUB").alias("is_sub"), promo.alias("promo"), F.col("event").rlike(flag).alias("flagged"))
    return rows.distinct()


def promotion(event: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """What stands before `` - ``, without the number (``7``, ``#7``, ``12.5``, also right behind a name) or Roman numeral that ends it; ``aliases`` rename."""
    name = F.split(F.trim(F.substring_index(P.collapse(event), " - ", 1)), " ")
    last = F.ltrim(F.element_at(name, -1), F.lit("#"))
    numeral = (last != "") & ((F.translate(last, "IVX", "") == "") | last.try_cast("decimal(20,4)").isNotNull())
    glued = F.rtrim(F.rtrim(F.rtrim(F.element_at(name, -1), F.lit("0123456789")), F.lit("#")))
    rest = F.array_join(F.slice(name, 1, F.size(name) - 1), " ")
    c = F.when(numeral, rest).when(last.rlike("[0-9]$"), F.concat_ws(" ", F.when(rest != "", rest), glued)).otherwise(F.array_join(name, " "))
    for old, new in (aliases or {}).items():
        c = F.when(c == old, F.lit(new)).otherwise(c)
    return c


def upcoming(cards: DataFrame, today: Column, days: int, known: DataFrame) -> DataFrame:
    """Scheduled bouts of the next ``days`` in the shape of ``known`` fights, results null; bouts that ``known`` holds already fall out."""
    c = cards.select(P.any_date("date").alias("date"), P.vs_names("bout").alias("names"), "weightclass", F.col("main").cast("boolean").alias("main"))
    rounds_ = F.when(F.col("main") | F.contains(F.lower("weightclass"), F.lit("title")), 5).otherwise(3)
    shaped = c.filter(F.col("date").between(today, F.date_add(today, days))).select(
        F.sha1(F.concat_ws("|", F.col("date").cast("string"), F.get("names", 0), F.get("names", 1))).alias("fight_id"), "date", P.slug(F.get("names", 0)).alias("f1_id"), P.slug(F.get("names", 1)).alias("f2_id"),
        P.longest_named("weightclass", WEIGHT_CLASSES).alias("weight_lbs"), rounds_.alias("sched_rounds"),
    )
    fresh = shaped.join(known.select("date", "f1_id", "f2_id"), ["date", "f1_id", "f2_id"], "left_anti").join(known.select("date", F.col("f2_id").alias("f1_id"), F.col("f1_id").alias("f2_id")), ["date", "f1_id", "f2_id"], "left_anti")
    return known.limit(0).unionByName(fresh, allowMissingColumns=True)


def geocoded(places: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """place, lat, lon: an override, else the likeliest candidate of the same city.

    ``places`` (place: ``city, region, country``), ``candidates`` (city, region, country, population, lat, lon), ``overrides`` (place,
    lat, lon). A candidate scores 4 for the country, 2 for a region that holds the place's, and up to 1.5 for millions of people; one
    of another country is no match. Ties go to the least coordinates.
    """
    part = F.split("place", r"\s*,\s*")
    p = places.select("place", F.get(part, 0).alias("city"), F.when(F.size(part) > 2, F.get(part, 1)).alias("admin"), P.country_of("place").alias("land"))
    c = p.join(candidates, "city")
    score = F.when(F.col("country") == F.col("land"), 4.0).otherwise(0.0) + F.when(F.contains(F.lower("region"), F.lower("admin")), 2.0).otherwise(0.0) + F.least(F.coalesce(F.col("population") / 1e6, F.lit(0.0)), F.lit(1.5))
    best = c.groupBy("place", "land").agg(F.max(F.struct(score.alias("score"), (-F.col("lat")).alias("lat"), (-F.col("lon")).alias("lon"), "country")).alias("b"))
    best = best.filter(F.col("b.country") == F.col("land")).select("place", (-F.col("b.lat")).alias("g_lat"), (-F.col("b.lon")).alias("g_lon"))
    known = overrides.select("place", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    return places.select("place").distinct().join(known, "place", "left").join(best, "place", "left").select("place", F.coalesce("o_lat", "g_lat").alias("lat"), F.coalesce("o_lon", "g_lon").alias("lon"))
