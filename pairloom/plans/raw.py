"""Queries over the readers: raw strings are spelled from the test tables as sources spell them, read back, and compared with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import functions as P
from pairloom.plans.catalog import C, query, r
from pairloom.plans.contests import contests, table
from pairloom.operators import match
from pairloom.sources import bouts, pages

DAYS = ["MMMM d, yyyy", "MMM d, yyyy", "MMM/d/yyyy", "MMM d yyyy", "yyyy-MM-dd", "yyyyMMdd"]


def spelled_day(date, k):
    """The date in one of the spellings."""
    c = F.date_format(date, DAYS[0])
    for i, f in enumerate(DAYS[1:], 1):
        c = F.when(k % len(DAYS) == i, F.date_format(date, f)).otherwise(c)
    return c


@query("parsed_scalars", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (o_orderkey % 401 - 200)::INT AS odds, (o_orderkey % 6)::INT * 60 + (o_orderkey % 60)::INT AS secs, (60 + o_orderkey % 20)::DOUBLE AS height,
CAST(o_orderdate AS DATE) AS epoch_day, (o_orderkey % 50)::DOUBLE AS landed, (o_orderkey % 50 + 7)::DOUBLE AS attempted, (date_diff('minute', timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE 'UTC', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR) / 60.0)::DOUBLE AS zone,
round(((o_orderkey % 3) + (o_orderkey % 5)) / 2.0::DOUBLE - 1, 6) AS margin, 'x' || o_orderkey || ' & y' AS shown, 'before after' AS plain FROM orders""")
def parsed_scalars(spark, d):
    """Dates in six spellings, signs in two, clocks, heights, pairs, epochs, offsets, judges' margins, HTML and wikitext."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    sign = F.concat(F.when(k % 401 < 200, F.lit("−")).otherwise("+"), F.abs(k % 401 - 200).cast("string"))
    raw = o.select(
        "o_orderkey", "day", spelled_day("day", k).alias("date"), sign.alias("odds"), F.concat((k % 6).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("time"),
        F.when(k % 2 == 0, F.concat(F.floor((60 + k % 20) / 12), F.lit("' "), (60 + k % 20) % 12, F.lit('"'))).otherwise(F.concat(F.floor((60 + k % 20) / 12), F.lit(" ft "), (60 + k % 20) % 12, F.lit(" in"))).alias("tall"),
        (F.unix_date("day").cast("long") * 86_400_000 + k % 86_400_000).alias("ms"), F.concat(k % 50, F.lit(" of "), k % 50 + 7).alias("pair"),
        F.concat(F.lit("Judge 20 - "), 19 + k % 3, F.lit(". Other 20 - "), 19 + k % 5, F.lit(".")).alias("cards"), F.concat(F.lit("<td><b>x"), k, F.lit("</b> &amp; y</td>")).alias("html"),
    )
    return raw.select(
        "o_orderkey", P.any_date("date").alias("day"), P.signed_int("odds").alias("odds"), P.clock_seconds("time").alias("secs"), P.height_inches("tall").alias("height"), P.day_of_epoch_ms(F.col("ms")).alias("epoch_day"),
        P.number_pair("pair")["landed"].alias("landed"), P.number_pair("pair")["attempted"].alias("attempted"), P.utc_offset_hours(F.col("day"), "America/New_York").cast("double").alias("zone"),
        r(P.judge_margin("cards")).alias("margin"), P.html_text("html").alias("shown"), P.strip_markup(F.lit("before{{a|{{b}}}}<ref name='x'>y</ref> after")).alias("plain"),
    )


def raw_bouts(spark, d):
    """Events, details and results as strings, two bouts of each being listed twice."""
    c = contests(spark, d).withColumn("card", F.concat(F.lit("Card "), F.col("day").cast("string")))
    k = F.col("contest_id")
    events = c.select(F.concat(F.col("card"), F.lit(" ")).alias("event"), F.date_format("date", DAYS[0]).alias("date"), F.concat(F.lit("http://x/event/e"), "day").alias("url"), F.lit("Hall, Nevada, USA").alias("location")).distinct()
    url = F.concat(F.lit("http://x/fight/f"), k)
    details = c.select("card", F.concat(F.lit(" Side "), "a_id", F.lit("  vs.  Side "), "b_id").alias("bout"), url.alias("url"), k.cast("string").alias("position")).withColumnRenamed("card", "event")
    size = F.when(k % 5 == 0, 5).otherwise(3)
    form = F.when(k % 11 == 0, "No Time Limit").when(k % 5 == 0, "5 Rnd (5-5-5-5-5)").otherwise("3 Rnd (5-5-5)")
    kind = F.element_at(F.array(*map(F.lit, ["Lightweight Bout", "Top Light Heavyweight Title Bout", "Women's Flyweight Bout", "Open Weight Bout"])), (k % 4 + 1).cast("int"))
    results = c.select("card", url.alias("url"), F.concat(F.lit(" "), "outcome").alias("outcome"), kind.alias("weightclass"), "method", (k % size + 1).cast("string").alias("round"), F.concat(k % 5, F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("time"), form.alias("time_format")).withColumnRenamed("card", "event")
    return events, details.unionByName(details.filter(F.col("position").cast("long") % 50 == 0)), results


@query("bout_records", C + """, n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY contest_id) - 1 AS bout_order, count(*) OVER (PARTITION BY day) AS n_bouts, CASE WHEN contest_id % 11 = 0 THEN 0 WHEN contest_id % 5 = 0 THEN 5 ELSE 3 END AS rounds,
contest_id % (CASE WHEN contest_id % 5 = 0 THEN 5 ELSE 3 END) + 1 AS er, (contest_id % 5) * 60 + contest_id % 60 AS et FROM contests)
SELECT 'f' || contest_id AS fight_id, 'e' || day AS event_id, date, bout_order::INT AS bout_order, n_bouts, 'side-' || a_id AS f1_id, 'side-' || b_id AS f2_id, outcome, rounds::INT AS sched_rounds, CASE WHEN rounds > 0 THEN rounds * 300 END::INT AS sched_secs,
(CASE WHEN er <= rounds THEN (er - 1) * 300 + et ELSE et END)::INT AS fight_secs, contest_id % 4 = 1 AS title, contest_id % 4 = 2 AS women, CASE contest_id % 4 WHEN 0 THEN 155 WHEN 1 THEN 205 WHEN 2 THEN 125 END::INT AS weight_lbs, CASE outcome WHEN 'W/L' THEN 1.0::DOUBLE WHEN 'L/W' THEN 0.0 END AS winner FROM n""")
def bout_records(spark, d):
    """Events, details and results joined and typed."""
    f = bouts.fights(*raw_bouts(spark, d))
    return f.select("fight_id", "event_id", "date", "bout_order", "n_bouts", "f1_id", "f2_id", "outcome", "sched_rounds", "sched_secs", "fight_secs", "title", "women", "weight_lbs", "winner")


@query("round_totals", """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s, l_linenumber AS r, l_quantity::INT AS q, l_returnflag AS f FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY k, s, r ORDER BY q, CASE WHEN f <> 'N' THEN r::VARCHAR ELSE '---' END) AS i FROM s)
SELECT 'f' || k AS fight_id, 'side-' || s AS fighter_id, count(*) AS n_rounds, sum(q)::DOUBLE AS sig_a, sum(q // 2)::DOUBLE AS sig_l, coalesce(sum(CASE WHEN r = 1 THEN q // 2 END), 0)::DOUBLE AS sig_l_r1, coalesce(sum(CASE WHEN r >= 3 THEN q // 2 END), 0)::DOUBLE AS sig_l_late, sum(CASE WHEN f <> 'N' THEN r END)::DOUBLE AS kd FROM u WHERE i = 1 GROUP BY k, s""")
def round_totals(spark, d):
    """``x of y`` by round, repeats dropped, summed by bout and fighter with first and late rounds; null sums where nothing is known."""
    l = table(spark, d, "lineitem")  # noqa: E741
    q = F.col("l_quantity").cast("int")
    raw = l.select(F.concat(F.lit("f"), "l_orderkey").alias("fight_id"), F.concat(F.lit(" SIDE "), "l_suppkey").alias("fighter"), F.col("l_linenumber").cast("string").alias("round"), F.concat(F.lpad(F.floor(q / 2).cast("string"), 2, "0"), F.lit(" of "), F.lpad(q.cast("string"), 2, "0")).alias("sig"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("string")).otherwise("---").alias("kd"))
    known = l.select(F.concat(F.lit("f"), "l_orderkey").alias("fight_id"), F.concat(F.lit("side-"), "l_suppkey").alias("f1_id"), F.lit(None).cast("string").alias("f2_id")).distinct()
    perf = bouts.rounds(raw.unionByName(raw.filter("round = '2'")), known, ["sig"], ["kd"])
    return bouts.bout_totals(perf, ["sig_l", "sig_a", "kd"]).select("fight_id", "fighter_id", "n_rounds", "sig_a", "sig_l", "sig_l_r1", "sig_l_late", "kd")


@query("profile_gaps", """SELECT 'customer-' || c_custkey AS fighter_id, CASE WHEN c_custkey % 3 = 0 THEN 70.0 ELSE 60 + c_custkey % 20 END::DOUBLE AS height, CASE WHEN c_custkey % 4 <> 0 THEN 65.5 + c_custkey % 15 END::DOUBLE AS reach, DATE '1980-01-01' + (c_custkey % 5000)::INT AS dob, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE 'Orthodox' END AS stance FROM customer""")
def profile_gaps(spark, d):
    """Heights, reaches, birth dates and stances from text, with gaps filled from a second source."""
    k = F.col("c_custkey")
    inch = 60 + k % 20
    raw = table(spark, d, "customer").select(
        F.concat(F.lit("Customer "), k).alias("fighter"), F.when(k % 3 == 0, "--").otherwise(F.concat(F.floor(inch / 12), F.lit("' "), inch % 12, F.lit('"'))).alias("height"), F.when(k % 4 == 0, "--").otherwise(F.concat((65.5 + k % 15).cast("string"), F.lit('"'))).alias("reach"),
        F.date_format(F.date_add(F.lit("1980-01-01").cast("date"), (k % 5000).cast("int")), "MMM dd, yyyy").alias("dob"), F.when(k % 5 == 0, "").otherwise(" Orthodox").alias("stance"),
    )
    other = table(spark, d, "customer").select(F.concat(F.lit("customer-"), k).alias("fighter_id"), F.lit(70.0).alias("height"))
    return bouts.filled(bouts.profiles(raw), other, "fighter_id", ["height"])


@query("market_lines", C + """, l AS (SELECT date, 'u' || a_id AS u1, 'u' || b_id AS u2, (100 + contest_id % 200)::INT AS o1, (-100 - contest_id % 150)::INT AS o2, contest_id % 7 + 1 AS n, round(1.5::DOUBLE + contest_id % 40 / 16.0::DOUBLE, 4) AS last FROM contests)
SELECT date, least(u1, u2) AS f1_url, greatest(u1, u2) AS f2_url, count(*) AS n_rows, max(CASE WHEN u1 <= u2 THEN last END) AS f1_last, max(CASE WHEN u1 > u2 THEN last END) AS f2_last, max(n)::INT AS n_spark,
count(DISTINCT CASE WHEN u1 <= u2 THEN o1 ELSE o2 END) = 1 OR NULL AS one_open FROM l GROUP BY 1, 2, 3""")
def market_lines(spark, d):
    """Lines oriented by url and collapsed by date and pair; the opening is one of the rows'."""
    k = F.col("contest_id")
    c = contests(spark, d)
    last = F.round(1.5 + k % 40 / 16.0, 4)
    spark_text = F.array_join(F.concat(F.array_repeat(F.lit("1.25"), (k % 7).cast("int")), F.array(last.cast("string"))), ",")
    raw = c.select(spelled_day("date", k).alias("date"), F.concat(F.lit("u"), "a_id").alias("f1_url"), F.concat(F.lit("u"), "b_id").alias("f2_url"), F.concat(F.lit("+"), 100 + k % 200).alias("f1_open"), F.concat(F.lit("−"), 100 + k % 150).alias("f2_open"), F.lit("-110").alias("f1_close"), F.lit("").alias("f2_close"), spark_text.alias("spark"))
    m = bouts.lines(raw)
    return m.select("date", "f1_url", "f2_url", "n_rows", "f1_last", "f2_last", "n_spark", F.when(F.col("one_open") & F.col("f1_open").isNotNull(), True).alias("one_open"))


@query("line_stages", C + """SELECT contest_id, CASE WHEN abs(p_close - p_open) < 0.003 THEN 0 ELSE least(greatest(1 - (contest_id % 40) / 28.0::DOUBLE, 1 / 9.0::DOUBLE), 1) END::DOUBLE AS stage FROM contests""")
def line_stages(spark, d):
    return contests(spark, d).select("contest_id", bouts.line_stage(F.col("contest_id") % 40, F.col("p_close"), F.col("p_open")).alias("stage"))


@query("scheduled_cards", C + """, t AS (SELECT DATE '1998-01-01' AS today), k AS (SELECT date, a_id, b_id FROM contests WHERE contest_id % 2 = 0)
SELECT date, 'side-' || a_id AS f1_id, 'side-' || b_id AS f2_id, CASE contest_id % 3 WHEN 0 THEN 155 WHEN 1 THEN 245 END::INT AS weight_lbs, CASE WHEN contest_id % 4 = 1 OR contest_id % 3 = 1 THEN 5 ELSE 3 END::INT AS sched_rounds, NULL::DOUBLE AS winner FROM contests c, t
WHERE date BETWEEN today AND today + 60 AND contest_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.date = c.date AND ((k.a_id = c.a_id AND k.b_id = c.b_id) OR (k.a_id = c.b_id AND k.b_id = c.a_id)))""")
def scheduled_cards(spark, d):
    """Cards of the next 60 days in the shape of known bouts, less those that are known."""
    k = F.col("contest_id")
    c = contests(spark, d)
    known = c.filter(k % 2 == 0).select(F.concat(F.lit("f"), k).alias("fight_id"), "date", F.concat(F.lit("side-"), "a_id").alias("f1_id"), F.concat(F.lit("side-"), "b_id").alias("f2_id"), F.lit(155).alias("weight_lbs"), F.lit(3).alias("sched_rounds"), F.col("y").alias("winner"))
    kind = F.element_at(F.array(*map(F.lit, ["Lightweight", "Heavyweight Title", "Catchweight"])), (k % 3 + 1).cast("int"))
    cards = c.filter(k % 2 == 1).select(F.date_format("date", DAYS[0]).alias("date"), F.concat(F.lit("Side "), "a_id", F.lit(" vs. Side "), "b_id").alias("bout"), kind.alias("weightclass"), (k % 4 == 1).alias("main"))
    return bouts.upcoming(cards, F.lit("1998-01-01").cast("date"), 60, known).drop("fight_id")


@query("geocoded_places", """WITH c AS (SELECT s_suppkey AS k, 'City ' || (s_suppkey % 40) AS city, 'Region ' || (s_suppkey % 6) AS region, n_name AS country, abs(s_acctbal) * 1000 AS population, (s_suppkey % 90)::DOUBLE AS lat, s_acctbal AS lon FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT DISTINCT city || ', ' || region || ', ' || country AS place, city, region AS admin, country AS land FROM c WHERE k % 3 = 0 UNION SELECT DISTINCT city || ', Nowhere', city, NULL, 'Nowhere' FROM c WHERE k % 7 = 0 UNION SELECT 'City 1, Nowhere', 'City 1', NULL, 'Nowhere'),
b AS (SELECT place, lat, lon, row_number() OVER (PARTITION BY place ORDER BY CASE WHEN c.country = land THEN 4 ELSE 0 END + CASE WHEN admin IS NOT NULL AND contains(lower(region), lower(admin)) THEN 2 ELSE 0 END + least(population / 1000000, 1.5) DESC, lat, lon) AS i, c.country = land AS ok FROM p JOIN c USING (city))
SELECT p.place, CASE WHEN p.place = 'City 1, Nowhere' THEN 1.5 ELSE b.lat END::DOUBLE AS lat, CASE WHEN p.place = 'City 1, Nowhere' THEN 2.5 ELSE b.lon END::DOUBLE AS lon FROM p LEFT JOIN b ON b.place = p.place AND i = 1 AND ok""")
def geocoded_places(spark, d):
    """Places matched to the likeliest candidate, manual ones first."""
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(k.alias("k"), F.concat(F.lit("City "), k % 40).alias("city"), F.concat(F.lit("Region "), k % 6).alias("region"), F.col("n_name").alias("country"), (F.abs("s_acctbal") * 1000).alias("population"), (k % 90).cast("double").alias("lat"), F.col("s_acctbal").alias("lon"))
    manual = spark.createDataFrame([("City 1, Nowhere", 1.5, 2.5)], "place string, lat double, lon double")
    places = c.filter("k % 3 = 0").select(F.concat_ws(", ", "city", "region", "country").alias("place")).union(c.filter("k % 7 = 0").select(F.concat(F.col("city"), F.lit(", Nowhere")))).union(manual.select("place")).distinct()
    return bouts.geocoded(places, c.drop("k"), manual)


@query("pro_records", C + """, x AS (SELECT DISTINCT id, opp, date, CASE class WHEN 0 THEN 'amateur' ELSE 'pro' END AS kind, res, method = 'R' AS is_ko, method = 'A' AS is_sub, CASE class WHEN 1 THEN 'Top League' WHEN 2 THEN 'Cage Night' ELSE 'Arena' END AS promo, class = 1 AS flagged FROM sides)
SELECT id AS entity, kind, count(*) AS n, sum(res) AS points, count(*) FILTER (WHERE is_ko) AS kos, count(*) FILTER (WHERE is_sub) AS subs, count(*) FILTER (WHERE flagged) AS flagged, count(DISTINCT promo) AS promos, min(date) AS first_day FROM x GROUP BY 1, 2""")
def pro_records(spark, d):
    """Results, methods, promotions and flags from record strings, repeats dropped."""
    return record_table(spark, d).groupBy("entity", "kind").agg(
        F.count("*").alias("n"), F.sum("res").alias("points"), F.count_if("is_ko").alias("kos"), F.count_if("is_sub").alias("subs"), F.count_if("flagged").alias("flagged"), F.count_distinct("promo").alias("promos"), F.min("date").alias("first_day"))


def record_table(spark, d):
    from pairloom.plans.contests import participants

    p = participants(contests(spark, d))
    k = F.col("day")
    result = F.when(F.col("res") == 1, " win").when(F.col("res") == 0, "Loss ").when(F.col("res") == 0.5, "DRAW").otherwise("NC")
    method = F.when(F.col("method") == "R", F.when(k % 2 == 0, "TKO (Punches)").otherwise("KO (Kick)")).when(F.col("method") == "A", "Submission (Choke)").otherwise("Decision")
    event = F.when(F.col("class") == 1, F.concat(F.lit("Top League "), k % 300, F.lit(" - A vs B"))).when(F.col("class") == 2, "Cage Night IX - C vs D").otherwise("Arena #12")
    kind = F.when(F.col("class") == 0, "Amateur").otherwise("Pro")
    raw = p.select(F.col("id").alias("entity"), F.col("opp").alias("opponent"), spelled_day("date", k).alias("date"), result.alias("result"), method.alias("method"), event.alias("event"), kind.alias("kind"))
    return bouts.records(raw.unionByName(raw.filter("entity % 2 = 0")), r"(?i)\btop league\b")


@query("page_tables", """WITH q AS (SELECT o_orderkey AS k, [o_orderkey % 301 - 150, NULL, o_orderkey % 211 + 100] AS o FROM orders) SELECT k, u.i::INT AS row, CASE WHEN u.i = 1 THEN 'Side & A' ELSE 'Side B' END AS label, ['one', 'two', 'three'][j.j] AS book, (CASE WHEN u.i = 2 THEN -o[j.j] ELSE o[j.j] END)::INT AS odds
FROM q, (VALUES (1), (2)) u(i), (VALUES (1), (3)) j(j)""")
def page_tables(spark, d):
    """Quotes of three books out of an HTML table."""
    k = F.col("o_orderkey")
    cell = lambda c: F.concat(F.lit("<td class='q'>"), F.translate(c.cast("string"), "-", "−"), F.lit("</td>"))
    line = lambda name, sign: F.concat(F.lit(f"<tr><th><a href='/x'>{name}</a></th>"), cell(sign * (k % 301 - 150)), F.lit("<td></td>"), cell(sign * (k % 211 + 100)), F.lit("</tr>"))
    html = F.concat(F.lit("<table><tr><th>Bout</th><th>one</th><th>two</th><th>three</th></tr>\n"), line("Side &amp; A", 1), line("Side B", -1), F.lit("</table>"))
    return pages.quotes(pages.table_rows(table(spark, d, "orders").select(k.alias("k"), html.alias("html")), "html", ["k"]), ["k"], ["one", "two", "three"])


@query("market_json", """SELECT o_orderkey AS k, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'H' || o_custkey AS home, 'A' || o_custkey AS away, (o_orderkey % 300 + 100)::INT AS home_price, NULL::INT AS away_price, date_trunc('day', o_orderdate)::DATE AS view_day, (o_orderkey % 1000)::BIGINT AS views FROM orders WHERE o_orderkey % 3 <> 0""")
def market_json(spark, d):
    """Two-sided matchups and daily views out of JSON answers; what has another number of participants falls out."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    ms = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86_400_000 + 7_200_000
    people = F.when(k % 3 == 0, F.lit('[{"name":"only"}]')).otherwise(F.concat(F.lit('[{"name":"H'), "o_custkey", F.lit('","alignment":"home"},{"name":"A'), "o_custkey", F.lit('","alignment":"away"}]')))
    payload = F.concat(F.lit('[{"id":'), k, F.lit(',"startTime":'), ms, F.lit(',"participants":'), people, F.lit(',"prices":[{"designation":"home","price":'), k % 300 + 100, F.lit("}]}]"))
    views = F.concat(F.lit('{"items":[{"timestamp":"'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('00","views":'), k % 1000, F.lit("}]}"))
    m = pages.markets(o.select(k.alias("k"), payload.alias("p")), "p", ["k"])
    v = pages.daily_views(o.select(k.alias("k"), views.alias("p")), "p", ["k"]).select("k", F.col("day").alias("view_day"), "views")
    return m.join(v, "k")


@query("card_notes", """SELECT p_partkey AS k, (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS missed, (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS replaced, 3::BIGINT AS sentences, p_partkey % 2 = 0 AS on_name, false AS on_other FROM part""")
def card_notes(spark, d):
    """Sentences of an article before its results, with missed weights and replacements, and whom they tell of."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit("{{Infobox|date={{start date|2001}}}}The [[Hall|old hall]] was full<ref>n</ref>. [[Man"), k, F.lit("]] "), F.when(k % 2 == 0, "missed weight by far").otherwise("made weight"), F.lit(" before he met some other person of the name of Rival"), k,
        F.lit(". Later on "), F.when(k % 3 == 0, "one stepped in").otherwise("all was well"), F.lit(".\n==Results==\nHe was replaced by X."))
    s = pages.background(table(spark, d, "part").select(k.alias("k"), body.alias("text")), "text", ["k"])
    named = lambda mine, other: F.bool_or(F.when(F.col("missed"), pages.attributed(F.col("sentence"), "missed weight", F.concat(F.lit(mine), F.col("k").cast("string")), F.concat(F.lit(other), F.col("k").cast("string")))).otherwise(False))
    return s.groupBy("k").agg(F.count_if("missed").alias("missed"), F.count_if("replaced").alias("replaced"), F.count("*").alias("sentences"), named("Man", "Rival").alias("on_name"), named("Rival", "Man").alias("on_other"))


@query("article_heads", """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'Card ' || s_suppkey END AS redirect, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE DATE '2001-03-04' + (s_suppkey % 20)::INT END AS date,
CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END END::BIGINT AS over FROM supplier""")
def article_heads(spark, d):
    """Redirects, dates and weights over the limit in articles whose templates lie in one another."""
    k = F.col("s_suppkey")
    day = F.date_add(F.lit("2001-03-04").cast("date"), (k % 20).cast("int"))
    date = F.when(k % 5 < 3, F.concat(F.lit("{{start date|"), F.date_format(day, "yyyy|M|d"), F.lit("|df={{yes|{{no}}}}}}"))).when(k % 5 == 3, F.date_format(day, "MMMM d, yyyy")).otherwise("unknown")
    body = F.concat(F.lit("{{Infobox\n|name = x\n|date = "), date, F.lit("\n|place = {{flag|{{a|{{b}}}}}}\n}}The [[a b|A]] "), F.when(k % 2 == 0, "weighed in at 171.5 pounds, over the limit").otherwise("weighed in at 170 pounds"), F.lit(". All was well.\n== Results ==\nX missed weight."))
    t = table(spark, d, "supplier").select(k.alias("k"), F.when(k % 5 == 0, F.concat(F.lit("#REDIRECT [[Card "), k, F.lit("#top]]"))).otherwise(body).alias("text"))
    s = pages.background(t, "text", ["k"]).groupBy("k").agg(F.count_if("missed").alias("over"))
    return t.select("k", *(c.alias(n) for n, c in pages.article_head("text").items())).join(s, "k").withColumn("over", F.when(F.col("redirect").isNull(), F.col("over")))


@query("piped_profiles", """SELECT s_suppkey AS k, 'Name ' || s_suppkey AS name, (s_suppkey % 50 + 1)::VARCHAR AS rank, NULL::VARCHAR AS note FROM supplier""")
def piped_profiles(spark, d):
    """Fields of a tooltip split at bars; ordinals become numbers, blanks null."""
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(k.alias("k"), F.concat(F.lit("Name "), k, F.lit(" | "), k % 50 + 1, F.lit("th |  ")).alias("t"))
    return raw.select("k", pages.piped("t", ["name", "rank", "note"]).alias("p")).select("k", "p.*")


@query("either_links", """WITH a AS (SELECT c_custkey AS k, 'u' || c_custkey AS link FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_nationkey AS n, min('n' || c_custkey) AS link FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT c_custkey, c_nationkey, coalesce(a.link, b.link) AS link FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.n = c_nationkey""")
def either_links(spark, d):
    """A link by the first source's key, else by the second's."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    first = c.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("u"), "c_custkey").alias("link"))
    second = c.filter("c_custkey % 2 = 0").groupBy("c_nationkey").agg(F.min(F.concat(F.lit("n"), "c_custkey")).alias("link"))
    return match.either_link(c, first, second, "c_custkey", "c_nationkey", "link")


@query("voted_links", C + """SELECT a_id AS entity, 'e' || a_id AS candidate FROM contests GROUP BY a_id""")
def voted_links(spark, d):
    """Each side's page by the sum of its contests' link scores; every seventh contest names the wrong page."""
    c = contests(spark, d)
    wrong = F.concat(F.lit("e"), (F.col("a_id") + 1).cast("string"))
    links = c.select(F.col("a_id").alias("entity"), F.concat(F.lit("e"), F.col("a_id").cast("string")).alias("candidate"), F.lit(90.0).alias("score")).union(c.filter("contest_id % 7 = 0").select("a_id", wrong, F.lit(80.0)))
    return match.vote(links, "entity", "candidate").select("entity", "candidate")
