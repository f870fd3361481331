"""Rows out of HTML tables, JSON answers and wikitext, with regular expressions and ``from_json`` on the JVM."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import functions as P


def table_rows(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep``, row (from 0) and cells (array of texts) of each ``<tr>`` with a cell."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    r = df.select(*keep, F.posexplode(rows).alias("row", "__tr"))
    cells = F.transform(F.regexp_extract_all("__tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), P.html_text)
    return r.select(*keep, "row", cells.alias("cells")).filter(F.size("cells") > 0)


def items(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep``, item, href and name of each link in a list."""
    pattern = r"(?is)<li[^>]*>\s*<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    group = lambda g: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(g))
    return df.select(*keep, F.posexplode(F.arrays_zip(group(1).alias("href"), group(2).alias("name"))).alias("item", "__i")).select(*keep, "item", F.col("__i.href").alias("href"), P.html_text("__i.name").alias("name"))


def quotes(rows: DataFrame, keep: list[str], books: list[str]) -> DataFrame:
    """``keep``, row, label, book, odds: cells after the first are the quotes of ``books``; blanks fall out."""
    q = rows.select(*keep, "row", F.get("cells", 0).alias("label"), F.posexplode(F.slice("cells", 2, len(books))).alias("__k", "__q"))
    return q.select(*keep, "row", "label", F.get(F.array(*map(F.lit, books)), F.col("__k")).alias("book"), P.signed_int("__q").alias("odds")).filter("odds IS NOT NULL")


def piped(c: Column | str, names: list[str]) -> Column:
    """A struct of the trimmed fields of ``a|b|c``; numbers without their ordinal endings where they have some."""
    parts = F.split(c if isinstance(c, Column) else F.col(c), r"\|")
    clean = lambda x: F.regexp_replace(F.trim(x), r"(?<=\d)(st|nd|rd|th)$", "")
    return F.struct(*(F.when(clean(F.get(parts, i)) != "", clean(F.get(parts, i))).alias(n) for i, n in enumerate(names)))


MATCHUPS = "array<struct<id:bigint,startTime:bigint,participants:array<struct<name:string,alignment:string>>,prices:array<struct<designation:string,price:int>>>>"


def markets(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """``keep``, id, day, home, away, home_price, away_price of each matchup with exactly two participants in a JSON answer."""
    m = df.select(*keep, F.explode(F.from_json(F.col(payload), MATCHUPS)).alias("m")).filter(F.size("m.participants") == 2)
    one = lambda xs, field, want, out: F.get(F.filter(F.col(xs), lambda p: p[field] == want), 0)[out]
    return m.select(
        *keep, "m.id", P.day_of_epoch_ms(F.col("m.startTime")).alias("day"), one("m.participants", "alignment", "home", "name").alias("home"), one("m.participants", "alignment", "away", "name").alias("away"),
        one("m.prices", "designation", "home", "price").alias("home_price"), one("m.prices", "designation", "away", "price").alias("away_price"),
    )


def daily_views(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """``keep``, day, views of a JSON answer ``{"items": [{"timestamp": "yyyymmddhh", "views": n}]}``."""
    i = df.select(*keep, F.explode(F.from_json(F.col(payload), "struct<items:array<struct<timestamp:string,views:bigint>>>")["items"]).alias("i"))
    return i.select(*keep, P.any_date(F.substring("i.timestamp", 1, 8)).alias("day"), "i.views")


#: What a sentence tells of, by kind: any of several sets of patterns, all of which it has to hold.
TRIGGERS = {
    "missed": [[r"\bmiss\w* (the )?weight\b"], [r"\bfail\w* to make (the )?weight\b"], [r"\bweigh\w*( in)? at [0-9]", r"\b(over|above|exceed\w*|miss\w*|heavier)\b"]],
    "replaced": [[r"\breplace(d by|ment)\b"], [r"\bst[eo]p\w* in\b"], [r"\bshort[ -]notice\b"], [r"\btook the (fight|bout)\b"]],
}


def background(df: DataFrame, wikitext: str, keep: list[str], triggers: dict[str, list[list[str]]] = TRIGGERS, until: str = "Results") -> DataFrame:
    """``keep``, position and sentence of each sentence of an article up to the heading ``until``, and a flag for each kind of ``triggers``."""
    before = F.get(F.split(P.strip_markup(wikitext), rf"={{2,}}[ ]*{until}[ ]*={{2,}}", 2), 0)
    shown = P.collapse(F.regexp_replace(before, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1"))
    # a sentence goes on behind a full stop that no capital follows
    found = F.regexp_extract_all(shown, F.lit(r"[^ .!?][^.!?]*(?:[.!?]+(?! [A-Z])[^.!?]*)*[.!?]*|[.!?]+"), F.lit(0))
    s = df.select(*keep, F.posexplode(F.transform(found, F.trim)).alias("position", "sentence"))
    tells = lambda sets: reduce(or_, (reduce(and_, (F.col("sentence").rlike("(?i)" + p) for p in all_of)) for all_of in sets))
    return s.select("*", *(tells(sets).alias(kind) for kind, sets in triggers.items()))


def article_head(wikitext: Column | str) -> dict[str, Column]:
    """Where an article redirects to (null: nowhere) and the date in its infobox, as a template of numbers or in words."""
    t = wikitext if isinstance(wikitext, Column) else F.col(wikitext)
    field = F.regexp_extract(t, r"(?m)^\s*\|\s*date\s*=(.*)$", 1)
    numbers = F.transform(F.slice(F.regexp_extract_all(field, F.lit("[|]([0-9]+)"), F.lit(1)), 1, 3), lambda x: x.cast("int"))
    target = F.trim(F.regexp_extract(t, r"(?i)^\s*#redirect\W*\[\[([^\]|#]+)", 1))
    return {"redirect": F.when(target != "", target), "date": F.when(F.size(numbers) == 3, F.try_make_timestamp(*(F.get(numbers, i) for i in range(3)), F.lit(0), F.lit(0), F.lit(0)).cast("date")).otherwise(P.any_date(F.trim(P.strip_markup(P.html_text(field)))))}


def attributed(sentence: Column, trigger: str, name: Column, other: Column, reach: int = 60) -> Column:
    """Whether ``name`` stands within ``reach`` characters of a match of ``trigger``, and closer than ``other``. The first match counts."""
    at = F.regexp_instr(sentence, F.lit(trigger))
    gap = lambda n: F.when(F.instr(sentence, n) > 0, F.abs(F.instr(sentence, n) - at))
    mine, theirs = gap(name), gap(other)
    return F.coalesce((at > 0) & (mine <= reach) & (theirs.isNull() | (mine < theirs)), F.lit(False))
