"""Raw text to typed columns. What doesn't parse is null, never an error; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["any_date", "clock_seconds", "collapse", "country_of", "day_of_epoch_ms", "elapsed_seconds", "height_inches", "html_text", "inches", "judge_margin", "last_part", "longest_named",
           "number_pair", "round_lengths", "signed_int", "slug", "strip_markup", "utc_offset_hours", "vs_names", "wiki_links"]

#: Day formats that sources use, in order of trial; fixed values.
DATE_FORMATS = [r"MMMM d, yyyy", r"MMM d, yyyy", r"MMM/d/yyyy", r"MMM d yyyy", r"MMMM d yyyy", r"yyyy-MM-dd", r"yyyyMMdd"]
#: Latin letters with marks and the plain letters that they decompose to.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĪīİŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgIiILlNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def last_part(c: Column | str, separator: str = "/") -> Column:
    return F.substring_index(text(c), separator, -1)


def vs_names(c: Column | str) -> Column:
    """array of the two names of ``a vs. b``; a second `` vs. `` belongs to b."""
    return F.transform(F.split(collapse(c), r" vs\. ", 2), lambda x: F.trim(x))


def clock_seconds(c: Column | str) -> Column:
    """``m:ss`` as seconds."""
    x = F.split(F.trim(text(c)), ":")
    return F.when(text(c).rlike(r"^\s*\d+:\d{1,2}\s*$"), F.get(x, 0).try_cast("int") * 60 + F.get(x, 1).try_cast("int"))


def round_lengths(c: Column | str) -> Column:
    """array of the round lengths in minutes that a format as ``3 Rnd (5-5-5)`` names; empty without them."""
    inner = found(text(c), r"\(([\d-]+)\)")
    return F.coalesce(F.transform(F.split(inner, "-"), lambda x: x.try_cast("int")), F.array().cast("array<int>"))


def elapsed_seconds(lengths: Column, end_round: Column, end_seconds: Column) -> Column:
    """Seconds from the beginning to the end in a round: all rounds before it at their lengths, and the time in it. Outside the known rounds the time alone."""
    before = F.aggregate(F.slice(lengths, F.lit(1), F.greatest(end_round - 1, F.lit(0))), F.lit(0), lambda a, x: a + x * 60)
    return F.when((end_round >= 1) & (end_round <= F.size(lengths)), before + end_seconds).otherwise(end_seconds)


def inches(c: Column | str) -> Column:
    """``72"`` or ``72.5`` as a number."""
    return found(text(c), r'^\s*(\d+(?:\.\d+)?)\s*"?\s*$').try_cast("double")


def height_inches(c: Column | str) -> Column:
    """``6' 2"`` or ``6 ft 2 in`` as inches."""
    pattern = r"^\s*(\d+)\s*(?:'|ft)\s*(\d+(?:\.\d+)?)?\s*(?:\"|in|'')?\s*$"
    feet, rest = found(text(c), pattern, 1).try_cast("double"), found(text(c), pattern, 2).try_cast("double")
    return feet * 12 + F.coalesce(rest, F.lit(0.0))


def number_pair(c: Column | str) -> Column:
    """``x of y`` as a struct of landed and attempted."""
    pattern = r"^\s*(\d+)\s+of\s+(\d+)\s*$"
    return F.struct(found(text(c), pattern, 1).try_cast("double").alias("landed"), found(text(c), pattern, 2).try_cast("double").alias("attempted"))


def signed_int(c: Column | str) -> Column:
    """An integer with ASCII or Unicode signs."""
    return F.translate(F.trim(text(c)), "−–＋", "--+").try_cast("int")


def any_date(c: Column | str) -> Column:
    """A day in any of ``DATE_FORMATS``; ordinal endings, as in 1st, are dropped."""
    x = collapse(F.regexp_replace(text(c), r"(?<=\d)(st|nd|rd|th)\b", ""))
    iso = found(x, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])")
    digits = F.when(x.rlike(r"^\d{8}$"), x)
    named = F.when(~x.rlike(r"^\d"), x)
    tries = [F.try_to_date(named, f) for f in DATE_FORMATS[:5]] + [F.try_to_date(iso, DATE_FORMATS[5]), F.try_to_date(digits, DATE_FORMATS[6])]
    return F.coalesce(*tries)


def day_of_epoch_ms(c: Column) -> Column:
    """The UTC day of milliseconds since 1970."""
    return F.to_date(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86_400_000).cast("int")))


def utc_offset_hours(day: Column, zone: Column | str) -> Column:
    """Hours that noon of a day in an IANA zone lies ahead of UTC; null for unknown days or zones left null."""
    noon = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")).cast("timestamp_ntz")
    z = zone if isinstance(zone, Column) else F.lit(zone)
    utc = F.convert_timezone(z, F.lit("UTC"), noon)
    return (F.unix_micros(F.to_utc_timestamp(noon.cast("timestamp"), "UTC")) - F.unix_micros(F.to_utc_timestamp(utc.cast("timestamp"), "UTC"))) / 3_600_000_000


def judge_margin(c: Column | str) -> Column:
    """Mean of b - a over all cards ``a - b`` in a text; null without one."""
    pairs = lambda g: F.transform(F.regexp_extract_all(text(c), F.lit(r"(\d+) - (\d+)"), F.lit(g)), lambda x: x.cast("double"))
    gaps = F.zip_with(pairs(1), pairs(2), lambda a, b: b - a)
    return F.when(F.size(gaps) > 0, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps))


def longest_named(c: Column | str, values: dict[str, float | int]) -> Column:
    """The value of the longest key that a text contains, whatever its case; null if there is none."""
    out = None
    for k in sorted(values, key=lambda k: (-len(k), k)):
        hit = F.contains(F.lower(text(c)), F.lit(k.lower()))
        out = F.when(hit, F.lit(values[k])) if out is None else out.when(hit, F.lit(values[k]))
    return out


def slug(c: Column | str) -> Column:
    """Lower-case ASCII words joined by ``-``; Latin letters lose their marks, whatever else is no letter or digit ends a word."""
    plain = F.lower(F.translate(text(c), MARKED, PLAIN))
    plain = F.regexp_replace(plain, r"[̀-ͯ'’]", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def country_of(c: Column | str) -> Column:
    return F.trim(F.element_at(F.split(text(c), ","), -1))


#: Named and numbered characters of HTML that texts hold; fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}


def html_text(c: Column | str) -> Column:
    """Without tags, and with the usual entities resolved; white space collapsed."""
    x = F.regexp_replace(text(c), "<[^>]*>", "")
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    return collapse(x)


def strip_markup(c: Column | str) -> Column:
    """Wikitext without footnotes and templates, however deep these lie in one another. A template that is never closed stays.

    The text is read as braces and what lies between them; a fold counts how many templates are open, and holds back what came since the
    outermost one until that is closed, and goes.
    """
    noted = F.regexp_replace(text(c), r"(?is)<ref\b[^>/]*(?:/(?!>)[^>/]*)*(?:/>|>.*?</ref\s*>)", "")
    tokens = F.regexp_extract_all(noted, F.lit(r"(?s)[{]{2}|[}]{2}|(?:(?![{]{2}|[}]{2}).)+"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("deep"), none.alias("kept"), none.alias("held"))

    def read(s: Column, token: Column) -> Column:
        deep = s["deep"] + F.when(token == "{{", 1).when((token == "}}") & (s["deep"] > 0), -1).otherwise(0)
        outside = (s["deep"] == 0) & (deep == 0)
        return F.struct(deep.alias("deep"), F.when(outside, F.array_append(s["kept"], token)).otherwise(s["kept"]).alias("kept"), F.when(deep > 0, F.array_append(s["held"], token)).otherwise(none).alias("held"))

    return F.aggregate(tokens, start, read, lambda s: F.array_join(F.concat(s["kept"], s["held"]), ""))


def wiki_links(c: Column | str) -> Column:
    """array of the shown names of ``[[target|name]]`` links."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.element_at(F.split(x, r"\|"), -1)))
