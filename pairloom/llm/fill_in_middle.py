"""Fill-in-middle transformation over run-length classes of characters.

A text (null: empty) is stored as its maximal runs of characters of one class, a run as its first character and length, with the number
of units that end up to each run. Units are lines (the default; class: line breaks, each of which ends a line), words (class: anything
but ASCII white space, each run of which ends a word) or characters (one class). What follows the last end is one more unit. A cut after
so many units is found by binary search over the cumulative counts for the run that holds it, and its character by arithmetic inside
the run, so that units are never listed one by one. Cumulative sums are taken in blocks, and blocks of blocks, so that a text of many
lines costs little more for each line than a short one.

Both cuts and the form come from the sha256 of ``seed:doc_id`` alone: the first four 8-digit groups are h1 to h4. The prefix ends after
the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger one. The form is plain for empty texts, for texts
that hold a sentinel and if ``h3 % 100`` is not below ``rate``; else it is spm if ``h4 % 100`` is below ``spm``, else psm. A sentinel can't
arise where parts meet, as it begins with ``<`` and holds no other, so that splitting at sentinels gives the parts back.

Each row is judged by itself: no shuffle, no hot groups. A null id counts as an empty string; rows with equal ids have the same draws
(and the same cuts where they have as many units); a very long text is one row, held in memory with its runs; empty tables give empty
results. Other columns are kept, whatever their names; a column named as ``out`` is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, table

#: Kind of unit -> class of characters, all other characters, and whether each character (or else each run) of the class ends a unit.
UNITS = {"line": (r"[\n]", r"[^\n]", True), "word": (r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]", False), "char": (r"[\s\S]", None, True)}
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
#: Elements that a cumulative sum folds at a time, and levels of such blocks.
BLOCK, LEVELS = 128, 3


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def cumulative(numbers: Column, levels: int = LEVELS) -> Column:
    """Running sums of an array<long>, the first element's own included."""
    zero = F.lit(0).cast("long")

    def fold(part: Column, start: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), 2, F.size(part))

    def in_blocks(xs: Column) -> Column:
        part = lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), zero, lambda a, x: a + x))
        return _bind(cumulative(sums, levels - 1), lambda total: F.flatten(F.transform(blocks, lambda b: fold(part(b), F.coalesce(F.get(total, b - 1), zero)))))

    if levels == 1:
        return fold(numbers, zero)
    return _bind(numbers, lambda xs: F.when(F.size(xs) <= BLOCK, fold(xs, zero)).otherwise(in_blocks(xs)))


def classed_runs(text: Column, unit: str) -> Column:
    """struct<chars, ends>: for each run the characters and the units up to its end."""
    inside, rest, each = UNITS[unit]

    def of_runs(parts: Column) -> Column:
        size = F.transform(parts, lambda p: F.length(p).cast("long"))
        ended = lambda p, i: F.when(F.rlike(F.substring(p, 1, 1), F.lit(inside)), F.length(p) if each else F.lit(1)).when(i == F.size(parts) - 1, 1).otherwise(0)
        return F.struct(cumulative(size).alias("chars"), cumulative(F.transform(parts, lambda p, i: ended(p, i).cast("long"))).alias("ends"))

    return _bind(F.regexp_extract_all(text, F.lit(f"{inside}+" + (f"|{rest}+" if rest else "")), F.lit(0)), of_runs)


def cut_at(runs: Column, units: Column) -> Column:
    """Characters before the end of the first ``units`` units: the run by binary search, the place in it by arithmetic."""
    last = lambda xs, k: F.coalesce(F.get(xs, k - 1), F.lit(0).cast("long"))
    ends, chars = runs["ends"], runs["chars"]

    def halve(x: Column, _: Column) -> Column:
        mid = F.shiftright(x["lo"] + x["hi"], 1)
        here = F.get(ends, mid) >= units
        return F.struct(F.when(here, x["lo"]).otherwise(mid + 1).alias("lo"), F.when(here, mid).otherwise(x["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ends)))), F.struct(F.lit(0).alias("lo"), (F.size(ends) - 1).alias("hi")), halve)["lo"]

    def inside(k: Column) -> Column:
        many, wide = F.get(ends, k) - last(ends, k), F.get(chars, k) - last(chars, k)
        return F.when(many == wide, last(chars, k) + units - last(ends, k)).otherwise(F.get(chars, k))

    return F.when(units == 0, F.lit(0).cast("long")).otherwise(_bind(found, inside))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from what was made of it and the form alone."""
    parts = F.split(output, "|".join("\\Q" + s + "\\E" for s in sentinels))
    back = lambda prefix, middle, suffix: F.concat(*(F.get(parts, F.lit(i)) for i in (prefix, middle, suffix)))
    return F.when(form == "psm", back(1, 3, 2)).when(form == "spm", back(2, 3, 1)).otherwise(output)


def with_middles(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "fim", unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` plus ``out``: n_units, form, prefix_chars and middle_chars (null: plain) and output (the text in its form).

    A sentinel begins with a character that it holds once only and that no other one holds elsewhere; others are refused.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out}")
    if any(not s or any(s[0] in t[1:] for t in sentinels) for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("texts can't be told from these sentinels")
    t = F.coalesce(F.col("text"), F.lit(""))
    group = lambda i: F.conv(F.substring(F.col("draw"), 8 * i + 1, 8), 16, 10).cast("long")
    holds = lambda s: F.contains(t, F.lit(s))
    rows = df.select(F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(df.columns))).alias("row"), column(doc_id).cast("long").alias("id"), column(text).alias("text"))
    rows = rows.select("row", t.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("draw"), classed_runs(t, unit).alias("runs"))
    n = F.coalesce(F.get("runs.ends", F.size("runs.ends") - 1), F.lit(0).cast("long"))
    plain = (F.col("text") == "") | holds(sentinels[0]) | holds(sentinels[1]) | holds(sentinels[2]) | (group(2) % 100 >= rate)
    rows = rows.select("row", "text", "runs", n.alias("n"), F.when(plain, "plain").when(group(3) % 100 < spm, "spm").otherwise("psm").alias("form"), (group(0) % (n + 1)).alias("x"), (group(1) % (n + 1)).alias("y"))
    cut = lambda f: F.when(F.col("form") != "plain", cut_at(F.col("runs"), f("x", "y")))
    rows = rows.select("row", "text", "n", "form", cut(F.least).alias("a"), cut(F.greatest).alias("b"))
    prefix, middle, suffix = F.substr("text", F.lit(1), F.col("a").cast("int")), F.substr("text", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), F.substr("text", (F.col("b") + 1).cast("int"))
    p, s, m = map(F.lit, sentinels)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    fim = F.struct(F.col("n").alias("n_units"), "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))
    return rows.select("row", fim.alias("fim")).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)), F.col("fim").alias(out))


def op12(spark, sf_dir: str) -> DataFrame:
    f = with_middles(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c, 256)
    return f.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(ls) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
