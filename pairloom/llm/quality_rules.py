"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts of a text (null: no words): ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a
word that equal an earlier line), ``n_repeat_words`` (words inside a three-word window that the text holds twice or more) and
``n_stop_words``. ``base_failed`` marks texts under 50 words or with over half of their words in repeated windows; ``kept`` is false
for those and for texts that break a row of ``RULES``; both bounds of a rule are inclusive, so that ties pass. Empty tables give empty
results; repeated rows are judged one by one; other columns of the input are left alone, whatever their names, as they travel in one
struct. Very long texts are counted whole, with one row's arrays in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, named, sql_list, words

MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of the four languages; a fixed list.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this at from or an have not which were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un une du dans que qui pour par sur est au pas plus avec ce il elle".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero es".split(),
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws})

#: (name, SQL ratio over the counts, least allowed, most allowed); a null bound is open.
RULES = [
    ("mean word length", "word_chars / n_words", 2.0, 15.0),
    ("symbols per word", "n_symbols / n_words", None, 0.10),
    ("stop words per word", "n_stop_words / n_words", 0.02, None),
    ("repeated lines per line", "n_dup_lines / n_lines", None, 0.30),
    ("words per line, blank ones included", "n_words / n_all_lines", 1.0, None),
]


def verdict_sql(prefix: str = "") -> str:
    """The rules as one SQL predicate over the counts in ``prefix``; both bounds are inclusive."""
    parts = []
    for _, ratio, low, high in RULES:
        top, bottom = ratio.split(" / ")
        value = f"(CAST({prefix}{top} AS DOUBLE) / CAST({prefix}{bottom} AS DOUBLE))"
        if low is not None:
            parts.append(f"{value} >= CAST({low} AS DOUBLE)")
        if high is not None:
            parts.append(f"{value} <= CAST({high} AS DOUBLE)")
    return " AND ".join(parts)


def _repeat_words(w: Column, grams: Column) -> Column:
    """Words covered by a window found twice or more: equal windows are neighbours once sorted with their starts."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(sorted_: Column) -> Column:
        twin = lambda p, k: F.coalesce(F.get(sorted_, k - 1)["g"] == p["g"], F.lit(False)) | F.coalesce(F.get(sorted_, k + 1)["g"] == p["g"], F.lit(False))
        return F.filter(F.transform(sorted_, lambda p, k: F.when(twin(p, k), p["i"])), lambda i: i.isNotNull())

    # a one-element transform binds the sorted array once, so that the lambda doesn't sort again for each element
    found = F.transform(F.array(placed), starts)[0]
    return F.transform(F.array(found), lambda s: F.size(F.array_distinct(F.concat(s, F.transform(s, lambda i: i + 1), F.transform(s, lambda i: i + 2)))))[0]


def with_quality(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``df`` plus one struct column ``out`` with the counts and verdicts; an ``out`` that ``df`` has already is refused."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {out}")
    t = F.coalesce(column(text), F.lit(""))
    # the columns of ``df`` travel in one struct, so that no name of theirs meets one of ours
    a = df.select(F.struct(*map(column, df.columns)).alias("__row"), words(column(text)).alias("__w"), t.alias("__t"))
    n = F.size("__w")
    a = a.select(
        "*",
        F.when(n >= 3, F.transform(F.slice("__w", F.lit(1), n - 2), lambda x, i: F.concat_ws(" ", x, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2)))).alias("__g"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    g = F.col("__g")
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("__t"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(g.isNull() | (F.size(F.array_distinct(g)) == F.size(g)), F.lit(0)).otherwise(_repeat_words(F.col("__w"), g)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__w", lambda x: F.lower(x).isin(ALL_STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.split("__t", "\n")).cast("long").alias("n_all_lines"),
    )
    # explode of one element: a later filter on the counts then can't be inlined into the heavy expressions
    a = a.select("__row", F.explode(F.array(counts)).alias("__c"))
    failed = (F.col("__c.n_words") < MIN_WORDS) | (100 * F.col("__c.n_repeat_words") > 50 * F.col("__c.n_words"))
    rules = F.expr(verdict_sql("__c."))
    back = [F.col("__row").getField(c).alias(c) for c in df.columns]
    return a.select(*back, F.struct("__c.*", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(rules).alias("kept")).alias(out))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g JOIN r USING (doc_id, g), (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({sql_list(ALL_STOP_WORDS)}))) AS n_stop_words, len(ls) AS n_lines,
             len(string_split(t, chr(10))) AS n_all_lines FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {verdict_sql()} END AS kept FROM f
"""


def op3(spark, sf_dir: str) -> DataFrame:
    from pairloom.llm.common import table

    q = with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with their columns unchanged."""
    (out,) = named(docs, "quality")
    return with_quality(docs, out=out).filter(column(out)["kept"]).drop(out)
