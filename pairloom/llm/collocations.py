"""Phrase collocations by language: which words stand together more often than their parts would by chance.

Texts (null: empty) are lower-cased in A-Z and split at ``[.,;:!?]`` and line breaks (``[\\x0A-\\x0D]``) into pieces, and those into words
(anything but blanks and tabs). Everything is counted for each language (null: ``und``): n, all occurrences of words, and f(phrase), all
occurrences of up to ``max_n`` words in a row within pieces. Candidates are phrases of two words or more with ``a = f(phrase)`` of
``least`` or more. A cut after the first k words has the score ``1000 * a * n / (f(first part) * f(rest))``, rounded down, in decimals of
38 digits; the lowest one counts, of equal ones the first. A candidate is dropped if a one-word extension is as frequent
(``100 * f(longer) >= keep * a``): a phrase that holds another one is no more frequent than those between them, so that longer extensions
drop nothing else. Of each language the ``top`` best stay, by score, then a, both falling, then the phrase in order of its bytes.

All n-grams are exploded into rows and summed by hash aggregation, with one prune that loses nothing: a phrase is as frequent as the
rarest pair of words in it at most. So pairs are counted first, by a hash of two bytes more than it takes to number all words, and
phrases are exploded from each word on as far as the hashes of all their pairs are frequent; then they are counted as they are, so that a
hash that several pairs share lets some more rows through and changes nothing. The frequent hashes are broadcast if they are
``BROADCAST_ROWS`` at most, which is counted first; beyond that, the first bits of each are broadcast, as a map of ``2**MAP_BITS`` bits
whatever their number: it lets some more rows through, and no row is shuffled before it is counted. Sums combine
before the shuffle, so that a phrase that holds a third of all rows is one row of each task. Ranks are taken in two steps, by a hash of
the phrase and then of what is left, so that no task ranks all candidates of a language.

Repeated rows and null ids count as rows of their own; no other column is read, whatever its name; a very long text is cut into pieces
in its task; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import column, materialized, release, table

MAX_N, LEAST, KEEP, TOP = 5, 100, 100, 2000
#: Hashes (numbers) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Bits of the map of hashes (32 MB), and of a row of it.
MAP_BITS, ROW_BITS = 28, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece (its words, a blank between them) and n (how many) of each piece with a word, as a written table."""
    rows = df.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(column(text), r"[.,;:!?\x0A-\x0D]+")).alias("p"))
    # most pieces have no capital letter; translate is slow
    small = F.when(F.lower("p") == F.col("p"), F.col("p")).otherwise(F.translate("p", UPPER, LOWER))
    rows = rows.select("lang", F.trim(F.regexp_replace(small, r"[\x20\x09]+", " ")).alias("piece")).filter("piece <> ''")
    return materialized(rows.select("lang", "piece", (F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1).alias("n")))


def _counted(rows: DataFrame, words: Column, least: int) -> DataFrame:
    """lang, phrase, m (its words) and f of the phrases that occur ``least`` times, as a written table."""
    f = rows.groupBy("lang", "phrase").agg(F.count("*").alias("f")).filter(F.col("f") >= least)
    return materialized(f.select("lang", "phrase", words.cast("int").alias("m"), "f"))


def _hot_pairs(parts: DataFrame, bits: int, least: int) -> DataFrame:
    """pair: hashes of two neighbouring words that occur ``least`` times, as a written table."""
    rows = parts.filter("n > 1").select("lang", F.split("piece", " ").alias("w"))
    keys = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: _pair(F.get("w", i), F.get("w", i + 1), bits))
    return materialized(rows.select(F.explode(keys).alias("pair")).groupBy("pair").agg(F.count("*").alias("f")).filter(F.col("f") >= least).select("pair"))


def _pair(x: Column, y: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("lang", x, y), 64 - bits)


def _bit_map(hot: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """block, words: a map in which the first bits of each hash are set, as a written table; and how many bits those are."""
    width = min(bits, MAP_BITS)

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["at"].to_numpy(np.int64).astype(np.uint64)
        words = np.zeros(1 << ROW_BITS - 6, np.uint64)
        np.bitwise_or.at(words, (at >> np.uint64(6)) & np.uint64(len(words) - 1), np.uint64(1) << (at & np.uint64(63)))
        return pd.DataFrame({"block": [int(at[0]) >> ROW_BITS], "words": [words.view(np.int64)]})

    at = hot.select(F.shiftrightunsigned("pair", bits - width).alias("at")).distinct()
    return materialized(at.groupBy(F.shiftright("at", ROW_BITS).alias("b")).applyInPandas(block, "block long, words array<long>")), width


def frequent(parts: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, phrase, m, f of all phrases of up to ``max_n`` words that occur ``least`` times, from :func:`pieces`; a written table."""
    ws = F.split("piece", " ")
    words = _counted(parts.select("lang", F.explode(ws).alias("phrase")), F.lit(1), least)
    if max_n < 2:
        return words
    bits = min(64, 16 + int(parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).bit_length())
    hot = _hot_pairs(parts, bits, least)
    small = hot.count() <= BROADCAST_ROWS
    bit_map, width = (None, bits) if small else _bit_map(hot, bits)
    grams = parts.filter("n > 1").select("lang", ws.alias("w"))
    grams = grams.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, F.lit(max_n)))).alias("g"))
    for k in range(max_n - 1):
        x, y = F.get("g", F.lit(k)), F.get("g", F.lit(k + 1))
        grams = grams.withColumn(f"p{k}", F.when(y.isNotNull(), _pair(x, y, bits)))
        if small:
            keys = hot.select(F.col("pair").alias(f"p{k}"), *([F.lit(True).alias(f"in{k}")] if k else []))
            grams = grams.join(F.broadcast(keys), f"p{k}", "left" if k else "left_semi")
            continue
        grams = grams.withColumn(f"p{k}", F.shiftrightunsigned(f"p{k}", bits - width))
        rows = F.broadcast(bit_map.select(F.col("block").alias(f"b{k}"), F.col("words").alias(f"w{k}")))
        grams = grams.join(rows, F.shiftright(f"p{k}", ROW_BITS) == F.col(f"b{k}"), "left" if k else "inner")
        isin = F.expr(f"coalesce((shiftrightunsigned(get(w{k}, cast(shiftright(p{k}, 6) & {(1 << ROW_BITS - 6) - 1} AS int)), cast(p{k} & 63 AS int)) & 1) = 1, false)")
        grams = (grams.withColumn(f"in{k}", isin) if k else grams.filter(isin)).drop(f"b{k}", f"w{k}", f"p{k}")
    # words from the first one on, as far as all pairs are frequent
    reach = F.lit(max_n)
    for k in reversed(range(1, max_n - 1)):
        reach = F.when(F.col(f"in{k}"), reach).otherwise(F.lit(k + 1))
    phrases = F.transform(F.sequence(F.lit(2), reach), lambda m: F.array_join(F.slice("g", 1, m), " "))
    found = _counted(grams.select("lang", F.explode(phrases).alias("phrase")), F.size(F.split("phrase", " ")), least)
    release(hot, *([] if small else [bit_map]))
    return _united(words, found)


def _united(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialized(out)
    release(*parts)
    return out


def _cuts(freq: DataFrame) -> DataFrame:
    """lang, phrase, a, k, l, r: each candidate cut after its first k words, with the counts of both parts."""
    w = F.split("phrase", " ")
    cut = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("first"), F.array_join(F.slice(w, k + 1, F.col("m")), " ").alias("rest")))
    rows = freq.filter("m > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    of = lambda part, out: freq.select("lang", F.col("phrase").alias(part), F.col("f").alias(out))
    return rows.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])


def _extended(freq: DataFrame) -> DataFrame:
    """lang, phrase, top: the greatest count of a one-word extension."""
    w = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(w, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("m") - 1), " "))
    return freq.filter("m > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("top"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, keep: int = KEEP, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    parts = pieces(df, text, lang)
    total = materialized(parts.groupBy("lang").agg(F.sum("n").cast("long").alias("n")))
    freq = frequent(parts, max_n, least)
    release(parts)
    few = total.select(F.count("*") <= 10_000).first()[0]
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = _cuts(freq).join(F.broadcast(total) if few else total, "lang")
    cuts = cuts.select("*", (F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).alias("up"), (big("l") * big("r")).alias("down"))
    lowest = cuts.select("lang", "phrase", "a", "n", F.struct(F.expr("up div down").cast("long").alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c"))
    gone = _extended(freq).withColumnRenamed("top", "longer")
    left = lowest.join(gone, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < keep * F.col("a")))
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts_of = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = left.select("*", F.pmod(F.xxhash64("phrase"), F.lit(parts_of)).alias("part"))
    some = some.select("*", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)).alias("rank")).filter(F.col("rank") <= top).drop("part", "rank")
    ranked = some.select("lang", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked.filter(F.col("rank") <= top)


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) AS u(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM c, range(1, 5) AS u(k), f AS l, f AS r, n WHERE k < c.m AND l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ') AND n.lang = c.lang),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a)),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM e)
SELECT * FROM r WHERE rank <= 2000"""
