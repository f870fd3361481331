"""Line dedup over content-defined chunks of lines.

A text (null: empty) splits into lines at ``\\n``. Each line is hashed; a rolling hash over two neighbouring line hashes marks a line
as a cut candidate, and a candidate whose predecessor is none ends a chunk. Cuts depend on three lines only, so that an insertion
elsewhere leaves them in place, and inner chunks hold two lines at least. Chunks of two lines or more with a word that occur again
anywhere are removed, all but the first: the one in the smallest ``doc_id`` (null: after all others), and within a document the
earliest. Rows that share an id count as one owner and each keep the copy that this owner is first with. Chunks are counted by digest,
then repeated digests are compared byte for byte: a digest that stands for two different chunks is never removed. Texts without a
repeated chunk, empty texts, single lines and empty tables pass unchanged; a null text stays null. Other columns are kept, whatever
their names; a very long text is one row, whose chunks are held in memory.

A short repeat mostly holds no complete chunk. So the pipeline's stage compares every two neighbouring lines that the chunks leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import alone, column, materialized, named, owner, table

#: First hex digit of the rolling hash in this set: a cut candidate (half of all lines).
CUT_DIGITS = list("01234567")
MIN_LINES = 2


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def chunks_of(text: Column) -> Column:
    """array<struct<n_lines int, txt string>> whose texts, joined by a line break, are the text again."""

    def from_lines(lines: Column) -> Column:
        return _bind(F.transform(lines, F.md5), lambda hashes: _bind(
            F.transform(hashes, lambda h, i: F.coalesce(F.substring(F.md5(F.concat(F.get(hashes, i - 1), h)), 1, 1).isin(CUT_DIGITS), F.lit(False))),
            lambda cut: _bind(
                F.filter(F.transform(cut, lambda c, i: F.when((c & ~F.coalesce(F.get(cut, i - 1), F.lit(False))) | (i == F.size(cut) - 1), i + 1)), lambda e: e.isNotNull()),
                lambda ends: F.transform(ends, lambda e, k: _chunk(lines, F.coalesce(F.get(ends, k - 1), F.lit(0)), e)))))

    def _chunk(lines: Column, start: Column, end: Column) -> Column:
        return F.struct((end - start).alias("n_lines"), F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("txt"))

    return _bind(F.split(F.coalesce(text, F.lit("")), "\n"), from_lines)


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns by number (``c0``, ...), the text as __text, __own and __tx of each row, so that no name of a column meets one of ours."""
    t = F.coalesce(column(text), F.lit(""))
    rest = (column(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c != text)
    return df.select(*rest, owner(column(doc_id)).alias("__own"), F.xxhash64(t).alias("__tx"), column(text).alias("__text"))


def _new(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns}
    if found := [n for n in names if n.lower() in taken]:
        raise ValueError(f"the table has a column {found[0]}")


def _back(df: DataFrame, text: str) -> list[Column]:
    return [F.col("__text" if c == text else f"c{i}").alias(c) for i, c in enumerate(df.columns)]


def _candidates(rows: DataFrame) -> DataFrame:
    chunks = rows.select("__own", "__tx", F.explode(F.array(chunks_of(F.col("__text")))).alias("__chunks"))
    c = chunks.select("__own", "__tx", F.explode("__chunks").alias("c")).filter(F.col("c.n_lines") >= MIN_LINES)
    return c.filter(F.col("c.txt").rlike(r"[^\x20\x09-\x0D]")).select("__own", "__tx", F.md5("c.txt").alias("__key"), F.col("c.txt").alias("__txt"))


def _drops(rows: DataFrame) -> DataFrame:
    """__own, __tx and the digests of repeated chunks that stand in an earlier document (__later) or first in this one (__here)."""
    found = _candidates(rows)
    repeated = found.groupBy("__key").agg(F.count("*").alias("n"), F.min("__own").alias("__first")).filter("n > 1").select("__key", "__first")
    # byte comparison of all copies, with map-side combining: equal least and greatest text means one text
    same = found.join(repeated, "__key").groupBy("__key", "__first").agg(F.min("__txt").alias("lo"), F.max("__txt").alias("hi")).filter("lo = hi").select("__key", "__first")
    return (
        found.select("__own", "__tx", "__key").join(same, "__key").groupBy("__own", "__tx")
        .agg(F.collect_set(F.when(F.col("__own") > F.col("__first"), F.col("__key"))).alias("__later"), F.collect_set(F.when(F.col("__own") == F.col("__first"), F.col("__key"))).alias("__here"))
    )


def _keys() -> Column:
    """Digests of ``__chunks`` that may be removed."""
    return F.transform("__chunks", lambda c: F.when(c["n_lines"] >= MIN_LINES, F.md5(c["txt"])))


def _again(keys: Column, i: Column) -> Column:
    """Whether chunk ``i`` has come before."""
    k = F.get(keys, i)
    return F.coalesce(F.array_contains("__later", k) | (F.array_contains("__here", k) & (F.array_position(keys, k) < i + 1)), F.lit(False))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept_text", counts: str = "line_dedup") -> DataFrame:
    """``df`` plus ``out`` (the remaining text) and ``counts`` (n_lines, n_chunks, n_removed_chunks, n_removed_lines); names that ``df`` has already are refused."""
    _new(df, out, counts)
    rows = _keyed(df, doc_id, text)
    drops = _drops(rows)
    # only the whole text crosses this join; its chunks are cut anew behind it
    j = rows.join(drops, ["__own", "__tx"], "left").select("*", F.explode(F.array(chunks_of(F.col("__text")))).alias("__chunks"))
    keep = _bind(_keys(), lambda ks: F.filter("__chunks", lambda c, i: ~_again(ks, i)))
    j = j.select("*", F.explode(F.array(F.when(F.col("__later").isNull(), F.col("__chunks")).otherwise(keep))).alias("__kept"))
    lines = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["n_lines"])
    removed = F.size("__chunks") - F.size("__kept")
    return j.select(
        *_back(df, text),
        F.when(removed == 0, F.col("__text")).otherwise(F.array_join(F.col("__kept.txt"), "\n")).alias(out),
        F.struct(lines(F.col("__chunks")).cast("long").alias("n_lines"), F.size("__chunks").cast("long").alias("n_chunks"), removed.cast("long").alias("n_removed_chunks"),
                 (lines(F.col("__chunks")) - lines(F.col("__kept"))).cast("long").alias("n_removed_lines")).alias(counts),
    )


def chunk_ctes(docs: str, p: str = "") -> str:
    """DuckDB CTEs: the same chunks, judgement and remaining text for the relation ``docs``; the result is ``{p}cleaned``."""
    return f"""
{p}ld AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
{p}ll AS (SELECT doc_id, i, ls[i] AS l, md5(ls[i]) AS h, len(ls) AS n FROM {p}ld, unnest(range(1, len(ls) + 1)) AS u(i)),
{p}lc AS (SELECT *, coalesce(md5(lag(h) OVER w || h)[1] <= '7', false) AS cut FROM {p}ll WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{p}lb AS (SELECT *, (cut AND NOT coalesce(lag(cut) OVER w, false)) OR i = n AS stop FROM {p}lc WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{p}lk AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM {p}lb),
{p}ch AS (SELECT doc_id, k, string_agg(l, chr(10) ORDER BY i) AS txt, count(*) AS n_lines FROM {p}lk GROUP BY doc_id, k),
{p}rk AS (SELECT *, n_lines >= 2 AND regexp_matches(txt, '[^\\x20\\x09-\\x0D]') AS can, row_number() OVER (PARTITION BY txt ORDER BY doc_id, k) AS occ FROM {p}ch),
{p}cleaned AS (SELECT doc_id, coalesce(string_agg(txt, chr(10) ORDER BY k) FILTER (WHERE NOT (can AND occ > 1)), '') AS kept_text, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks,
  count(*) FILTER (WHERE can AND occ > 1) AS n_removed_chunks, coalesce(sum(n_lines) FILTER (WHERE can AND occ > 1), 0)::BIGINT AS n_removed_lines FROM {p}rk GROUP BY doc_id)"""


ORACLE = f"WITH {chunk_ctes('documents')} SELECT doc_id, kept_text, n_lines, n_chunks, n_removed_chunks, n_removed_lines FROM cleaned"


def op4(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "kept_text", "line_dedup.*")


def _pair(lines: Column, i: Column) -> Column:
    """Lines ``i`` and ``i + 1`` as one text."""
    return F.concat(F.get(lines, i), F.lit("\n"), F.get(lines, i + 1))


def dedup_line_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept_text", removed: str = "n_removed_lines") -> DataFrame:
    """``df`` plus ``out`` (the remaining text) and ``removed``: every repeat of two or more lines goes, wherever chunks are cut.

    Repeated chunks go first, as in :func:`dedup_lines`. What they leave is compared by neighbouring lines, judged on the input: each two
    with a word, not both in a chunk that went, count by their digest. All but the first occurrence (by id, text hash and place; null ids
    after all others) lose both lines, so that a longer passage goes as a chain of pairs. Rows with equal id and text keep the same
    lines. The first occurrence of a line is in no later pair, so that one copy of each line stays. Digests that stand for two
    different pairs are found byte for byte and never removed.
    """
    _new(df, out, removed)
    lines = F.split(F.coalesce(F.col("__text"), F.lit("")), "\n")
    rows = _keyed(df, doc_id, text)
    pair_digests = _bind(lines, lambda ls: F.transform(F.slice(ls, 1, F.size(ls) - 1), lambda _, i: _bind(_pair(ls, i), lambda t: F.when(t.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(t))))))
    place = F.struct("__own", "__tx", "__i")

    def drops(pairs: DataFrame) -> DataFrame:
        """__own, __tx and the places whose pair has come before (__later) or comes again (__here)."""
        repeated = pairs.groupBy("__key").agg(F.count("*").alias("n"), F.min(place).alias("__first")).filter("n > 1").drop("n")
        at = pairs.join(repeated.hint("merge"), "__key").groupBy("__own", "__tx")
        return materialized(at.agg(F.collect_set(F.when(place > F.col("__first"), F.col("__i"))).alias("__later"), F.collect_set(F.when(place == F.col("__first"), F.col("__i"))).alias("__here")))

    def cut() -> DataFrame:
        """__own, __tx and, for each line (__cut), whether its chunk goes."""
        j = rows.join(_drops(rows).hint("merge"), ["__own", "__tx"]).select("*", F.explode(F.array(chunks_of(F.col("__text")))).alias("__chunks"))
        flags = _bind(_keys(), lambda ks: F.flatten(F.transform("__chunks", lambda c, i: F.array_repeat(_again(ks, i), c["n_lines"]))))
        return materialized(j.select("__own", "__tx", flags.alias("__cut")).filter(F.array_contains("__cut", True)).dropDuplicates(["__own", "__tx"]))

    chunks = alone(cut)
    rows = rows.join(chunks.hint("merge"), ["__own", "__tx"], "left")
    went = lambda i: F.coalesce(F.get("__cut", i), F.lit(False))

    def decided() -> DataFrame:
        pairs = rows.select("__own", "__tx", "__cut", F.posexplode(pair_digests).alias("__i", "__key"))
        pairs = materialized(pairs.filter(F.col("__key").isNotNull() & ~(went(F.col("__i")) & went(F.col("__i") + 1))).drop("__cut"))
        at = drops(pairs)
        copies = rows.join(at.hint("merge"), ["__own", "__tx"]).select(F.explode(_bind(lines, lambda ls: F.transform(F.array_union("__later", "__here"), lambda i: _pair(ls, i)))).alias("t"))
        mixed = materialized(copies.groupBy(F.unhex(F.md5("t")).alias("__key")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select("__key"))
        return at if mixed.isEmpty() else drops(pairs.join(mixed, "__key", "left_anti"))

    m = rows.join(alone(decided).hint("merge"), ["__own", "__tx"], "left")
    later = F.coalesce("__later", F.array().cast("array<int>"))
    in_chunks = F.when(F.col("__cut").isNull(), F.array().cast("array<int>")).otherwise(F.filter(F.transform("__cut", lambda c, i: F.when(c, i)), lambda i: i.isNotNull()))
    gone = F.array_union(F.array_union(later, F.transform(later, lambda i: i + 1)), in_chunks)
    keep = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i))
    changed = (F.size(later) > 0) | F.col("__cut").isNotNull()
    n = F.when(changed, F.size(gone)).otherwise(0).cast("long")
    return m.select(*_back(df, text), F.when(changed, F.array_join(_bind(lines, keep), "\n")).otherwise(F.col("__text")).alias(out), n.alias(removed))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with repeats of two or more lines cut out of ``text`` and ``n_chars`` counted anew where that happened."""
    kept, removed = named(docs, "kept", "removed")
    d = dedup_line_pairs(docs, out=kept, removed=removed)
    changed = F.col(removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return d.select(*(new[c].alias(c) if c in new else column(c) for c in docs.columns))
