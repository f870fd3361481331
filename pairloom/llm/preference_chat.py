"""Preference formatting of chosen and rejected conversations, without user functions.

A conversation is an array of turns (role, text), in order of ``turn``, then role and text; repeated rows stay as repeated turns, nulls
in role or text count as empty, and rows without conversation id or turn belong to no conversation. The longest common prefix of turns
(equal role and text) is rendered once as prompt; what follows on either side is rendered as its completion. ``*_mask`` lists the
half-open character ranges ``from-to`` of a completion that are learned from: the texts of assistant turns with their end marks.
Marks that occur in a text are broken up, so that text can't open a turn. Equal conversations give empty completions, an empty side
an empty prompt; conversations are joined by id only, so that a common first turn gathers nothing in one task. Ids may be of any type;
other columns are kept, whatever their names; empty tables give empty results; a conversation is one row, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import column, named, table

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, one row for each conversation."""
    value = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    rows = df.filter(column(conv_id).isNotNull() & column(turn).isNotNull()).select(column(conv_id).alias("conv_id"), F.struct(column(turn).alias("turn"), value(role).alias("role"), value(text).alias("text")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(CLOSE + "\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit("\n" + END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """The ranges of assistant texts, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

    def step(a: Column, t: Column) -> Column:
        first = a["at"] + F.length(_head(t))
        end = first + F.length(_body(t))
        span = F.concat_ws("-", first.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    return F.array_join(F.aggregate(turns, start, step)["found"], ",")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the longest common prefix has."""
    least = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: (x["role"] != y["role"]) | (x["text"] != y["text"]))
    at = F.array_position(differs, True)
    return F.when(at == 0, least).otherwise(at - 1).cast("int")


def formatted(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected", out: str = "pair") -> DataFrame:
    """``df`` plus a struct ``out``: prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. Null sides count as empty; an ``out`` that ``df`` has already is refused."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {out}")
    empty = F.array().cast(TURNS)
    side = lambda c: F.coalesce(column(c), empty)
    (own,) = named(df, "sides")
    a = df.select("*", F.explode(F.array(F.struct(side(chosen).alias("a"), side(rejected).alias("b"), common_turns(side(chosen), side(rejected)).alias("n")))).alias(own))
    p = column(own)
    rest = lambda c: F.slice(p[c], p["n"] + 1, F.size(p[c]))
    return a.select(
        *map(column, df.columns),
        F.struct(
            p["n"].cast("long").alias("prompt_turns"),
            rendered(F.slice(p["a"], F.lit(1), p["n"])).alias("prompt"),
            rendered(rest("a")).alias("chosen"),
            rendered(rest("b")).alias("rejected"),
            mask(rest("a")).alias("chosen_mask"),
            mask(rest("b")).alias("rejected_mask"),
        ).alias(out),
    )


#: Conversations are put in groups of about this size, by the first digits of the digest of their id; in a group each one's donor is the next.
GROUP = 1000
DIGITS = range(12)


def donors(ids: DataFrame) -> DataFrame:
    """conv_id, other: for each conversation the next one of its group by id, for the last one the first (itself if it is alone).

    The number of digits follows the number of conversations, so that groups stay small and no window holds all rows.
    """
    n = ids.count()
    digits = sum(n > GROUP * 16**k for k in DIGITS)
    group = F.substring(F.md5(F.col("conv_id").cast("string")), 1, digits)
    w = Window.partitionBy("g").orderBy("conv_id")
    return ids.select("conv_id", group.alias("g")).select("conv_id", F.coalesce(F.lead("conv_id").over(w), F.first("conv_id").over(w)).alias("other"))


def replies(turns: Column) -> Column:
    """Where the assistant's turns stand, from 1."""
    return F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())


def sampled_pairs(convs: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: each conversation up to its last assistant turn, against itself with another ending.

    The ending begins at one of the assistant's turns, chosen by the digest of the id, and is the donor's: from its reply of the same
    number (its last one, if it has fewer) to its last one. Without a reply of its own a conversation is not changed; a donor without
    one gives an empty ending.
    """
    cut = convs.select("conv_id", "turns", F.explode(F.array(replies(F.col("turns")))).alias("at"))
    own = cut.select("conv_id", "turns", "at", (F.pmod(F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 13, 4), 16, 10).cast("int"), F.greatest(F.size("at"), F.lit(1))) + 1).alias("nth"))
    other = cut.select(F.col("conv_id").alias("other"), F.col("turns").alias("o_turns"), F.col("at").alias("o_at"))
    j = own.join(donors(convs.select("conv_id")), "conv_id").join(other, "other")
    between = lambda turns, first, last: F.slice(turns, first, F.greatest(last - first + 1, F.lit(0)))
    from_ = F.get("o_at", F.least("nth", F.size("o_at")) - 1)
    ending = F.when(F.size("o_at") == 0, F.array().cast(TURNS)).otherwise(between(F.col("o_turns"), from_, F.get("o_at", F.size("o_at") - 1)))
    head = F.slice("turns", F.lit(1), F.get("at", F.col("nth") - 1) - 1)
    none = F.size("at") == 0
    return j.select(
        "conv_id",
        F.when(none, F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.get("at", F.size("at") - 1))).alias("chosen"),
        F.when(none, F.col("turns")).otherwise(F.concat(head, ending)).alias("rejected"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    pairs = sampled_pairs(conversations(table(spark, sf_dir, "conversations")))
    return formatted(pairs).select("conv_id", "pair.*")


ORACLE = f"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last, max(i) AS n, count(*) FILTER (WHERE role = 'assistant') AS k, md5(CAST(conv_id AS VARCHAR)) AS h FROM c GROUP BY conv_id),
z AS (SELECT *, CAST('0x' || substr(h, 13, 4) AS INTEGER) % greatest(k, 1) + 1 AS nth,
             substr(h, 1, (SELECT {" + ".join(f"(count(*) > {GROUP * 16**k})::INTEGER" for k in DIGITS)} FROM l)) AS g FROM l),
o AS (SELECT conv_id, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS other FROM z WINDOW w AS (PARTITION BY g ORDER BY conv_id)),
r AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS q FROM c WHERE role = 'assistant'),
e AS (SELECT z.conv_id, o.other, r.i AS pos, f.i AS o_from, y.last AS o_last FROM z JOIN o USING (conv_id) JOIN r ON r.conv_id = z.conv_id AND r.q = z.nth
      LEFT JOIN z y ON y.conv_id = o.other LEFT JOIN r f ON f.conv_id = o.other AND f.q = least(z.nth, y.k)),
a AS (SELECT conv_id, i, role, text FROM c JOIN l USING (conv_id) WHERE i <= coalesce(last, n)),
b AS (SELECT a.conv_id, i, role, text FROM a LEFT JOIN e USING (conv_id) WHERE pos IS NULL OR i < pos
      UNION ALL SELECT e.conv_id, pos + c.i - o_from, role, text FROM e JOIN c ON c.conv_id = e.other AND c.i BETWEEN e.o_from AND e.o_last),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i) AS i, coalesce(a.role = b.role AND a.text = b.text, false) AS same FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.i = b.i),
p AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS k FROM j GROUP BY conv_id),
u AS (SELECT conv_id, 'a' AS side, i, role, text FROM a UNION ALL SELECT conv_id, 'b', i, role, text FROM b),
s AS (SELECT u.conv_id, side, i, role, k, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS body FROM u JOIN p USING (conv_id)),
m AS (SELECT *, coalesce(sum(CASE WHEN i > k THEN length(head) + length(body) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS first FROM s)
SELECT p.conv_id, p.k::BIGINT AS prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'a' AND i <= p.k), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'a' AND i > p.k), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'b' AND i > p.k), '') AS rejected,
       coalesce(string_agg(first || '-' || (first + length(body)), ',' ORDER BY i) FILTER (WHERE side = 'a' AND i > p.k AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(first || '-' || (first + length(body)), ',' ORDER BY i) FILTER (WHERE side = 'b' AND i > p.k AND role = 'assistant'), '') AS rejected_mask
FROM p LEFT JOIN m ON p.conv_id = m.conv_id GROUP BY p.conv_id, p.k
"""
