"""Near copies by exact Jaccard similarity of word shingles, without a pair lost.

Texts (null: empty) are lower-cased in A-Z; their sets of word shingles (fewer words: the whole sequence; none: the empty set) are
compared by 64-bit hashes. Two sets are linked if their Jaccard similarity is ``similar`` or more; texts take the components of links.

At similarity 0.8 about ten of 64 SimHash bits differ, with a deviation of 3, so that no radius that prunes holds all pairs. So
SimHash links (over the same shingles) are only the first candidates. Prefix filtering adds the rest: in any order of shingles common to
all texts, the first ``n - ceil(similar * n) + 1`` of two similar sets share one. Shingles that are frequent in a sample come last in the
order, which decides the work and never the result. Of each shared prefix shingle, texts meet one leader first; those that are then in
one component need no further comparison, and the pairs of different components are all compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import simhash_dedup
from pairloom.llm.common import alone, column, materialized, owner, release, texts

SHINGLE, SIMILAR = 5, 0.8
#: Frequent shingles are looked for in one of so many sets; at most so many are kept, and each occurs so often there.
SAMPLE, FREQUENT, OFTEN = 16, 50_000, 4
#: Pairs across components are listed once there are at most so many for each entry; before, leaders are compared, in so many rounds.
PAIRS, ROUNDS = 8, 4


def sets(df: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """own, tx, node (digest of the set), fp (SimHash) and grams of each row, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                h = [simhash_dedup.shingle_hashes(t, shingle) for t in texts(part["text"])]
                g = [np.unique(x) for x in h]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in g], np.uint64).view(np.int64)
                fp = np.array([simhash_dedup.majority(x) for x in h], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, g)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*g, np.empty(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["own"], part["tx"], pa.array(node), pa.array(fp), grams], names=["own", "tx", "node", "fp", "grams"])

    t = F.coalesce(column(text), F.lit(""))
    rows = df.select(owner(column(doc_id)).alias("own"), F.xxhash64(t).alias("tx"), t.alias("text"))
    return materialized(rows.mapInArrow(run, "own long, tx long, node long, fp long, grams array<long>"))


def prefixes(rows: DataFrame, similar: float) -> DataFrame:
    """node, n, key: the prefix shingles of each row."""
    sample = rows.filter(F.pmod("node", F.lit(SAMPLE)) == 0).select(F.explode("grams").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = sample.filter(F.col("n") >= OFTEN).orderBy(F.col("n").desc(), "key").limit(FREQUENT).collect()
    often = sorted((r.key, FREQUENT - i) for i, r in enumerate(often))
    keys, rank = np.array([k for k, _ in often], np.int64), np.array([i for _, i in often], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, out = [], [], []
            for i, g in zip(b["node"].to_pylist(), b["grams"], strict=True):
                g = g.values.to_numpy()
                late = np.zeros(len(g), np.int64)
                if len(keys) and len(g):
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    late = np.where(keys[at] == g, rank[at], 0)
                first = g[np.lexsort((g, late))][: len(g) - math.ceil(similar * len(g) - 1e-9) + 1]
                node.append(np.full(len(first), i, np.int64))
                n.append(np.full(len(first), len(g), np.int32))
                out.append(first)
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (node, n, out)], names=["node", "n", "key"])

    return rows.select("node", "grams").mapInArrow(run, "node long, n int, key long")


def similar_pairs(pairs: DataFrame, heads: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """lo, hi: the ``pairs`` (a, b) that are similar.

    ``heads`` hold the shared prefix shingles of each node. If two prefixes share c shingles, the sets share c and the longer rest at
    most: what can't reach the similarity by that needs no whole set.
    """
    rest = lambda n: F.ceil(similar * F.col(n) - 1e-9) - 1
    side = lambda c: heads.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("head").alias(f"h{c}"))
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    reach = F.size(F.array_intersect("ha", "hb")) + F.greatest(rest("na"), rest("nb"))
    p = materialized(p.filter(reach >= similar / (1 + similar) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b"))
    nodes = materialized(p.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    grams = materialized(rows.select("node", "grams").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")))
    side = lambda c: grams.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}"))
    p = p.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    p = p.select("a", "b", (F.size("ga") + F.size("gb")).alias("n"), F.size(F.array_intersect("ga", "gb")).alias("both"))
    return p.filter(F.col("both") >= similar * (F.col("n") - F.col("both")) - 1e-9).select(F.col("a").alias("lo"), F.col("b").alias("hi"))


def roots(rows: DataFrame, similar: float) -> DataFrame:
    """node, root of each node that has a link; ``rows`` hold node, fp and grams."""
    entries = materialized(prefixes(rows, similar))
    again = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    shared = materialized(entries.join(again.hint("merge"), "key", "left_semi").distinct())
    release(entries)
    heads = materialized(shared.groupBy("node", "n").agg(F.collect_list("key").alias("head")))
    fps = materialized(rows.select("node", "fp").distinct())
    near = simhash_dedup.links(fps.select("fp").distinct()).select(F.col("hi").alias("fp"), "lo")
    least = fps.groupBy("fp").agg(F.min("node").alias("a"))
    candidates = fps.join(least, "fp").select("a", F.col("node").alias("b")).unionByName(near.join(least, "fp").select(F.col("a").alias("b"), "lo").join(least.withColumnRenamed("fp", "lo"), "lo").select("a", "b"))
    edges = alone(lambda: materialized(similar_pairs(candidates.filter("a <> b"), heads, rows, similar)))
    fits = lambda x, y: (F.col(x) >= similar * F.col(y) - 1e-9) & (F.col(y) >= similar * F.col(x) - 1e-9)
    size = shared.count()

    def further(edges: DataFrame, turn: int) -> DataFrame:
        """The edges and those that this turn finds; it is the last one if few pairs of different components are left."""
        found = simhash_dedup.components(edges).withColumnRenamed("fp", "node")
        e = materialized(shared.join(found.hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
        each = e.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        mixed = materialized(each.filter("c * c > own").select("key", ((F.col("c") * F.col("c") - F.col("own")) / 2).alias("pairs")))
        e = materialized(e.join(mixed.hint("merge"), "key").drop("pairs"))
        last = turn == ROUNDS or (mixed.agg(F.sum("pairs")).first()[0] or 0) <= PAIRS * size
        if last:
            other = e.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("top"))
            pairs = e.join(other.hint("merge"), "key").filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("top")))
        else:
            order = F.xxhash64("node", F.lit(turn))
            lead = e.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("top")), order).alias("x")).select("key", "x.*")
            pairs = e.join(lead.hint("merge"), "key").filter(F.col("root") != F.col("top"))
        out = materialized(edges.unionByName(similar_pairs(pairs.filter(fits("n", "m")).select(F.col("node").alias("a"), "b"), heads, rows, similar)))
        out._last = last
        return out

    for turn in range(ROUNDS + 1):
        new = alone(lambda edges=edges, turn=turn: further(edges, turn))
        release(edges)
        edges = new
        if edges._last:
            return simhash_dedup.components(edges).withColumnRenamed("fp", "node")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the least id stays (of several such, one of the texts)."""

    def first() -> DataFrame:
        rows = sets(df, doc_id, text, shingle)
        nodes = rows.select("own", "tx", "node").join(roots(rows, similar).hint("merge"), "node", "left").select("own", "tx", F.coalesce("root", "node").alias("root"))
        return materialized(nodes.groupBy("root").agg(F.min(F.struct("own", "tx")).alias("k")).select("k.*"))

    return simhash_dedup.first_rows(df, alone(first), doc_id, text)
