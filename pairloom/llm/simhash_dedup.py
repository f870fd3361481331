"""SimHash near-dedup with pigeonring filtering.

A text (null: empty) is lower-cased in A-Z, its words give three-word shingles (repeats included; fewer words: the whole sequence), and
a bit of its 64-bit fingerprint is set where over half of the shingles' XXH64 (seed 42) have it; without words it is zero. Fingerprints
that differ in two bits or fewer are linked, and texts take the components of these links.

Pigeonring: the fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ in 2 bits or fewer, some segment starts a
chain whose differences stay within ``length * 2 / 16``, rounded down, for every length: none in 7 segments, one in 15, two in all 16.
The lengths prune one after the other. Fingerprints are dealt to a bucket for each start and the 28 bits of its first 7 segments; those
alone there fall out. The next 8 segments may hold one differing bit, so that one half of them is equal: the others are dealt by start,
28 bits and half, and those alone fall out again. What is left may differ in the other half and in the last segment only: each
fingerprint goes to itself and to its one-bit changes there, where all that are within two bits of one another meet, at most 65 in one
place. Everyone there is linked to the least, after the full Hamming check. So work follows the number of different fingerprints,
whatever the size of a bucket or of a group of copies, and no pairs within a group are listed.

Components come from alternating large and small stars, in written tables, over different fingerprints only. Equal texts share a
fingerprint. Ids are integers; ``component_id`` is the least id that can be reached (null if all there are null). Other columns are not
read, whatever their names; very long texts are hashed whole; repeated rows are rows of one component; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import alone, column, materialized, owner, release, table, texts

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENT, SEGMENTS = 4, 16
BITS = SEGMENT * SEGMENTS
#: Bits of a chain before its budget reaches one differing bit.
EQUAL = SEGMENT * (SEGMENTS // RADIUS - 1)
AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    bounds = zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64, len(words) - shingle + 1)


def majority(h: np.ndarray) -> int:
    if len(h) == 0:
        return 0
    ones = sum(np.unpackbits(h[i : i + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), AT_ONCE))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t) for t in texts(b["text"])], np.uint64)
        yield pa.RecordBatch.from_arrays([b["doc"], b["own"], b["tx"], pa.array(f.view(np.int64))], names=["doc", "own", "tx", "fp"])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, own, tx and fp (the fingerprint as a signed number) of each row, as a written table."""
    t = F.coalesce(column(text), F.lit(""))
    rows = df.select(column(doc_id).cast("long").alias("doc"), owner(column(doc_id)).alias("own"), F.xxhash64(t).alias("tx"), t.alias("text"))
    return materialized(rows.mapInArrow(_fingerprints, "doc long, own long, tx long, fp long"))


def _ring(start: int, first: int, size: int) -> Column:
    """``size`` bits of ``fp``, from bit ``first`` of the ring that begins at segment ``start``, as a number."""
    turn = (SEGMENT * start + first) % BITS
    turned = F.col("fp") if turn == 0 else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", BITS - turn))
    return F.shiftrightunsigned(turned, BITS - size)


def _mask(start: int, first: int, size: int) -> int:
    """Those bits as a signed mask."""
    ones = ((1 << size) - 1) << (BITS - size)
    turn = (SEGMENT * start + first) % BITS
    x = ((ones >> turn) | (ones << (BITS - turn))) & ((1 << BITS) - 1)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs again."""
    again = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    return rows.join(again.hint("merge"), key, "left_semi")


def equal_chains(fps: DataFrame) -> DataFrame:
    """fp, start: chains of 7 segments (no differing bit allowed) that another fingerprint has, too."""
    chain = lambda i: F.struct(F.lit(i).alias("start"), (F.lit(i << EQUAL) + _ring(i, 0, EQUAL)).alias("bucket"))
    buckets = fps.select("fp", F.explode(F.array(*map(chain, range(SEGMENTS)))).alias("c")).select("fp", "c.*")
    return _shared(buckets, "bucket").select("fp", "start")


def long_chains(chains: DataFrame) -> DataFrame:
    """fp, free: of those, the fingerprints whose chains go on to 15 segments with one differing bit, and the bits that may differ."""
    half = (BITS - EQUAL - SEGMENT) // 2

    def go_on(i: int, h: int) -> Column:
        key = F.shiftleft(_ring(i, 0, EQUAL), half).bitwiseOR(_ring(i, EQUAL + h * half, half)) + (((i << 1) + h) << (EQUAL + half))
        free = _mask(i, EQUAL + (1 - h) * half, half) | _mask(i, BITS - SEGMENT, SEGMENT)
        return F.struct(key.alias("bucket"), F.lit(free).alias("free"))

    both = F.array(*(F.array(go_on(i, 0), go_on(i, 1)) for i in range(SEGMENTS)))
    keys = chains.select("fp", F.explode(F.get(both, "start")).alias("c")).select("fp", "c.*")
    return _shared(keys, "bucket").groupBy("fp").agg(F.bit_or("free").alias("free"))


def links(fps: DataFrame) -> DataFrame:
    """lo, hi: a forest's worth of the links between different fingerprints ``fp``; each is real, and their components are those of all."""
    chains = materialized(equal_chains(fps))
    left = materialized(long_chains(chains))
    release(chains)
    moved = left.select("fp", F.explode(F.expr(f"concat(array(fp), transform(filter(sequence(0, {BITS - 1}), i -> shiftright(free, i) & 1 = 1), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    least = moved.groupBy("near").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("near", "lo")
    pairs = moved.join(least.hint("merge"), "near").filter(F.col("fp") > F.col("lo")).select("lo", F.col("fp").alias("hi"))
    return pairs.filter(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS).distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root (the least of its component) for each ``hi`` of the edges, by alternating large and small stars."""
    edges, before = materialized(edges), None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi"), F.col("lo")))
        root = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(root, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("v")).filter("lo < v").select("lo", F.col("v").alias("hi")).distinct()
        new = materialized(small)
        release(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("fp"), F.col("lo").alias("root"))
        before = now


def near_groups(fps: DataFrame) -> DataFrame:
    """fp, root, least owner and least id of its component for each different fingerprint."""
    nodes = materialized(fps.groupBy("fp").agg(F.min("doc").alias("doc"), F.min("own").alias("own")))
    with_root = materialized(nodes.join(components(links(nodes.select("fp"))), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc", "own"))
    least = with_root.groupBy("root").agg(F.min("doc").alias("component_id"), F.min("own").alias("least"))
    return with_root.select("fp", "root").join(least, "root")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id; a row for each row of ``df``."""
    fps = fingerprints(df, doc_id, text)
    return fps.join(near_groups(fps), "fp").select(F.col("doc").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the least id stays (of several such, one of the texts)."""

    def first() -> DataFrame:
        fps = fingerprints(df, doc_id, text)
        return materialized(fps.join(near_groups(fps), "fp").filter("own = least").groupBy("root").agg(F.min(F.struct("own", "tx")).alias("k")).select("k.*"))

    return first_rows(df, alone(first), doc_id, text)


def first_rows(df: DataFrame, first: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``df`` for each own and tx of ``first``."""
    marked = df.select(F.struct(*map(column, df.columns)).alias("row"), owner(column(doc_id)).alias("own"), F.xxhash64(F.coalesce(column(text), F.lit(""))).alias("tx"))
    kept = marked.join(first, ["own", "tx"], "left_semi")
    again = kept.groupBy("own", "tx").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return kept.select("row.*")
    return kept.groupBy("own", "tx").agg(F.first("row").alias("row")).select("row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group with five-word similarity 0.8 (op6's own parameters don't hold here), unchanged."""
    from pairloom.llm import near_sets

    return near_sets.keep_first(docs)
