"""Benchmark decontamination with SimHash over item-sized windows.

Texts and items (null: empty) are lower-cased in A-Z and cut into words; shingles are five words (an item of fewer words is one
shingle; one without words never matches). A window of a text holds as many words as the item, at every start; a text with fewer words
than the item is one window. Window and item are alike if the weighted Jaccard similarity of their shingles, each weighted by how often
it occurs, is 0.8 or more.

Items of one size share a set of tables. A window of that size is only looked at where enough of its shingles occur in any item of the
size, which running counts tell for all starts at once. It gets a SimHash fingerprint of 128 bits, in which each occurrence of a shingle
votes with a hash of its own, and is looked up in a multi-index over the items' fingerprints: ten blocks, a table for each, from a
block's value to the items that have it. If two fingerprints differ in ``RADIUS`` bits or fewer, some block differs in its share of them
or fewer, so that asking each table for all values that near loses nothing within the radius. What the tables name goes through the full
Hamming check and is compared exactly. Shingles are compared by 64-bit hashes.

At similarity 0.8 about 19 of 128 bits differ, with a deviation of 4, but that is no bound. A bound is each item's own: a bit can turn
only if its votes are as close as the shingles that may be replaced (:func:`may_turn`). Items with more such bits than the radius, and
all items of texts shorter than they are, are looked for a second time: by how many of a window's shingles each of them has, whatever
the fingerprint. So no similar window is lost.

The benchmark's different texts go to all tasks, ``ROUND_BYTES`` of them at a time; documents are read once for each such round, so
once for a benchmark up to that size. Each row is judged by itself: hot groups,
repeated rows and other columns, whatever their names, do not matter. Very long texts take their windows in parts. Empty tables give
empty results; of windows that are equally alike the first is reported; an item id that occurs with several texts is reported for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from pairloom.llm.common import column, table, texts
from pairloom.llm.repeats import BASES, Rolling, mixed
from pairloom.llm.substring_dedup import word_hashes

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 44
#: Words of 64 bits in a fingerprint, and blocks of its multi-index.
WORDS, BLOCKS = 2, 10
#: Bytes of item texts that are shipped to tasks at a time.
ROUND_BYTES = 8 << 20
#: Windows that are looked up at a time.
AT_ONCE = 256


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    return Rolling(words, BASES[1]).of(np.arange(n), np.arange(n) + size) if n > 0 else np.empty(0, np.uint64)


def votes(h: np.ndarray) -> np.ndarray:
    """For each hash and bit 1 or -1."""
    wide = np.stack([h, mixed(h ^ np.uint64(BASES[1]))], axis=1)
    return 2 * np.unpackbits(wide.view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").astype(np.int32) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, n x WORDS."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1, WORDS)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes in which a shingle's second, third, ... occurrences differ from its first one."""
    order = np.argsort(h, kind="stable")
    at = np.arange(len(h))
    again = at - np.maximum.accumulate(np.where(np.append(True, h[order][1:] != h[order][:-1]), at, 0)) if len(h) else at
    out = h.copy()
    later = order[again > 0]
    out[later] = mixed(h[later] + again[again > 0].astype(np.uint64) * np.uint64(BASES[1]))
    return out


def needed(m: int, width: int) -> int:
    """Shingles that multisets of m and width have in common at least, if they are alike."""
    return int(np.ceil(SIMILAR * (m + width) / (1 + SIMILAR) - 1e-9))


def may_turn(sums: np.ndarray, m: int) -> np.ndarray:
    """Bits of each item of ``m`` shingles that may differ in a window alike: each shingle replaced takes a vote and adds one."""
    change = 2 * (m - needed(m, m))
    return ((np.where(sums > 0, sums, 1 - sums)) <= change).sum(axis=1)


class MultiIndex:
    """A table for each block of a fingerprint, from the block's value to the items that have it, asked for all values near enough.

    With ``radius = q * blocks + r`` some of the first r + 1 blocks differs in q bits at most, or some other one in q - 1: else the sum
    would be greater. So whatever lies within the radius is found.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.edges = np.linspace(0, 64 * prints.shape[1], blocks + 1).astype(int)
        self.prints, self.radius = prints, radius
        self.near_by = [q for q in (radius // blocks, radius // blocks - 1) for _ in range(blocks)][blocks - 1 - radius % blocks :][:blocks]
        self.tables = []
        for k, value in enumerate(self._values(prints)):
            order = np.argsort(value, kind="stable").astype(np.uint32)
            first = np.searchsorted(value[order], np.arange(self._size(k) + 1))
            self.tables.append((first.astype(np.uint16 if len(prints) < 1 << 16 else np.uint32), order))

    def _size(self, k: int) -> int:
        return 1 << int(self.edges[k + 1] - self.edges[k])

    def _values(self, prints: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            yield bits[:, a:b].astype(np.int32) @ (1 << np.arange(b - a, dtype=np.int32))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``prints``, item) that have a near block."""
        pairs = [np.empty(0, np.int64)]
        for k, (value, (first, order)) in enumerate(zip(self._values(prints), self.tables, strict=True)):
            flips = np.arange(self._size(k), dtype=np.int32)
            flips = flips[np.bitwise_count(flips) <= self.near_by[k]]
            asked = value[:, None] ^ flips
            many = (first[1:] - first[:-1])[asked]
            row, flip = np.nonzero(many)
            n = many[row, flip].astype(np.int64)
            begin = first[asked[row, flip]].astype(np.int64)
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.repeat(row, n) * len(self.prints) + order[at])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.prints), found % len(self.prints)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and distance of those within the radius, in order of rows."""
        different, back = np.unique(prints, axis=0, return_inverse=True)
        parts = [(r + i, x) for i in range(0, len(different), AT_ONCE) for r, x in [self.candidates(different[i : i + AT_ONCE])]]
        row, item = (np.concatenate(c) for c in zip(*parts, strict=True))
        d = apart(different[row], self.prints[item])
        row, item, d = row[d <= self.radius], item[d <= self.radius], d[d <= self.radius]
        ends = np.searchsorted(row, np.arange(len(different) + 1))
        back = back.ravel()
        n = ends[back + 1] - ends[back]
        at = np.repeat(ends[back] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(prints)), n), item[at], d[at]


class Shared:
    """From a shingle to the items that have it, for items whose fingerprints say too little (``far``)."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], far: np.ndarray):
        keys = np.concatenate([k for k, _ in counts])
        owner = np.repeat(np.arange(len(counts)), [len(k) for k, _ in counts])
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first, self.owner, self.far = np.append(first, len(keys)), owner[order], far

    def enough(self, h: np.ndarray, run: np.ndarray, width: int, need: int, all_items: bool) -> tuple[np.ndarray, np.ndarray]:
        """Row of ``run`` and item, where ``need`` of the window's shingles occur in the item, of ``far`` ones or all."""
        rows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not (all_items or self.far.any()):
            return rows[0], items[0]
        span = h[run[0] : run[-1] + width]
        at = np.minimum(np.searchsorted(self.keys, span), len(self.keys) - 1)
        begin, many = self.first[at], np.where(self.keys[at] == span, self.first[at + 1] - self.first[at], 0)
        ends = np.cumsum(many)
        owner = self.owner[np.repeat(begin - ends + many, many) + np.arange(many.sum())]
        ends = np.append(0, ends)
        for r, s in enumerate((run - run[0]).tolist()):
            n = np.bincount(owner[ends[s] : ends[s + width]], minlength=len(self.far))
            found = np.flatnonzero((n >= need) & (all_items | self.far))
            rows.append(np.full(len(found), r))
            items.append(found)
        return np.concatenate(rows), np.concatenate(items)


class Items:
    """Different texts of the benchmark, ready to be looked for: an index for each size in words."""

    def __init__(self, rows: list[tuple[str, list]]):
        """``rows``: a text and the ids that it has."""
        by_size: dict[int, list[tuple[list, np.ndarray]]] = {}
        for text, ids in rows:
            words = word_hashes(text.encode().lower())
            if len(words):
                by_size.setdefault(len(words), []).append((ids, shingles(words, min(SHINGLE, len(words)))))
        self.sizes, owned = {}, {}
        for n, found in by_size.items():
            sums = np.concatenate([votes(numbered(h)).sum(axis=0, keepdims=True) for _, h in found])
            counts = [np.unique(h, return_counts=True) for _, h in found]
            far = may_turn(sums, n - min(SHINGLE, n) + 1) > RADIUS
            self.sizes[n] = [ids for ids, _ in found], counts, MultiIndex(packed(sums)), Shared(counts, far)
            owned.setdefault(min(SHINGLE, n), []).append((np.unique(np.concatenate([c[0] for c in counts])), n))
        # for each length of shingles: all of them, and the sizes of items that have each one
        self.known = {}
        for size, parts in owned.items():
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([np.full(len(k), n) for k, n in parts])
            order = np.argsort(keys, kind="stable")
            different, first = np.unique(keys[order], return_index=True)
            self.known[size] = different, np.append(first, len(keys)), n[order]

    def find(self, text: bytes) -> list[tuple]:
        """(ids, first word, words, similarity, differing bits) of the best window for each item that the text holds."""
        words, out = word_hashes(text.lower()), []
        for size, (keys, first, sizes) in self.known.items():
            h = shingles(words, size)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == h)
            if not len(hits):
                continue
            begin, many = first[at[hits]], first[at[hits] + 1] - first[at[hits]]
            place = np.repeat(hits, many)
            owner = sizes[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
            for n in np.unique(owner).tolist():
                ids, counts, index, shared = self.sizes[n]
                for item, found in self._best(h, place[owner == n], n - size + 1, counts, index, shared).items():
                    out.append((ids[item], found[1], min(n, len(words)), found[0], found[2]))
        return out

    def _best(self, h: np.ndarray, hits: np.ndarray, m: int, counts: list[tuple[np.ndarray, np.ndarray]], index: MultiIndex, shared: Shared) -> dict[int, tuple[float, int, int]]:
        """Item -> similarity, first word and differing bits, over windows of ``m`` shingles; ``hits`` are the shingles that some item of the size has."""
        best: dict[int, tuple[float, int, int]] = {}
        width = min(m, len(h))
        need = needed(m, width)
        if width < need or len(hits) < need:
            return best
        within = np.zeros(len(h) + 1, np.int64)
        within[hits + 1] = 1
        within = np.cumsum(within)
        starts = np.flatnonzero(within[width:] - within[:-width] >= need)
        # windows that lie close together share their running votes
        for run in np.split(starts, np.flatnonzero((np.diff(starts) > width) | (np.diff(starts // AT_ONCE) > 0)) + 1) if len(starts) else []:
            prints = self._prints(h, run, width)
            rows, items, bits = index.near(prints)
            more, which = shared.enough(h, run, width, need, width < m)
            rows, items, bits = np.concatenate([rows, more]), np.concatenate([items, which]), np.concatenate([bits, apart(prints[more], index.prints[which])])
            _, first = np.unique(rows * len(counts) + items, return_index=True)
            for s, item, d in zip(run[rows[first]].tolist(), items[first].tolist(), bits[first].tolist(), strict=True):
                own, times = counts[item]
                there, again = np.unique(h[s : s + width], return_counts=True)
                _, i, j = np.intersect1d(own, there, assume_unique=True, return_indices=True)
                both = int(np.minimum(times[i], again[j]).sum())
                alike = both / (m + width - both)
                if alike >= SIMILAR - 1e-12 and (item not in best or alike > best[item][0]):
                    best[item] = alike, s, d
        return best

    def _prints(self, h: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
        span = h[run[0] : run[-1] + width]
        if len(np.unique(span)) < len(span):
            return packed(np.concatenate([votes(numbered(h[s : s + width])).sum(axis=0, keepdims=True) for s in run.tolist()]))
        sums = np.concatenate([np.zeros((1, 64 * WORDS), np.int32), np.cumsum(votes(span), axis=0)])
        return packed(sums[run - run[0] + width] - sums[run - run[0]])


def rounds(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", round_bytes: int = ROUND_BYTES) -> Iterator[Items]:
    """The benchmark's different texts, as many at a time as may be shipped to tasks."""
    rows = benchmark.select(column(item_id).alias("id"), F.coalesce(column(text), F.lit("")).alias("text"))
    each = rows.groupBy("text").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max(F.col("id").isNull()).alias("none"))
    held, size = [], 0
    for r in each.toLocalIterator():
        held.append((r["text"], list(r["ids"]) + [None] * bool(r["none"])))
        size += len(r["text"].encode())
        if size >= round_bytes:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity, differing_bits: the best window of each text for each item it holds.

    An ``item_id`` that is named as ``doc_id`` is refused.
    """
    if doc_id == item_id:
        raise ValueError("documents and items need ids of different names")
    item_kind = benchmark.schema[item_id].dataType
    rows = docs.select(column(doc_id).alias("doc"), F.coalesce(column(text), F.lit("")).alias("text"))
    numbers = [StructField("first_word", LongType()), StructField("n_words", LongType()), StructField("similarity", DoubleType()), StructField("differing_bits", IntegerType())]
    schema = StructType([StructField("doc", docs.schema[doc_id].dataType), StructField("item", item_kind), *numbers])
    out = docs.sparkSession.createDataFrame([], schema)
    for items in rounds(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, item, *f[1:]) for i, t in enumerate(texts(b["text"])) for f in items.find(t) for item in f[0]]
                at, ids, *rest = zip(*found, strict=True) if found else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                columns = [b["doc"].take(pa.array(at, pa.int64())), pa.array(ids, to_arrow_type(item_kind)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        out = out.union(rows.mapInArrow(run, schema))
    return out.toDF(doc_id, item_id, *schema.names[2:])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, unchanged."""
    names, at = docs.columns, docs.columns.index(text)
    # names may hold dots, which a task's columns may not
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for items in rounds(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not (t and items.find(t)) for t in texts(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


def op10(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without benchmark items, unchanged."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
