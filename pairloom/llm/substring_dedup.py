"""Substring dedup of words with FM-indexes: words covered by 50 words in a row that also start in an earlier document are removed.

Words are runs of anything but ASCII white space, unchanged (null: none); an earlier document has a smaller ``doc_id`` (null: after all
others; rows that share an id are one document), and windows are judged on the input. ``repeats`` finds stretches of words whose
anchors occur again; later copies of a whole stretch are settled by counting. Stretches that share an anchor but differ elsewhere meet in one shard, which builds
a compressed FM-index over them: the Burrows-Wheeler transform in a wavelet tree of bit vectors with popcount directories, and two bit
vectors that mark where neighbouring suffixes part before the threshold; neither the text nor the suffix array is kept. All stretches
are streamed through it from their last word to their first by backward search. The matching statistic grows by a word a step until
it reaches the threshold, from where the interval is widened, by the marks, to the words but the last before each step. A window
counts if its interval holds an earlier document.

Texts under 50 words, empty texts and empty tables pass unchanged apart from white space; other columns are kept, whatever their
names. A text that repeats one word has an anchor for each word, so that its own row grows with its length and no other does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialized, release, table
from pairloom.llm.repeats import BASES, Rolling, Units, candidates, covered, judged, keyed, mixed, runs, stretches
from pairloom.llm.suffix_dedup import cut_out

LENGTH, GRAM = 50, 16
#: Suffixes are sorted by so many words; patterns are shorter.
SORTED = 64
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]])))
    return b, edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    b, start, end = word_bounds(text)
    return Rolling(_BYTE[b], BASES[0]).of(start, end) if len(start) else np.empty(0, np.uint64)


def _cut_words(text: bytes):
    """Words from ``a`` to ``b``, joined by spaces: a stretch of the text with single spaces."""
    words = text.split()
    joined, at = b" ".join(words), [0, *np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()]
    return lambda a, b: joined[at[a] : at[b] - 1]


WORDS = Units(LENGTH, GRAM, word_hashes, _cut_words)


class Bits:
    """A packed bit vector; ``ones(i)`` counts set bits before ``i`` with a directory and popcount."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))


class WaveletTree:
    """Level by level; a node's symbols lie together and start where the count of smaller symbols says."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.depth))])
        self.levels = []
        for level in range(self.depth):
            shift = self.depth - level
            by_node = symbols[np.argsort(symbols >> shift, kind="stable")] if level else symbols
            self.levels.append(Bits((by_node >> (shift - 1)) & 1 == 1))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` among the first ``i`` symbols."""
        for level, bits in enumerate(self.levels):
            shift = self.depth - level
            node = self.smaller[(c >> shift) << shift]
            ones = bits.ones(node + i) - bits.ones(node)
            i = np.where((c >> (shift - 1)) & 1 == 1, ones, i - ones)
        return i


class Marks:
    """A bit vector and the places of its set bits, as 32-bit numbers: from a place to the group between two set bits around it."""

    def __init__(self, first: np.ndarray):
        self.bits = Bits(first)
        self.at = np.append(np.flatnonzero(first), len(first)).astype(np.uint32)

    def group(self, i: np.ndarray) -> np.ndarray:
        return self.bits.ones(i + 1) - 1

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = self.group(i)
        return self.at[g].astype(np.int64), self.at[g + 1].astype(np.int64)


class FMIndex:
    """Over sequences of symbols from 1 on, each followed by a 0; ``value`` gives each symbol a number whose minimum over a window is asked for.

    Kept are the wavelet tree, the marks of suffixes that differ in ``length - 1`` and in ``length`` symbols, and a number for each
    group of the latter.
    """

    def __init__(self, text: np.ndarray, value: np.ndarray, length: int):
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank = self._ranks(text[order], order)
        width = 1
        while width < SORTED:
            key = rank * n + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key[order], order)
            width *= 2
        self.tree = WaveletTree(np.roll(text, 1)[order], int(text.max()) + 1)
        a, b = order[:-1], order[1:]
        same = np.ones(n - 1, bool)
        for k in range(length - 1):
            same &= text[(a + k) % n] == text[(b + k) % n]
        self.shorter = Marks(np.append(True, ~same))
        self.window = Marks(np.append(True, ~(same & (text[(a + length - 1) % n] == text[(b + length - 1) % n]))))
        self.earliest = np.minimum.reduceat(value[order], self.window.at[:-1].astype(np.int64))

    @staticmethod
    def _ranks(sorted_: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.diff(sorted_, prepend=sorted_[:1]) != 0)
        return rank

    def backward(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.tree.smaller[c]
        return base + self.tree.rank(c, lo), base + self.tree.rank(c, hi)


def earlier_windows(t: pa.Table) -> list[list[tuple[int, int]]]:
    """For each stretch (body, low, high, least) the ranges of windows that a stretch with a lesser ``least`` holds as well."""
    codes: dict[bytes, int] = {}
    bodies = [[codes.setdefault(w, len(codes) + 1) for w in b.split(b" ")] for b in t["body"].to_pylist()]
    size = np.array([len(b) for b in bodies])
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    text = np.concatenate([x for b in bodies for x in (b, [0])]).astype(np.int64)
    least, high = (t[c].to_numpy().astype(np.int64) for c in ("least", "high"))
    index = FMIndex(text, np.repeat(least, size + 1), LENGTH)
    hit = np.zeros((len(bodies), LENGTH - GRAM + 1), bool)
    lo, hi = np.zeros(len(bodies), np.int64), np.full(len(bodies), len(text), np.int64)
    for step in range(1, int(size.max()) + 1):
        live = np.flatnonzero(step <= size)
        if step > LENGTH:
            lo[live], hi[live] = index.shorter.bounds(lo[live])
        place = size[live] - step
        lo[live], hi[live] = index.backward(text[first[live] + place], lo[live], hi[live])
        if step >= LENGTH:
            found = index.earliest[index.window.group(lo[live])] < least[live]
            hit[live[found], high[live[found]] - place[found]] = True
    return runs(hit)


_COLUMNS = ["n_words", "n_removed", "kept_sha256", "kept", "spans"]
_CUT = "n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first:long,end:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, starts in zip(b["text"].cast(pa.large_binary()).to_pylist(), b["starts"].to_pylist(), strict=True):
            words = text.split()
            spans = covered(starts or [], LENGTH, len(words))
            edges = [0, *(x for s in spans for x in s), len(words)]
            left = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
            kept = b" ".join(left)
            out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"first": x, "end": y} for x, y in spans]))
        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        rest = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), spans_type), strict=True)]
        keep = [c for c in b.schema.names if c not in ("text", "starts")]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *rest], names=[*keep, *_COLUMNS])


def dedup_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "substring_dedup") -> DataFrame:
    """``df`` plus a struct ``out`` of n_words, n_removed, kept_sha256, kept (the remaining words) and spans (removed words)."""
    rows = keyed(df, doc_id, text)
    places = candidates(rows, WORDS)
    each, open_ = stretches(places)
    spans = judged(rows, open_, WORDS, earlier_windows)
    verdict = materialized(each.select("head", "whole", "least", "n").join(spans, ["head", "whole"], "left").filter("n > 1 OR spans IS NOT NULL").drop("n"))
    release(each, open_)
    full = F.array(F.struct(F.col("low"), F.col("high")))
    hits = (
        places.join(verdict.hint("merge"), ["head", "whole"])
        .select("own", "tx", "pos", F.when(F.col("own") > F.col("least"), full).otherwise(F.col("spans")).alias("spans"))
        .select("own", "tx", F.explode(F.transform("spans", lambda s: F.struct((F.col("pos") - s["high"]).alias("a"), (F.col("pos") - s["low"]).alias("b")))).alias("s"))
    )
    starts = hits.groupBy("own", "tx").agg(F.collect_set("s").alias("starts"))
    return cut_out(df, doc_id, text, out, starts, _cut, _CUT, _COLUMNS)


def op9(spark, sf_dir: str) -> DataFrame:
    d = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *(F.col(f"substring_dedup.{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")))
