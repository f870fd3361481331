"""Candidates for exact repeats of ``length`` symbols (bytes or words) across a table of texts, without a pass over all pairs.

Every window of ``length`` symbols picks the least hash among its grams of ``gram`` symbols: its anchor. Equal windows pick equal
anchors at equal places, so only windows whose anchor occurs twice or more can repeat. The windows that pick one anchor are
neighbours, and together they cover one stretch of text. ``head`` is the hash of the anchor gram, ``whole`` the XXH64 of the stretch's
bytes: copies of a stretch share both, 128 bits, which settles them by counting. Stretches that share an anchor but differ elsewhere
are ``open`` and go to an index, with their symbols, to be compared exactly there.

Stretches of one anchor meet in one group. An anchor with more than ``HOT`` open stretches is split into ``SPLITS`` ranges of places
that the anchor can have in a window: all windows of a range share ``length`` symbols less the range, whose hash is part of the
group's key, so that equal windows still meet. Tasks judge whole groups, about ``STRETCHES_PER_TASK`` stretches at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, materialized, owner, release

U64 = np.uint64
#: Odd multipliers of the two rolling hashes; any odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Window starts that are hashed at a time, to bound memory on very long texts.
BLOCK = 1 << 18
#: Open stretches that are judged at a time; a group is never cut.
STRETCHES_PER_TASK = 20_000
#: Open stretches of an anchor beyond which it is split, and into how many ranges.
HOT, SPLITS = 2_000, 8


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Rolling:
    """Hash of any stretch of a sequence in two look-ups, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = self.powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            n = 1 << n.bit_length()
            one = lambda b: np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))])
            cls._powers[base] = one(base), one(pow(base, -1, 2**64))
        return cls._powers[base]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, in linear time: least of blocks from the left and from the right."""
    n, rows = len(v) - w + 1, -(-len(v) // w)
    p = np.full(rows * w, np.iinfo(U64).max, U64)
    p[: len(v)] = v
    p = p.reshape(rows, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(values: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """pos, low, high, head of each anchor: the windows from ``pos - high`` to ``pos - low`` picked it."""
    found: list[tuple[np.ndarray, ...]] = []
    for base in range(0, len(values) - length + 1, BLOCK):
        v = values[base : base + BLOCK + length - 1]
        r = Rolling(v, BASES[0])
        at = np.arange(len(v) - gram + 1)
        heads = r.of(at, at + gram)
        picked = (sliding_min((heads & U64(0xFFFFFFFF00000000)) | at.astype(U64), length - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(picked, prepend=-1))
        last = np.append(first[1:], len(picked)) - 1
        pos = picked[first]
        found.append((pos + base, pos - last, pos - first, heads[pos].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(4))


@dataclass(frozen=True)
class Units:
    """How a text becomes symbols: ``hashes`` gives a number for each, ``cut`` a function from symbol positions to bytes."""

    length: int
    gram: int
    hashes: Callable[[bytes], np.ndarray]
    cut: Callable[[bytes], Callable[[int, int], bytes]]


ANCHOR = "own long, tx long, pos int, low int, high int, head long, whole long"


def _find(units: Units):
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for own, tx, text in zip(b["own"].to_pylist(), b["tx"].to_pylist(), b["text"].cast(pa.large_binary()).to_pylist(), strict=True):
                pos, low, high, head = anchors(units.hashes(text), units.gram, units.length)
                n, view = len(pos), units.cut(text)
                ends = zip((pos - high).tolist(), (pos - low + units.length).tolist(), strict=True)
                got = pos, low, high, head, np.fromiter((digest(view(x, y)) for x, y in ends), U64, n).view(np.int64)
                for c, x in zip(columns, (np.full(n, own), np.full(n, tx), *got), strict=True):
                    c.append(x)
                if sum(map(len, columns[0])) >= 100_000:
                    yield _batch(columns)
                    columns = [[] for _ in range(7)]
            if columns[0]:
                yield _batch(columns)

    return run


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds, strict=True)], names=["own", "tx", "pos", "low", "high", "head", "whole"])


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """own, tx and text of each row; rows that agree in the first two hold one text."""
    t = F.coalesce(column(text), F.lit(""))
    return df.select(owner(column(doc_id)).alias("own"), F.xxhash64(t).alias("tx"), t.alias("text"))


def candidates(rows: DataFrame, units: Units) -> DataFrame:
    """Anchors whose gram occurs again somewhere, as a written table."""
    found = materialized(rows.filter(F.octet_length("text") >= units.length).mapInArrow(_find(units), ANCHOR))
    # the counts are written first: a join of two plain shuffles can be split where one anchor is hot
    again = materialized(found.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head"))
    out = materialized(found.join(again.hint("merge"), "head", "left_semi").select(*found.columns))
    release(found, again)
    return out


def stretches(candidates_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each stretch (n occurrences, least owner, one place), and those that share an anchor with another stretch (hot: with many)."""
    place = [F.first(c).alias(c) for c in ("tx", "pos", "low", "high")]
    # all ``first`` of one group take the same row, as no column holds nulls
    each = materialized(candidates_.groupBy("head", "whole").agg(F.count("*").alias("n"), F.min("own").alias("least"), F.first("own").alias("own"), *place))
    several = materialized(each.groupBy("head").agg(F.count("*").alias("m")).filter("m > 1").select("head", (F.col("m") > HOT).alias("hot")))
    open_ = materialized(each.join(several.hint("merge"), "head").select(*each.columns, "hot"))
    release(several)
    return each, open_


_BODY = pa.schema([("key", pa.int64()), ("head", pa.int64()), ("whole", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("place", pa.int32()), ("body", pa.binary())])


def _extract(units: Units):
    """A row for each open stretch with its symbols; for each range of places, if it is hot. ``place`` is where its anchor stands in the body."""
    widest = units.length - units.gram + 1
    cuts = np.linspace(0, widest, SPLITS + 1).astype(int).tolist()

    def parts(i: dict) -> Iterator[tuple[int, int]]:
        if not i["hot"]:
            yield i["low"], i["high"]
            return
        for a, b in zip(cuts, cuts[1:], strict=False):
            if i["low"] < b and i["high"] >= a:
                yield max(a, i["low"]), min(b - 1, i["high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for text, items in zip(b["text"].cast(pa.large_binary()).to_pylist(), b["items"].to_pylist(), strict=True):
                view = units.cut(text)
                for i in items:
                    for low, high in parts(i):
                        key, first = i["head"], i["pos"] - high
                        if i["hot"]:
                            k = next(k for k in range(SPLITS) if low < cuts[k + 1])
                            shared = view(i["pos"] - cuts[k], i["pos"] - cuts[k + 1] + 1 + units.length)
                            key = xxhash.xxh64_intdigest(shared, seed=k) - 2**63
                        out.append({"key": key, "head": i["head"], "whole": i["whole"], "n": i["n"], "least": i["least"], "low": low, "high": high, "place": high, "body": view(first, i["pos"] - low + units.length)})
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_pylist(out, _BODY)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _BODY)

    return run


def judged(rows: DataFrame, open_: DataFrame, units: Units, judge: Callable[[pa.Table], list[list[tuple[int, int]]]]) -> DataFrame:
    """head, whole and ``spans`` (low, high) of the windows that ``judge`` finds repeated; what shares a key is judged together."""
    size = open_.select(F.sum(F.when(F.col("hot"), F.lit(SPLITS)).otherwise(1))).first()[0] or 0
    n = max(1, math.ceil(size / STRETCHES_PER_TASK))
    wanted = open_.groupBy("own", "tx").agg(F.collect_list(F.struct("head", "whole", "n", "least", "pos", "low", "high", "hot")).alias("items"))
    kinds = "key long, head long, whole long, n long, least long, low int, high int, place int, body binary"
    # rows that share id and text give each stretch more than once; ``judge`` counts it once
    bodies = rows.join(wanted, ["own", "tx"]).select("text", "items").mapInArrow(_extract(units), kinds)
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def verdict(t: pa.Table) -> pa.RecordBatch:
        spans = judge(t)
        keep = [i for i, s in enumerate(spans) if s]
        at = pa.array(keep, pa.int64())
        found = pa.table({"head": t["head"].take(at), "whole": t["whole"].take(at), "spans": pa.array([[{"low": a, "high": b} for a, b in spans[i]] for i in keep], kind)})
        return found.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b["key"].to_numpy()
            new = np.flatnonzero(np.diff(keys) != 0) + 1  # where another key begins
            if held and held[-1]["key"][-1].as_py() != keys[0]:
                new = np.append(0, new)
            start = 0
            for cut in new.tolist():
                if sum(h.num_rows for h in held) + cut - start >= STRETCHES_PER_TASK:
                    yield from verdict(pa.Table.from_batches([*held, b.slice(start, cut - start)]))
                    held, start = [], cut
            held.append(b.slice(start))
        if held:
            yield from verdict(pa.Table.from_batches(held))

    spans = bodies.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "head long, whole long, spans array<struct<low:int,high:int>>")
    return spans.groupBy("head", "whole").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def runs(hit: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each row of a boolean matrix the runs of true columns (first, last)."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(hit))]
    (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    for r, x, y in zip(i.tolist(), a.tolist(), b.tolist(), strict=True):
        out[r].append((x, y - 1))
    return out


def covered(starts: list[dict], length: int, n: int) -> list[tuple[int, int]]:
    """Half-open stretches of symbols that windows starting in the ranges ``starts`` (a to b) cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in starts):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b + length)
        else:
            out.append((a, b + length))
    return [(a, min(b, n)) for a, b in out]
