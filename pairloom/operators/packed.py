"""Learning from packed rows: a pass over the data is one Spark job for all models at once, however many years they learn from.

``packed`` writes rows once as blocks, a year's rows column by column. In a pass each task adds up what its blocks give, by slot and place,
Spark adds up the tasks' sums, and the driver gets these, whose number does not follow the rows. A model of the year ``cut`` learns from the
blocks of all years before it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.learn import Scale
from pairloom.tables import release, written

BLOCK_ROWS = 16384
#: Bits of a value that one pass of ``quantiles`` settles.
BITS = 8
Step = Callable[[int, np.ndarray], Iterator[tuple[int, np.ndarray]]]


def packed(df: DataFrame, year: str, columns: list[str]) -> DataFrame:
    """year, data: the ``columns`` of up to about ``BLOCK_ROWS`` rows of a year as doubles (null: NaN), column by column. Rows without a year are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)

        def block(y: int) -> pa.RecordBatch:
            data = np.ascontiguousarray(np.concatenate(held.pop(y), axis=1)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([data], pa.binary())], names=["year", "data"])

        for b in batches:
            years = b["year"].to_numpy(zero_copy_only=False)
            m = np.stack([b[i + 1].fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            for y in np.unique(years).tolist():
                held[y].append(m[:, years == y])
                if sum(p.shape[1] for p in held[y]) >= BLOCK_ROWS:
                    yield block(y)
        for y in list(held):
            yield block(y)

    rows = df.filter(F.col(year).isNotNull()).select(F.col(year).cast("int").alias("year"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    return written(rows.mapInArrow(run, "year int, data binary"))


def summed(blocks: DataFrame, step: Step, width: int, kind: type = np.float64) -> dict[int, dict[int, float]]:
    """By slot and place the sums of the vectors that ``step(year, matrix)`` gives with their slots; zeros are left out. Blocks have ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for year, data in zip(b["year"].to_pylist(), b["data"], strict=True):
                for slot, v in step(year, np.frombuffer(data.as_buffer(), kind).reshape(width, -1)):
                    total[slot] = total[slot] + v if slot in total else np.asarray(v, np.float64)
        for slot, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slot, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["slot", "at", "v"])

    out: dict[int, dict[int, float]] = defaultdict(dict)
    for slot, at, v in blocks.mapInArrow(run, "slot int, at int, v double").groupBy("slot", "at").agg(F.sum("v")).collect():
        out[slot][at] = v
    return out


def _dense(found: dict[int, float], size: int) -> np.ndarray:
    v = np.zeros(size)
    v[list(found)] = list(found.values())
    return v


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of ``x``."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def _value(u: int) -> float:
    bits = u & ~(1 << 63) if u >> 63 else ~u & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def quantiles(blocks: DataFrame, width: int, values: Step, shares: list[float], between: bool = True) -> dict[int, list[float]]:
    """For each slot of ``values`` (NaN: not known) its exact quantiles, interpolated as ``F.percentile`` does, or the next lower value.

    Each pass counts the values by the next ``BITS`` bits of those that share the bits known so far of a wanted one, so that no task holds values.
    """
    known: dict[int, list[list[int]]] = {}  # slot: for each wanted rank its bits so far, and how many values lie below these
    ranks: dict[int, list[int]] = {}
    size = 1 << BITS
    for shift in range(64 - BITS, -1, -BITS):
        prefixes = {s: np.array(sorted({p for p, _ in wanted}), np.uint64) for s, wanted in known.items()}

        def step(year: int, m: np.ndarray, prefixes=prefixes, shift=shift) -> Iterator[tuple[int, np.ndarray]]:
            for slot, x in values(year, m):
                u = _ordered(x[~np.isnan(x)]) >> np.uint64(shift)
                here = prefixes.get(slot, np.zeros(1, np.uint64))
                above = u >> np.uint64(BITS)
                i = np.minimum(np.searchsorted(here, above), len(here) - 1)
                ok = here[i] == above
                yield slot, np.bincount(i[ok] * size + (u[ok] & np.uint64(size - 1)).astype(np.int64), minlength=len(here) * size)

        counts = summed(blocks, step, width)
        if not known:
            for slot, found in counts.items():
                n = int(sum(found.values()))
                places = [q * (n - 1) for q in shares]
                ranks[slot] = [int(f(p)) for p in places for f in (np.floor, np.ceil)]
                known[slot], prefixes[slot] = [[0, 0] for _ in ranks[slot]], np.zeros(1, np.uint64)
                ranks[slot].append(n)
        for slot, wanted in known.items():
            total = np.cumsum(_dense(counts[slot], len(prefixes[slot]) * size).reshape(-1, size), axis=1)
            for w, rank in zip(wanted, ranks[slot], strict=False):
                row = total[int(np.searchsorted(prefixes[slot], np.uint64(w[0])))]
                digit = int(np.searchsorted(row, rank - w[1], side="right"))
                w[0], w[1] = w[0] << BITS | digit, w[1] + int(row[digit - 1] if digit else 0)
    out = {}
    for slot, wanted in known.items():
        v, n = [_value(w[0]) for w in wanted], ranks[slot][-1]
        part = [q * (n - 1) % 1 if between else 0.0 for q in shares]
        out[slot] = [lo if p == 0 or lo == hi else (1 - p) * lo + p * hi for lo, hi, p in zip(v[::2], v[1::2], part, strict=True)]
    return out


def scales(blocks: DataFrame, width: int, at: list[int], x: list[str], cuts: list[int]) -> dict[int, Scale]:
    """As ``learn.scale``, exact medians, of each year ``cut`` from all years before it; ``at``: where the columns ``x`` lie in the blocks."""
    k = len(x)

    def values(year: int, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for c, cut in enumerate(cuts):
            if year < cut:
                yield from ((c * k + i, m[j]) for i, j in enumerate(at))

    found = quantiles(blocks, width, values, [0.5])
    medians = np.array([[found.get(c * k + i, [0.0])[0] for i in range(k)] for c in range(len(cuts))]).reshape(len(cuts), k)
    means = np.zeros((len(cuts), k))
    for power in (1, 2):

        def moments(year: int, m: np.ndarray, means=means, power=power) -> Iterator[tuple[int, np.ndarray]]:
            for c, cut in enumerate(cuts):
                if year < cut:
                    f = m[at]
                    f = np.where(np.isnan(f), medians[c][:, None], f) - means[c][:, None]
                    yield c, np.append((f**power).sum(axis=1), f.shape[1])

        got = summed(blocks, moments, width)
        sums = np.array([_dense(got[c], k + 1) for c in range(len(cuts))]).reshape(len(cuts), k + 1)
        average = sums[:, :k] / np.maximum(sums[:, k:], 1)
        means, deviations = (average, None) if power == 1 else (means, np.sqrt(average))
    return {cut: Scale(x, medians[c].tolist(), means[c].tolist(), deviations[c].tolist()) for c, cut in enumerate(cuts)}


def scaled(s: Scale, m: np.ndarray) -> np.ndarray:
    """The rows of ``m`` filled and scaled."""
    column = lambda v: np.array(v)[:, None]
    return (np.where(np.isnan(m), column(s.medians), m) - column(s.means)) / column([d or 1.0 for d in s.deviations])


def logits(blocks: DataFrame, width: int, rows: Callable[[int, np.ndarray], Iterator[tuple]], slots: list[int], penalties: np.ndarray, rounds: int = 50, tol: float = 1e-8) -> dict[int, np.ndarray]:
    """Ridge logistic models of all ``slots`` by Newton steps, each one pass for all models that still move.

    ``rows(year, matrix)`` gives slot, features (a row for each), target, weight and offset.
    """
    k = len(penalties)
    upper = np.triu_indices(k)
    beta, open_ = {s: np.zeros(k) for s in slots}, set(slots)
    for _ in range(rounds):

        def step(year: int, m: np.ndarray, beta=dict(beta), open_=frozenset(open_)) -> Iterator[tuple[int, np.ndarray]]:
            for slot, x, y, w, o in rows(year, m):
                if slot in open_:
                    p = 1 / (1 + np.exp(-(beta[slot] @ x + o)))
                    yield slot, np.concatenate([x @ (w * (y - p)), ((x * (w * p * (1 - p))) @ x.T)[upper]])

        got = summed(blocks, step, width)
        for s in list(open_):
            v = _dense(got[s], k + len(upper[0]))
            h = np.zeros((k, k))
            h[upper] = v[k:]
            move = np.linalg.solve(h + np.triu(h, 1).T + np.diag(penalties), v[:k] - penalties * beta[s])
            beta[s] = beta[s] + move
            if np.abs(move).max() < tol:
                open_.discard(s)
        if not open_:
            break
    return beta


def score(df: DataFrame, year: str, models: dict[int, tuple[Scale, np.ndarray]], x: list[str], out: str) -> DataFrame:
    """The rows of ``df`` whose year has a model, and its probability; ``beta`` may have one more coefficient than ``x``, the intercept."""
    kinds = f"{year} int, " + ", ".join(f"__{n} array<double>" for n in ("median", "mean", "deviation", "beta"))
    table = df.sparkSession.createDataFrame([(cut, s.medians, s.means, [d or 1.0 for d in s.deviations], beta.tolist()) for cut, (s, beta) in models.items()], kinds)
    z = [(F.coalesce(F.col(c).cast("double"), F.get("__median", F.lit(i))) - F.get("__mean", F.lit(i))) / F.get("__deviation", F.lit(i)) for i, c in enumerate(x)]
    eta = sum((c * F.get("__beta", F.lit(i)) for i, c in enumerate(z)), F.coalesce(F.get("__beta", F.lit(len(x))), F.lit(0.0)))
    return df.join(F.broadcast(table), year).withColumn(out, 1 / (1 + F.exp(-eta))).drop("__median", "__mean", "__deviation", "__beta")


def splines(x: np.ndarray, knots: list[float], degree: int = 2) -> np.ndarray:
    """As ``learn.spline_basis``: a row for each function."""
    full = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    c = np.clip(x, knots[0], knots[-1])
    last = max(i for i in range(len(full) - 1) if full[i] < full[i + 1])
    level = [((c >= a) & (c <= b if i == last else c < b)).astype(float) if a < b else np.zeros_like(c) for i, (a, b) in enumerate(zip(full, full[1:], strict=False))]
    for d in range(1, degree + 1):
        up = [(c - full[i]) / (full[i + d] - full[i]) * level[i] if full[i + d] > full[i] else 0.0 for i in range(len(level) - 1)]
        down = [(full[i + d + 1] - c) / (full[i + d + 1] - full[i + 1]) * level[i + 1] if full[i + d + 1] > full[i + 1] else 0.0 for i in range(len(level) - 1)]
        level = [np.broadcast_to(a + b, c.shape) for a, b in zip(up, down, strict=True)]
    return np.stack(level)


def _drawn(h: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree learns from, by a hash of their keys: the same however rows are dealt to tasks."""
    z = h ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)) < np.uint64(int(share * (1 << 32)))


#: feature, last bin that goes left (255: all go left) of each inner node in level order, and the value of each leaf.
Tree = tuple[list[int], list[int], list[float]]


def _turns(tree: Tree, x: np.ndarray, nodes: int) -> np.ndarray:
    """A number whose bit j says whether a row would go right at node j; ``x``: bins, a row for each feature."""
    code = np.zeros(x.shape[1], np.uint8)
    for j in range(nodes):
        code |= (x[tree[0][j]] > tree[1][j]).view(np.uint8) << np.uint8(j)
    return code


@lru_cache(maxsize=8)
def _places(depth: int) -> np.ndarray:
    """The node of level ``depth``, numbered from 0 in that level, that each number of ``_turns`` leads to."""
    code = np.arange(2 ** (2**depth - 1))
    node = np.zeros_like(code)
    for level in range(depth):
        node = node << 1 | code >> 2**level - 1 + node & 1
    return node


def margin(trees: list[Tree], x: np.ndarray, depth: int, rate: float) -> np.ndarray:
    """The sum of the trees; ``depth`` is 3 at most, so that a byte holds all turns."""
    out = np.zeros(x.shape[1])
    for t, tree in enumerate(trees):
        out += (np.array(tree[2]) * (rate if t else 1.0))[_places(depth)].take(_turns(tree, x, 2**depth - 1))
    return out


def binned(thresholds: list[list[float]], x: np.ndarray) -> np.ndarray:
    """Bin b: above b of the thresholds."""
    return np.stack([np.searchsorted(t, v, side="left").astype(np.uint8) for t, v in zip(thresholds, x, strict=True)])


def boosted(blocks: DataFrame, width: int, key: int, label: int, at: list[int], fills: dict[int, list[float]], trees: int = 30, depth: int = 3, rate: float = 0.1, share: float = 0.6, bins: int = 32, least: int = 40, seed: int = 7) -> dict[int, tuple[list[list[float]], list[Tree]]]:
    """Gradient-boosted trees (log loss) of each year in ``fills`` from all years before it: thresholds and trees.

    As ``GBTClassifier``: the first tree learns the labels as -1 and 1, later ones four times the label over 1 + exp(2 * label * margin), with
    ``rate``; a node tries the square root of the features; splits lower the variance most and leave ``least`` rows on both sides.
    Thresholds are exact quantiles. Rows go once to bins, and a pass settles one level of a tree of each year.
    """
    if depth > 3:
        raise ValueError("depth is 3 at most")
    k, cuts = len(at), sorted(fills)

    def values(year: int, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for c, cut in enumerate(cuts):
            if year < cut:
                yield from ((c * k + i, np.where(np.isnan(m[j]), fills[cut][i], m[j])) for i, j in enumerate(at))

    found = quantiles(blocks, width, values, [i / bins for i in range(1, bins)], between=False)
    thresholds = {cut: [sorted(set(found[c * k + i])) for i in range(k)] for c, cut in enumerate(cuts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for year, data in zip(b["year"].to_pylist(), b["data"], strict=True):
                m = np.frombuffer(data.as_buffer(), np.float64).reshape(width, -1)
                filled: dict[int, np.ndarray] = defaultdict(lambda: np.empty(0))
                filled.update(values(year, m))
                for c, cut in enumerate(cuts):
                    if year < cut:
                        x = binned(thresholds[cut], np.stack([filled[c * k + i] for i in range(k)]))
                        hashes = m[key].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        rows = np.vstack([x, (m[label] > 0).astype(np.uint8)[None], hashes.view(np.uint8).reshape(-1, 8).T])
                        yield pa.RecordBatch.from_arrays([pa.array([cut], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["year", "data"])

    small = written(blocks.mapInArrow(run, "year int, data binary"))
    models: dict[int, list[Tree]] = {cut: [] for cut in cuts}
    for t in range(trees):
        growing: dict[int, Tree] = {cut: ([0] * (2**depth - 1), [255] * (2**depth - 1), [0.0] * 2**depth) for cut in cuts}
        for level in range(depth):
            n = 2**level

            def step(cut: int, m: np.ndarray, models={c: list(v) for c, v in models.items()}, growing=dict(growing), level=level, n=n, t=t) -> Iterator[tuple[int, np.ndarray]]:
                drawn = np.flatnonzero(_drawn(np.ascontiguousarray(m[k + 1 :].T).view(np.uint64).ravel(), t, seed, share))
                x, y = m[:k, drawn], m[k, drawn] * 2.0 - 1
                r = 4 * y / (1 + np.exp(2 * y * margin(models[cut], x, depth, rate))) if t else y
                node = _places(level).take(_turns(growing[cut], x, n - 1)) * bins
                cells = [node + f for f in x]
                yield cut, np.concatenate([np.bincount(c, w, n * bins) for c in cells for w in (None, r)])

            got = summed(small, step, k + 9, np.uint8)
            for cut in cuts:
                h = _dense(got[cut], k * 2 * n * bins).reshape(k, 2, n, bins)
                for j in range(n):
                    _split(growing[cut], h[:, :, j], level, j, depth, least, np.random.default_rng([seed, cut, t, n + j]))
        for cut in cuts:
            models[cut].append(growing[cut])
    release(small)
    return {cut: (thresholds[cut], models[cut]) for cut in cuts}


def boosted_share(models: dict[int, tuple[list[list[float]], list[Tree]]], fills: dict[int, list[float]], depth: int = 3, rate: float = 0.1) -> Callable:
    """A function of the year's column and the features' columns: the probability that the year's trees give."""

    @F.pandas_udf("double")
    def share(*cols: pd.Series) -> pd.Series:
        years, x = cols[0].to_numpy(), np.stack([c.to_numpy(float) for c in cols[1:]])
        out = np.full(len(years), np.nan)
        for cut in np.unique(years).tolist():
            here = years == cut
            m = np.where(np.isnan(x[:, here]), np.array(fills[cut])[:, None], x[:, here])
            out[here] = 1 / (1 + np.exp(-2 * margin(models[cut][1], binned(models[cut][0], m), depth, rate)))
        return pd.Series(out)

    return share


def _split(tree: Tree, h: np.ndarray, level: int, j: int, depth: int, least: int, random: np.random.Generator) -> None:
    """Settles node ``j`` of a level by its counts and sums of each feature's bins, and sets the values of the leaves below it."""
    k = len(h)
    n, s = h[0].sum(axis=1)
    if not n or level and tree[1][2 ** (level - 1) - 1 + j // 2] == 255:
        return  # what is above is a leaf already
    left_n, left_s = np.cumsum(h[:, 0], axis=1), np.cumsum(h[:, 1], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + (s - left_s) ** 2 / (n - left_n) - s * s / n
    gain[(left_n < least) | (n - left_n < least)] = -1.0
    tried = random.choice(k, int(np.ceil(np.sqrt(k))), replace=False)
    f = int(tried[np.argmax(gain[tried].max(axis=1))])
    b = int(np.argmax(gain[f]))
    span = 2 ** (depth - level)
    leaves = slice(j * span, (j + 1) * span)
    if gain[f, b] <= 1e-12 * n:
        tree[2][leaves] = [s / n] * span
        return
    tree[0][2**level - 1 + j], tree[1][2**level - 1 + j] = f, b
    low, high = left_s[f, b] / left_n[f, b], (s - left_s[f, b]) / (n - left_n[f, b])
    tree[2][leaves] = [low] * (span // 2) + [high] * (span // 2)
