"""Fuzzy, date-tolerant, orientation-aware linkage of two-name records."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.tables import release, written


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit-parallel steps over ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return (full ^ v).bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """Normalised insert-delete similarity, 0 to 100."""
    a, b = a or "", b or ""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    return ratio(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())))


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best ``ratio`` of the shorter one with a stretch of the longer one that is at most as long, at its ends too."""
    a, b = sorted((a or "", b or ""), key=len)
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def either_ratio(a: str | None, b: str | None) -> float:
    """The greater of ``ratio`` and ``token_sort_ratio`` with hyphens as spaces."""
    return max(ratio(a, b), token_sort_ratio((a or "").replace("-", " "), (b or "").replace("-", " ")))


def _sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")), " ")


#: Scores of two names, and the strings of a name one of whose ``ratio`` a score is.
SCORES: dict[Callable[[str | None, str | None], float], Callable[[Column], list[Column]]] = {
    ratio: lambda c: [c],
    token_sort_ratio: lambda c: [_sorted(c)],
    either_ratio: lambda c: [c, _sorted(F.replace(c, F.lit("-"), F.lit(" ")))],
}


#: Strings of names (``SCORES``) in plain Python, for whole arrays of names.
_STRINGS: dict[Callable[[str | None, str | None], float], list[Callable[[str], str]]] = {
    ratio: [str],
    token_sort_ratio: [lambda s: " ".join(sorted(s.split()))],
    either_ratio: [str, lambda s: " ".join(sorted(s.replace("-", " ").split()))],
}
#: Keys of two strings together; strings that would have more are cut into more parts.
KEYS = 1000


def _codes(strings: Sequence[str], n: int) -> np.ndarray:
    """Code points, one row of ``n`` for each string; zeros after its end."""
    return np.array(strings, f"U{max(n, 1)}").view(np.uint32).reshape(len(strings), -1)[:, :n]


def _lists(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one column for each string, and lengths."""
    n = np.array([len(s) for s in strings], np.int64)
    codes = _codes(strings, int(n.max(initial=0)))
    return np.where(np.arange(codes.shape[1]) < n[:, None], codes, np.uint32(0xFFFFFFFF)).T.copy(), n


def ratios(a: Sequence[str], b: Sequence[str], i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """``ratio`` of each two strings (of ``a[i]`` and ``b[j]``, if these are given), all pairs side by side if no string has more than 63 characters."""
    i, j = (np.arange(len(a)), np.arange(len(b))) if i is None else (i, j)
    if not len(i):
        return np.empty(0)
    if max(len(s) for x in (a, b) for s in x) > 63:
        return np.array([ratio(a[k], b[o]) for k, o in zip(i, j, strict=True)], float)
    (x, m), (y, n) = _lists(a), _lists(b)
    x, m, y, n = x[:, i], m[i], y[:, j], n[j]
    one = np.uint64(1)
    full = (one << m.astype(np.uint64)) - one
    v = full.copy()
    for k, c in enumerate(y):
        at = np.zeros(len(m), np.uint64)
        for byte, bits in enumerate(np.packbits(x == c, axis=0, bitorder="little")):
            at |= bits.astype(np.uint64) << np.uint64(8 * byte)
        u = v & at
        v = np.where(k < n, (v + u | v - u) & full, v)
    return np.where(m + n > 0, 200.0 * np.bitwise_count(full ^ v) / np.maximum(m + n, 1), 100.0)


def _numbered(names: pd.Series) -> tuple[list[str], np.ndarray]:
    at = {s: k for k, s in enumerate(dict.fromkeys(names))}
    return list(at), np.array([at[s] for s in names], np.int64)


def _scores(score: Callable[[str | None, str | None], float], a: pd.Series, b: pd.Series) -> np.ndarray:
    """``score`` of each two names."""
    if score not in _STRINGS:
        return np.array([score(x, y) for x, y in zip(a, b, strict=True)], float)
    (x, i), (y, j) = _numbered(a), _numbered(b)
    return np.max([ratios([f(s) for s in x], [f(s) for s in y], i, j) for f in _STRINGS[score]], axis=0)


def _of_pairs(f: Callable[..., np.ndarray]):
    @F.pandas_udf("double")
    def run(*names: pd.Series) -> pd.Series:
        return pd.Series(f(*names), dtype=float)

    return run


def _of_rows(score: Callable[[str | None, str | None], float]):
    """Of two names of the one row and two of the other: the greater mean of both orders, and the best score of any two."""

    @F.pandas_udf("mean double, best double")
    def run(p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series) -> pd.DataFrame:
        pr, qs, ps, qr = (_scores(score, *two) for two in ((p, r), (q, s), (p, s), (q, r)))
        return pd.DataFrame({"mean": np.maximum(pr + qs, ps + qr) / 2, "best": np.max([pr, qs, ps, qr], axis=0)})

    return run


def _deletions(m: int, n: int, d: int) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """Keys that strings of m <= n characters, ``d`` insertions and deletions apart at most, have in common: a number and the places of
    characters, for the shorter one and for the longer one. See :func:`similar_names`."""
    extra = n - m
    most_p = (d - extra) // 2
    most_q = most_p + extra
    d = most_p + most_q

    def cut(h: int) -> Iterator[tuple[int, int, int, int, int, int, range]]:
        """Part, its begin and length, deletions from it and from a stretch, the stretch's length and begins."""
        t = d // h
        for i in range(h):
            begin, w = i * m // h, (i + 1) * m // h - i * m // h
            for more in [extra] if h == 1 else range(-t, t + 1):
                p = min((t - more) // 2, most_p, most_q - more, w)
                q, size = p + more, w + more
                if p < 0 or q < 0 or size > n:
                    continue
                first = range(1) if i == 0 else range(n - size, n - size + 1) if i == h - 1 else range(max(0, begin - most_p), min(n - size, begin + most_q) + 1)
                yield i, begin, w, p, q, size, first

    def count(h: int) -> tuple[bool, int]:
        """Whether some key is empty, and the number of keys."""
        found = list(cut(h))
        short = sum(math.comb(w, p) for w, p, _ in {(w, p, i) for i, _, w, p, *_ in found})
        return any(w == p for _, _, w, p, *_ in found), short + sum(math.comb(size, q) * len(first) for *_, q, size, first in found)

    choices = [(h, *count(h)) for h in range(1, min(d + 1, m) + 1)]
    choices = [(h, keys) for h, empty, keys in choices if not empty]
    if not choices:
        nothing = [(0, np.empty((1, 0), np.int64))]
        return nothing, nothing
    h = next((h for h, keys in choices if keys <= KEYS), min(choices, key=lambda c: c[1])[0])
    short, long = {}, []
    for i, begin, w, p, q, size, first in cut(h):
        number = i * (m + 1) + p + 1
        short[number] = begin + np.array(list(combinations(range(w), w - p)), np.int64)
        inner = np.array(list(combinations(range(size), size - q)), np.int64)
        long += [(number, start + inner) for start in first]
    return list(short.items()), long


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bags(codes: np.ndarray) -> np.ndarray:
    """A bit of 64 for each character and each time it stands there: strings whose bits differ in k places are k characters apart or more."""
    s = np.sort(codes, axis=1).astype(np.uint64)
    place = np.arange(s.shape[1])
    fresh = np.ones(s.shape, bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    time = (place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)).astype(np.uint64)
    return np.bitwise_or.reduce(np.uint64(1) << (_mixed(s * np.uint64(1_000_003) + time) >> np.uint64(58)), axis=1)


def similar_names(left: DataFrame, right: DataFrame, threshold: float, score: Callable[[str | None, str | None], float] = token_sort_ratio) -> DataFrame:
    """x, y: the names of ``left`` and of ``right`` (one column each, no nulls) whose score is ``threshold`` or more, as a written table.

    Strings of lengths m <= n with that ratio are ``d = (1 - threshold / 100) (m + n)`` insertions and deletions apart at most. Let the
    shorter one be cut into h parts; what they stand for in the longer one are h stretches, one after the other, so that some part and
    its stretch are d / h apart at most. Both then have a string in common from which so many characters are missing, and all such
    strings are keys that names meet by: with one part, keys are long and few strings meet that are not alike; with d + 1 parts, some part
    stands in the longer one as it is. h is the least with ``KEYS`` keys or less. A stretch of the first part begins where the string does, one of
    the last ends with it, and those between are shifted by as many characters as may be missing before. Of pairs that meet, those
    with too different characters (``_bags``) are dropped in the join. Where even parts of a character leave no key, all strings of two lengths meet.

    Joins are by sort and merge: exploded keys would pass for small tables, and be sent to the driver.
    """
    share = 1 - threshold / 100
    names = lambda df, out: df.toDF(out).distinct().select(out, F.posexplode(F.array(*SCORES[score](F.col(out)))).alias("kind", "s"))
    x, y = written(names(left, "x")), written(names(right, "y"))
    sx, sy = (written(df.select("kind", "s").distinct().withColumn("id", F.monotonically_increasing_id())) for df in (x, y))
    # as many rows as there are lengths
    lengths = [{(k, n) for k, n in df.select("kind", F.length("s")).distinct().collect()} for df in (sx, sy)]
    x_is_more = sx.count() > sy.count()

    def keys(df: DataFrame, others: set[tuple[int, int]], more: bool, name: str) -> DataFrame:
        side = 0 if name == "x" else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planned = lru_cache(maxsize=None)(_deletions)
            for batch in batches:
                rows = batch.to_pandas()
                for (kind, n), found in rows.groupby(["kind", rows["s"].str.len()]):
                    for start in range(0, len(found), 500):
                        part = found.iloc[start : start + 500]
                        codes = _codes(part["s"].tolist(), n)
                        bag, ids, codes = _bags(codes).view(np.int64), part["id"].to_numpy(), codes.astype(np.uint64)
                        for other in sorted(o for k, o in others if k == kind):
                            d = math.floor(share * (n + other) + 1e-9)
                            if d < abs(n - other):
                                continue
                            is_short = n < other or n == other and more
                            plan = planned(min(n, other), max(n, other), d)[0 if is_short else 1]
                            for number, places in plan:
                                first = hash((kind, min(n, other), max(n, other), number, side == is_short if n != other else 2)) & (1 << 63) - 1
                                key = np.full((len(part), len(places)), first, np.uint64)
                                for j in range(places.shape[1]):
                                    key = (key + codes[:, places[:, j]] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                                    key ^= key >> np.uint64(29)
                                c = places.shape[0]
                                yield pa.RecordBatch.from_arrays([pa.array(_mixed(key).view(np.int64).ravel()), pa.array(np.repeat(ids, c)), pa.array(np.full(len(part) * c, n, np.int32)), pa.array(np.repeat(bag, c))], names=out)

        out = ["key", f"{name}id", f"{name}n", f"{name}bag"]
        return df.select("kind", "s", "id").mapInArrow(run, f"key long, {name}id long, {name}n int, {name}bag long")

    apart = F.floor(share * (F.col("xn") + F.col("yn")) + 1e-9)
    met = keys(sx, lengths[1], x_is_more, "x").join(keys(sy, lengths[0], not x_is_more, "y").hint("merge"), "key")
    met = met.filter(F.bit_count(F.col("xbag").bitwiseXOR(F.col("ybag"))) <= apart).select("xid", "yid").distinct()
    met = met.join(sx.select(F.col("id").alias("xid"), "kind", F.col("s").alias("sx")).hint("merge"), "xid").join(sy.select(F.col("id").alias("yid"), F.col("s").alias("sy")).hint("merge"), "yid")
    met = met.filter(_of_pairs(lambda a, b: ratios(a.tolist(), b.tolist()))("sx", "sy") >= threshold - 1e-9).select("kind", "sx", "sy")
    met = met.join(x.withColumnRenamed("s", "sx").hint("merge"), ["kind", "sx"]).join(y.withColumnRenamed("s", "sy").hint("merge"), ["kind", "sy"]).select("x", "y").distinct()
    out = written(met.filter(_of_pairs(partial(_scores, score))("x", "y") >= threshold - 1e-9))
    release(x, y, sx, sy)
    return out


def _by_name(l: DataFrame, r: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, str]:  # noqa: E741
    """Rows of both sides, one for each of their names and, on the side with more different names, for each similar one of the other side; and the column in which they meet."""
    mine = l.select("*", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("x"))
    theirs = r.select("*", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("y"))
    names = near.agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).first()
    if names.y > names.x:
        return mine, theirs.join(near.hint("merge"), "y").drop("y"), "x"
    return mine.join(near.hint("merge"), "x").drop("x"), theirs, "y"


def link(left: DataFrame, right: DataFrame, left_id: str, right_id: str, when: str = "date", names: tuple[str, str] = ("n1", "n2"), days: int = 1, threshold: float = 80.0, penalty: float = 2.0, weak: float | None = None, strong: float = 92.0, score: Callable[[str | None, str | None], float] = token_sort_ratio, undated_from: Column | str | None = None, undated_penalty: float = 5.0) -> DataFrame:
    """left_id, right_id, score of the best right row within ``days`` whose names match in either order, ``penalty`` lost for each day apart.

    With ``weak``, a pair between it and the threshold counts as well if one name alone scores ``strong`` and no other right row of that
    left row has so strong a name. With ``undated_from``, left rows of that day or later also meet right rows without a date, at a loss
    of ``undated_penalty``.

    The mean of two names' scores is no greater than the better one. So some name of the one row has the threshold (or ``strong``, if that
    is less and ``weak`` is given) with some name of the other. Similar names are found first, among different names and whatever the
    dates; rows meet by date and similar names, and are scored. Work on a date follows its rows and the similar names in them, not all
    pairs. Then scores take the best, ties to the least right id, one right row for each left row and back.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    l = left.select(F.col(left_id).alias("__l"), text(names[0]).alias("a1"), text(names[1]).alias("a2"), F.col(when).alias("__d"))  # noqa: E741
    r = right.select(F.col(right_id).alias("__r"), text(names[0]).alias("b1"), text(names[1]).alias("b2"), F.col(when).alias("__d"))
    either = lambda df, one, two, out: df.select(F.explode(F.array(one, two)).alias(out))
    near = similar_names(either(l, "a1", "a2", "x"), either(r, "b1", "b2", "y"), threshold if weak is None else min(threshold, strong), score)
    mine, theirs, name = _by_name(l, r, near)
    # the days around a right row lie in two stretches of that many days at most, and a left row in one
    stretch = lambda day: F.floor(day / (2 * days + 1))
    dated = theirs.select("__r", "b1", "b2", name, F.unix_date(F.to_date("__d")).alias("__e"))
    dated = dated.select("*", F.explode(F.array_distinct(F.array(stretch(F.col("__e") - days), stretch(F.col("__e") + days)))).alias("__s"))
    apart = F.abs(F.col("__f") - F.col("__e"))
    pairs = mine.withColumn("__f", F.unix_date(F.to_date("__d"))).withColumn("__s", stretch(F.col("__f"))).join(dated.hint("merge"), ["__s", name]).filter(apart <= days)
    pairs = pairs.select("__l", "a1", "a2", "__r", "b1", "b2", (penalty * apart).alias("loss"))
    if undated_from is not None:
        free = theirs.filter("__d IS NULL").drop("__d").hint("merge")
        pairs = pairs.unionByName(mine.filter(F.col("__d") >= (F.to_date(F.lit(undated_from)) if isinstance(undated_from, str) else undated_from)).join(free, name).select("__l", "a1", "a2", "__r", "b1", "b2", F.lit(float(undated_penalty)).alias("loss")))
    s = pairs.distinct().withColumn("__v", _of_rows(score)("a1", "a2", "b1", "b2")).select("__l", "__r", (F.col("__v.mean") - F.col("loss")).alias("score"), F.col("__v.best").alias("best"))
    if weak is None:
        s = s.select("__l", "__r", "score").filter(F.col("score") >= threshold)
    else:
        s = s.filter(F.col("score") >= weak).withColumn("strong", F.col("best") >= strong)
        alone = F.col("strong") & (F.sum(F.col("strong").cast("int")).over(Window.partitionBy("__l")) == 1)
        s = s.withColumn("ok", (F.col("score") >= threshold) | alone).filter("ok").select("__l", "__r", "score")
    best = lambda df, k, o: df.withColumn("__n", F.row_number().over(Window.partitionBy(k).orderBy(F.col("score").desc(), o))).filter("__n = 1").drop("__n")
    return best(best(s, "__l", "__r"), "__r", "__l").select(F.col("__l").alias(left_id), F.col("__r").alias(right_id), "score")


def vote(links: DataFrame, entity: str, candidate: str, score: str = "score") -> DataFrame:
    """For each entity the candidate with the greatest sum of scores (ties: the least)."""
    total = links.groupBy(entity, candidate).agg(F.sum(score).alias("votes"))
    w = Window.partitionBy(entity).orderBy(F.col("votes").desc(), candidate)
    return total.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def either_link(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """``rows`` plus ``value``: of ``first`` by ``key``, else of ``second`` by ``fallback``; both tables have one row for each key."""
    a = first.select(key, F.col(value).alias("__first"))
    b = second.select(fallback, F.col(value).alias("__second"))
    return rows.join(a, key, "left").join(b, fallback, "left").withColumn(value, F.coalesce("__first", "__second")).drop("__first", "__second")
