"""Suffix-array dedup of bytes: every byte covered by a 200-byte string that also starts elsewhere is removed.

Texts (null: empty) are UTF-8 bytes; matches never cross documents, and strings are judged on the input. ``repeats`` finds the
stretches of 200 to 336 bytes whose anchors occur again; copies of one stretch are settled by counting. The others of one anchor go
to one task, which sorts their suffixes from the anchor on, and their reversed beginnings, by deep-shallow sorting: multikey quicksort
over 8-byte characters to a shallow depth, then a blind trie for each group that still shares its prefix. Neighbours' common prefixes
then tell, for each window around an anchor, whether an equal one exists. Whatever differs by a byte stays.

A text that is a run of one symbol has an anchor for each byte, so that its own row grows with its length and no other does.

Texts under 200 bytes, empty texts and empty tables pass unchanged; repeated rows, with the same id or without one, repeat each other
and go whole if they are long enough; other columns are kept. Bytes that remain may break a UTF-8 character, hence ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.llm.common import column, materialized, owner, release, table
from pairloom.llm.repeats import Units, candidates, covered, judged, keyed, mixed, runs, stretches

LENGTH, GRAM = 200, 64
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 16
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))

BYTES = Units(LENGTH, GRAM, lambda t: _BYTE[np.frombuffer(t, np.uint8)], lambda t: lambda a, b: t[a:b])


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be ``at`` or more."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int], at: int) -> tuple[list[int], list[int]]:
    """Order of ``members``, which share ``at`` bytes, and each one's common prefix with its predecessor.

    A node holds the depth where its strings part and a child for each byte there (-1: the string ends). A string goes down by these
    bytes alone, is compared with the leaf where it lands, and is hung in where they differ.
    """
    root: list | None = None
    branch = lambda s, d: s[d] if d < len(s) else -1
    for m in members:
        s = strings[m]
        if root is None:
            root = [None, [m]]
            continue
        path, node = [], root
        while node[0] is not None:
            path.append(node)
            node = node[1].get(branch(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        d = common(s, other, at)
        if d == len(s) == len(other):
            node[1].append(m)
            continue
        above, below = None, root
        for p in path:
            if p[0] >= d:
                break
            above, below = p, p[1][branch(s, p[0])]
        if below[0] == d:
            below[1][branch(s, d)] = [None, [m]]
        else:
            new = [d, {branch(other, d): below, branch(s, d): [None, [m]]}]
            if above is None:
                root = new
            else:
                above[1][branch(s, above[0])] = new
    order, shared, stack = [], [], [(root, at)]
    while stack:
        node, left = stack.pop()
        if node[0] is None:
            order += node[1]
            shared += [left] + [len(strings[node[1][0]])] * (len(node[1]) - 1)
        else:
            children = [node[1][k] for k in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])] + [(children[0], left)]
    return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of ``strings`` and each one's common prefix with its predecessor (the first: 0)."""
    n = len(strings)
    padded = np.zeros((n, SHALLOW // 8), np.uint64)
    for c in range(SHALLOW // 8):
        padded[:, c] = np.frombuffer(b"".join(s[8 * c : 8 * c + 8].ljust(8, b"\0") for s in strings), ">u8")
    order: list[int] = []
    shared: list[int] = []
    stack = [(np.arange(n), 0)]
    while stack:
        group, c = stack.pop()
        if c == padded.shape[1] or len(group) == 1:
            members = group.tolist()
            at = min(8 * c, min(len(strings[m]) for m in members))
            o, s = blind_trie(strings, members, at) if len(members) > 1 else (members, [0])
            s[0] = common(strings[order[-1]], strings[o[0]], 0) if order else 0
            order += o
            shared += s
            continue
        key = padded[group, c]
        pivot = key[len(key) // 2]
        less, more = key < pivot, key > pivot
        parts = [(group[less], c), (group[~(less | more)], c + 1), (group[more], c)]
        stack += [p for p in reversed(parts) if len(p[0])]
    return np.array(order, np.int64), np.array(shared, np.int64)


def repeated_windows(t: pa.Table) -> list[list[tuple[int, int]]]:
    """For each stretch (body, low, high, n) the ranges of windows that another stretch, or another place of it, holds as well."""
    seen: dict[tuple[int, ...], int] = {}
    rows = [i for i, k in enumerate(zip(*(t[c].to_pylist() for c in ("key", "head", "whole", "low")), strict=True)) if seen.setdefault(k, i) == i]
    out: list[list[tuple[int, int]]] = [[] for _ in range(t.num_rows)]
    body = t["body"].take(pa.array(rows)).to_pylist()
    low, high, n, place = (t[c].take(pa.array(rows)).to_numpy().astype(np.int64) for c in ("low", "high", "n", "place"))
    after = [b[h:] for b, h in zip(body, place.tolist(), strict=True)]
    before = [b[:h][::-1] for b, h in zip(body, place.tolist(), strict=True)]
    (order_a, shared_a), (order_b, shared_b) = deep_shallow(after), deep_shallow(before)
    widest = LENGTH - GRAM + 1
    hit = np.zeros((len(rows), widest), bool)
    class_a, class_b = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for d in range(widest):
        has = np.flatnonzero((low <= d) & (d <= high))
        if len(has) < 2:
            continue
        class_a[order_a] = np.cumsum(shared_a < LENGTH - d)
        class_b[order_b] = np.cumsum(shared_b < d)
        _, back, count = np.unique(class_a[has] * (len(rows) + 1) + class_b[has], return_inverse=True, return_counts=True)
        hit[has, d] = (count[back] > 1) | (n[has] > 1)
    for i, r in zip(rows, runs(hit), strict=True):
        out[i] = r
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, starts in zip(b["text"].cast(pa.large_binary()).to_pylist(), b["starts"].to_pylist(), strict=True):
            spans = covered(starts or [], LENGTH, len(text))
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if spans else text
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"first": x, "end": y} for x, y in spans]))
        rest = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPANS), strict=True)]
        keep = [c for c in b.schema.names if c not in ("text", "starts")]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *rest], names=[*keep, *_COLUMNS])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<first:long,end:long>>"


def dedup_bytes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "suffix_dedup") -> DataFrame:
    """``df`` plus a struct ``out`` of n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and spans (removed)."""
    rows = keyed(df, doc_id, text)
    places = candidates(rows, BYTES)
    each, open_ = stretches(places)
    spans = judged(rows, open_, BYTES, repeated_windows)
    full = F.array(F.struct(F.col("low"), F.col("high")))
    judged_ = each.select("head", "whole", "n", "low", "high").join(spans, ["head", "whole"], "left")
    verdict = materialized(judged_.select("head", "whole", F.when(F.col("n") > 1, full).otherwise(F.col("spans")).alias("spans")).filter("spans IS NOT NULL"))
    release(each, open_)
    hits = places.select("own", "tx", "pos", "head", "whole").join(verdict.hint("merge"), ["head", "whole"]).select("own", "tx", F.explode(F.transform("spans", lambda s: F.struct((F.col("pos") - s["high"]).alias("a"), (F.col("pos") - s["low"]).alias("b")))).alias("s"))
    starts = hits.groupBy("own", "tx").agg(F.collect_set("s").alias("starts"))
    return cut_out(df, doc_id, text, out, starts, _cut, _CUT, _COLUMNS)


def cut_out(df: DataFrame, doc_id: str, text: str, out: str, starts: DataFrame, cut, kinds: str, columns: list[str]) -> DataFrame:
    """``df`` plus the struct ``out`` that ``cut`` makes of each text and its ``starts``; the other columns travel in one struct."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {out}")
    t = F.coalesce(column(text), F.lit(""))
    others = [c for c in df.columns if c != text]
    row = F.struct(F.lit(0).alias("c"), *(column(c).alias(f"c{i}") for i, c in enumerate(others))).alias("row")
    whole = df.select(row, owner(column(doc_id)).alias("own"), F.xxhash64(t).alias("tx"), column(text).isNull().alias("none"), t.alias("text"))
    marked = whole.join(starts, ["own", "tx"], "left").select("row", "none", F.col("text").alias("copy"), "text", "starts")
    done = marked.mapInArrow(cut, StructType(marked.schema.fields[:3] + StructType.fromDDL(kinds).fields))
    back = {text: F.when(~F.col("none"), F.col("copy"))} | {c: F.col("row")[f"c{i}"] for i, c in enumerate(others)}
    return done.select(*(back[c].alias(c) for c in df.columns), F.struct(*columns).alias(out))


def op1(spark, sf_dir: str) -> DataFrame:
    d = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *(F.col(f"suffix_dedup.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))
