"""Token ids in compressed binary files: Re-Pair grammars by shard, with random access.

Texts (null: empty) become the ids of a tokenizer of the ``tokenizers`` library, as its own encoder gives them for the whole text without
special tokens added, and one end id each. Documents lie in ascending order of their ids (null: after all others; equal ids by a hash of
the text), in shards of whole documents that are closed at ``SHARD_TOKENS``; a longer text is a shard of its own.

A shard is coded by Re-Pair: pairs of neighbouring symbols that occur ``LEAST`` times are replaced by a new symbol, the most frequent
ones at once in each round, and again, until no pair is that frequent, the symbols of 16 bits are used up, or a round takes off less than
``GAIN`` of the symbols. No pair holds the end id, so that no symbol goes beyond its document. With the rules, a shard stores the
length of each one's expansion: :meth:`Shard.tokens` finds a place in a document by cumulative lengths and expands only the symbols there.

Layout of a shard, all numbers little-endian: ``PLGR``, then as 32-bit numbers the first symbol that is a rule, the rules, the bytes of a
symbol (2 or 4), the documents, the symbols; as a 64-bit number the tokens; the rules' left sides, right sides and lengths (32 bits
each); each document's id (64 bits), whether that is null (8 bits), its first symbol and its first token (64 bits each); the symbols.
Shards are rows of a Parquet table in the folder that driver and executors share, numbered by range and place in it, so that a task
that is run again writes the same ones.

Ranges are split by id and text hash, so that a repeated id is no hot key; copies of one row meet in one range. No other column is
read, whatever its name. A very long text is held in memory with its ids; empty tables give empty results.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.common import column, materialized, owner, table, texts

END, SHARD_TOKENS = 2, 1 << 21
#: A pair is replaced if it occurs so often; a round that takes off less than this share of the symbols is the last one.
LEAST, GAIN = 8, 1 / 50
MAGIC = b"PLGR"
#: Parts of texts whose ids a task keeps at hand, and characters of such a part.
HELD, HELD_CHARS = 300_000, 48
#: Shards whose tokens are summed in one task.
SUMMED = 4096

#: The normalizer and the splitting pattern of tokenizers whose ids can be taken word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over visible characters below U+0100 in lower case, where normal forms and classes are plain.
VISIBLE = re.compile("[!-~\xa1-\xff]*")
PLAIN = re.compile("[\t-\r -~\xa1-\xff]*")
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}\t-\r ]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Held(dict):
    """Values of ``make``, kept for the last ``HELD`` to twice as many different keys; long keys are made anew."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > HELD_CHARS:
            return value
        if len(self) >= HELD:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts as ids, packed in ``width`` bytes each.

    Where the tokenizer's steps never look across white space, texts of characters below U+0100 go to the model word by word, and what
    it says is kept. Other texts go by the parts between blanks and line breaks: parts with other characters through the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            steps = json.load(f)
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.first_rule, self.width = size, 2 if size < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [t["content"] for t in steps["added_tokens"]]
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_part = (steps["normalizer"] or {}).get("normalizers") == NORMALIZERS and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": PATTERN} and not split[1]["add_prefix_space"] and not any(re.search(r"\s", t) for t in self.special)
        # printable bytes stand for themselves, the others for characters from U+0100 on, in order
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.words, self.parts = Held(self._word), Held(self._part)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.tokenizer.model.tokenize(letters)])

    def _part(self, part: str) -> bytes:
        if VISIBLE.fullmatch(part) and not any(t in part for t in self.special):
            return self._plain(part)
        return self._whole(part)

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.by_part:
            return self._whole(text)
        if PLAIN.fullmatch(text) and not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def hashed(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return ((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519))) >> np.uint32(32 - bits)


def repair(ids: np.ndarray, first_rule: int, end: int, most: int, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that are left of ``ids`` (uint32), and the left and right sides of the rules, of which there are ``most`` at most."""
    s, left, right, bits = ids, [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], 20
    n = 0
    while n < most and len(s) > 1:
        place = hashed(s[:-1], s[1:], bits)
        # pairs in rare places of the table are rare themselves
        hot = (np.bincount(place, minlength=1 << bits) >= least)[place]
        hot &= (s[:-1] != end) & (s[1:] != end)
        at = np.flatnonzero(hot)
        pairs, times = np.unique((s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1], return_counts=True)
        pairs, times = pairs[times >= least], times[times >= least]
        best = np.argsort(-times, kind="stable")[: most - n]
        pairs = pairs[best]
        a, b = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        # one pair for each place of the table: of several the most frequent, the others may come next
        _, first = np.unique(hashed(a, b, bits), return_index=True)
        first.sort()
        a, b = a[first], b[first]
        if not len(a):
            break
        rule = np.full(1 << bits, -1, np.int32)
        rule[hashed(a, b, bits)] = np.arange(len(a), dtype=np.int32)
        found = rule[place[at]]
        fits = found >= 0
        fits[fits] = (a[found[fits]] == s[at[fits]]) & (b[found[fits]] == s[at[fits] + 1])
        at, found = at[fits], found[fits]
        # of matches that overlap in a row, every second one
        fresh = np.append(True, np.diff(at) > 1)
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at, found = at[since % 2 == 0], found[since % 2 == 0]
        # rules that overlaps have left too few of go
        used = np.bincount(found, minlength=len(a)) >= least
        new = np.cumsum(used) - 1
        at, found = at[used[found]], new[found[used[found]]]
        out = s.copy()
        out[at] = (first_rule + n + found).astype(np.uint32)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        before, s = len(s), out[keep]
        left.append(a[used])
        right.append(b[used])
        n += int(used.sum())
        if before - len(s) < gain * before:
            break
    return s, np.concatenate(left), np.concatenate(right)


def rule_lengths(left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """Tokens of each rule; a rule's sides come before it."""
    out = np.ones(first_rule + len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True), first_rule):
        out[i] = out[a] + out[b]
    return out[first_rule:]


def packed(docs: list[int | None], ids: list[np.ndarray], first_rule: int, end: int, width: int) -> bytes:
    """A shard of documents with their ids, each closed by ``end``."""
    tokens = np.concatenate([*(x for d in ids for x in (d, np.array([end])))]).astype(np.uint32)
    size = np.array([len(d) + 1 for d in ids], np.int64)
    symbols, left, right = repair(tokens, first_rule, end, (1 << (8 * min(width, 3))) - first_rule)
    lengths = rule_lengths(left, right, first_rule)
    first_token = np.cumsum(size) - size
    wide = np.where(symbols < first_rule, 1, lengths[np.maximum(symbols.astype(np.int64) - first_rule, 0)] if len(lengths) else 1)
    first_symbol = np.searchsorted(np.cumsum(wide) - wide, first_token)
    head = MAGIC + np.array([first_rule, len(left), width, len(docs), len(symbols)], "<u4").tobytes() + np.array([len(tokens)], "<u8").tobytes()
    sides = [left.astype("<u4"), right.astype("<u4"), lengths.astype("<u4")]
    owners = [np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), first_symbol.astype("<u8"), first_token.astype("<u8")]
    return b"".join([head, *(x.tobytes() for x in (*sides, *owners)), symbols.astype(f"<u{width}").tobytes()])


class Shard:
    """What a shard holds: ``docs``, ``first_token`` of each, and their tokens."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no shard")
        self.first_rule, rules, width, docs, symbols = np.frombuffer(data, "<u4", 5, 4).tolist()
        self.n_tokens = int(np.frombuffer(data, "<u8", 1, 24)[0])
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        ids, none = take("<i8", docs), take("u1", docs)
        self.docs = [None if x else i for i, x in zip(ids.tolist(), none.tolist(), strict=True)]
        self.first_symbol, self.first_token = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        # the expansions of all symbols, one after the other; a terminal is its own
        self._size = np.concatenate([np.ones(self.first_rule, np.int64), self.lengths])
        self._from = np.cumsum(self._size) - self._size
        flat = np.empty(int(self._size.sum()), np.uint32)
        flat[: self.first_rule] = np.arange(self.first_rule)
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.first_rule):
            k, m = int(self._from[i]), int(self._size[a])
            flat[k : k + m] = flat[self._from[a] : self._from[a] + m]
            flat[k + m : k + int(self._size[i])] = flat[self._from[b] : self._from[b] + self._size[b]]
        self._flat = flat

    def expanded(self, first: int, last: int) -> np.ndarray:
        """The tokens of symbols ``first`` to ``last``, which is left out."""
        s = self.symbols[first:last].astype(np.int64)
        n = self._size[s]
        return self._flat[np.repeat(self._from[s] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def tokens(self, doc: int, first: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` tokens (all, with the end id) of the ``doc``-th document, from its token ``first`` on."""
        stop = doc + 1 < len(self.docs)
        a, b = int(self.first_symbol[doc]), int(self.first_symbol[doc + 1]) if stop else len(self.symbols)
        ends = np.cumsum(self._size[self.symbols[a:b].astype(np.int64)])
        total = int(ends[-1])
        n = max(0, min(total - first, total if n is None else n))
        if not n:
            return np.empty(0, np.uint32)
        x, y = np.searchsorted(ends, [first, first + n - 1], side="right").tolist()
        skip = first - (int(ends[x - 1]) if x else 0)
        return self.expanded(a + x, a + y + 1)[skip : skip + n]

    def all_tokens(self) -> Iterator[np.ndarray]:
        """The tokens of each document, many documents expanded at a time."""
        ends = np.append(self.first_symbol[1:], len(self.symbols))
        size = np.append(self.first_token[1:], self.n_tokens) - self.first_token
        k = 0
        while k < len(self.docs):
            stop = max(k + 1, int(np.searchsorted(self.first_token, self.first_token[k] + (1 << 18))))
            ids = self.expanded(int(self.first_symbol[k]), int(ends[stop - 1]))
            for d in range(k, stop):
                yield ids[self.first_token[d] - self.first_token[k] :][: size[d]]
            k = stop


def write(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """shard (numbers in the order of documents), docs, tokens and data of each shard, as a written table."""
    path = path or tokenizer_path()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.coalesce(column(text), F.lit(""))
    rows = df.select(column(doc_id).cast("long").alias("doc"), owner(column(doc_id)).alias("own"), column(doc_id).cast("long").isNull().alias("none"), F.xxhash64(t).alias("tx"), t.alias("text"))
    rows = rows.repartitionByRange(parts, "own", "none", "tx").sortWithinPartitions("own", "none", "tx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, number = encoder(path), TaskContext.get().partitionId() << 32
        docs, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            data = packed(docs, ids, e.first_rule, end, e.width)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(docs)], pa.int64()), pa.array([size]), pa.array([data], pa.binary())], names=["shard", "docs", "tokens", "data"])

        for b in batches:
            for doc, x in zip(b["doc"].to_pylist(), texts(b["text"]), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(e.encode(x.decode("utf-8", "replace")), e.kind))
                size += len(ids[-1]) + 1
                if size >= shard_tokens:
                    yield shard()
                    docs, ids, size, number = [], [], 0, number + 1
        if docs:
            yield shard()

    return materialized(rows.select("doc", "text").mapInArrow(run, "shard long, docs long, tokens long, data binary"))


def starts(shards: DataFrame) -> DataFrame:
    """shard, before: the tokens of all shards before each one. ``SUMMED`` neighbouring shards are summed in a task, then their sums."""
    ranges = int(shards.count() // SUMMED) + 1
    s = shards.select("shard", "tokens").repartitionByRange(ranges, "shard").withColumn("range", F.spark_partition_id())
    s = materialized(s)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = s.groupBy("range").agg(F.sum("tokens").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return s.join(sums, "range").select("shard", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("before"))


def _read(shards: DataFrame, more: str, kind: pa.DataType, of: Callable[[np.ndarray], object], doc_id: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b["shard"].to_pylist(), b["data"], strict=True):
                s = Shard(data.as_buffer().to_pybytes())
                at, sizes, found = s.first_token, [], []
                for k, ids in enumerate(s.all_tokens()):
                    sizes.append(len(ids))
                    found.append(of(ids))
                    if len(found) == 4096 or k + 1 == len(s.docs):
                        lo = k + 1 - len(found)
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(found)), pa.array(s.docs[lo : k + 1], pa.int64()), pa.array(at[lo : k + 1]), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["shard", "doc", "at", "n_tokens", more])
                        sizes, found = [], []

    spark_kind = {pa.int64(): "long"}.get(kind, "array<long>")
    rows = shards.select("shard", "data").mapInArrow(run, f"shard long, doc long, at long, n_tokens long, {more} {spark_kind}")
    return rows.join(starts(shards), "shard").select(F.col("doc").alias(doc_id), (F.col("before") + F.col("at")).alias("start"), "n_tokens", more)


def read(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids: the documents of ``shards`` again."""
    return _read(shards, "ids", pa.list_(pa.int64()), lambda ids: ids.astype(np.int64), doc_id)


def checksums(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian numbers of 32 bits), read from ``shards``."""
    return _read(shards, "ids_crc32", pa.int64(), lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4")), doc_id)


def op11(spark, sf_dir: str) -> DataFrame:
    return checksums(write(table(spark, sf_dir, "documents")))
