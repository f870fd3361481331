"""SentencePiece encoding and decoding as a relational lattice.

A text (null: empty) gets a leading space, spaces become ``▁``, and it is cut into fragments at places that no piece of the
vocabulary spans, so that the best path of a text is the best paths of its fragments one after the other. Substrings of a fragment are
exploded, up to the longest piece that begins with the same four characters, and equi-joined to the piece table (bounded, checked,
broadcast); the edges of a fragment are grouped, and a fold over them in order of their ends keeps the best score for each
position: Viterbi over the sum of piece scores, ties going to the longer last piece. All fragments of a bucket take a step at a time,
as arrays; what lies behind the first ``LONG`` characters, 100,000 letters and more, is folded for one at a time. Characters that no piece
covers cost the least score minus 10 and become byte pieces. Long fragments are exploded in parts of ``PART`` starts.

Texts are dealt once, compressed, to blocks of about ``BLOCK_BYTES``, whose number follows the input. ``REGION`` blocks form a region,
and a region's different fragments are dealt to buckets: packed words go out for each block and bucket, each different word of a
bucket is encoded once, and the pieces of the words go back in the same order, without the words. So shuffles hold the texts once and
little else, and neither a block nor a bucket grows with the input.

Repeated rows are encoded alike, empty texts give no pieces, empty tables give empty results, and other columns are not touched: the
result has ``key`` and the pieces only, whatever the names of the other columns. Null keys are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairloom.llm.common import column, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
#: Blocks whose fragments are encoded together, and buckets that they are dealt to.
REGION, BUCKETS = 128, 128
#: More pieces than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_PIECES = 1_000_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Texts of a block that are glued at a time, to bound memory.
TEXTS_AT_ONCE = 128
#: Bytes of text that a task holds before it deals them.
PACK_BYTES = 16 << 20
LETTERS = r"[\p{L}\p{M}]"
#: Starts of a fragment that are exploded from one row; characters of fragments that are folded side by side.
PART, LONG = 1024, 200
#: From here on an edge's code is a character without a piece.
UNKNOWN = 1 << 22


@lru_cache(maxsize=4)
def read_model(path: str = MODEL) -> tuple[list[tuple[str, int, float]], list[int], list[str]]:
    """Normal pieces (piece, id, score), the ids of the 256 byte pieces, and the hexadecimal UTF-8 bytes that each id stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    names = [model.id_to_piece(i) for i in ids]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    hexes = ["" if special[i] else names[i].replace(MARK, " ").encode().hex().upper() for i in ids]
    for b, i in enumerate(byte_ids):
        if model.is_byte(i):
            hexes[i] = f"{b:02X}"
    return [(names[i], i, model.get_score(i)) for i in ids if not special[i]], byte_ids, hexes


def spans_words(pieces: list[str]) -> bool:
    """Whether a piece holds a mark behind another character, so that texts can't be cut at spaces."""
    return any(MARK in p.lstrip(MARK) for p in pieces)


def fragment_pattern(pieces: list[str]) -> str:
    """A pattern whose matches tile a text and that cuts only where no piece reaches across."""
    letter = lambda c: unicodedata.category(c)[0] in "LM"
    across = any(letter(a) != letter(b) for p in pieces for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:], strict=False))
    if spans_words(pieces):
        return r"(?s).+"
    return rf"(?s){MARK}*[^{MARK}]+|{MARK}+" if across else rf"{MARK}*{LETTERS}+|{MARK}*[^{MARK}\p{{L}}\p{{M}}]+|{MARK}+"


def fragments(text: Column, pattern: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    marked = F.when(t == "", t).otherwise(F.translate(F.concat(F.lit(" "), t), " ", MARK))
    return F.regexp_extract_all(marked, F.lit(pattern), F.lit(0))


def lattice_edges(words: DataFrame, model: str = MODEL, keys: tuple[str, ...] = ("word",)) -> DataFrame:
    """``keys`` (distinct, with ``word``, not empty) and ``edges``, in any order: one for each piece at each place of a word, and for each character."""
    import pandas as pd  # on the driver only: the tasks' processes do without it

    spark = words.sparkSession
    pieces, _, _ = read_model(model)
    longest = max(len(p) for p, _, _ in pieces)
    reach: dict[str, int] = {}
    for p, _, _ in pieces:
        if len(p) > 3:
            reach[p[:4]] = max(len(p), reach.get(p[:4], 0))
    vocabulary = spark.createDataFrame(pd.DataFrame([p[:2] for p in pieces], columns=["__sub", "id"]), "__sub string, id int")
    beginnings = spark.createDataFrame(pd.DataFrame(list(reach.items()) or [("", 0)], columns=["__four", "reach"]), "__four string, reach int")
    if len(pieces) <= MAX_BROADCAST_PIECES:
        vocabulary, beginnings = F.broadcast(vocabulary), F.broadcast(beginnings)
    n_chars = F.length("word")
    part = F.col("k") * PART
    parts = words.select(*keys, "word", F.explode(F.sequence(F.lit(0), F.floor((n_chars - 1) / PART).cast("int"))).alias("k"))
    parts = parts.select(*keys, "k", F.col("word").substr(part + 1, F.lit(PART + longest - 1)).alias("part"), F.least(F.lit(PART), n_chars - part).alias("own"))
    at = parts.select(*keys, "k", "part", F.explode(F.sequence(F.lit(1), "own")).alias("s"))
    at = at.select(*keys, (part + F.col("s") - 1).alias("b"), F.col("part").substr(F.col("s"), F.lit(longest)).alias("w"))
    at = at.join(beginnings, at["w"].substr(1, 4) == F.col("__four"), "left")
    spans = at.select(*keys, "b", "w", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(3)), F.length("w")))).alias("n"))
    subs = spans.select(*keys, "b", "n", F.col("w").substr(F.lit(1), F.col("n")).alias("__sub"))
    edges = subs.join(vocabulary, "__sub", "left").filter("id IS NOT NULL OR n = 1")
    # an edge is one number: its end, its length (longer ones first) and its piece or character
    code = F.coalesce(F.col("id"), F.ascii("__sub") + UNKNOWN).cast("long")
    edge = F.shiftleft((F.col("b") + F.col("n")).cast("long"), 32).bitwiseOR(F.shiftleft((255 - F.col("n")).cast("long"), 24)).bitwiseOR(code)
    return edges.groupBy(*keys).agg(F.collect_list(edge).alias("edges"))


@lru_cache(maxsize=4)
def _scores(model: str) -> tuple[np.ndarray, float, np.ndarray]:
    """Scores by id, the score of a character without a piece, and the ids of the 256 byte pieces."""
    pieces, byte_ids, _ = read_model(model)
    unknown = min(s for _, _, s in pieces) - UNKNOWN_PENALTY
    scores = np.full(max(i for _, i, _ in pieces) + 1, unknown)
    scores[[i for _, i, _ in pieces]] = [s for _, _, s in pieces]
    return scores, unknown, np.array(byte_ids, np.int32)


def best_paths(lattice: pa.Table, model: str = MODEL) -> tuple[pa.ListArray, int]:
    """The pieces on the best path of each word, in order of ``__nth``, from ``edges``; and how many words there are."""
    lists = lattice["edges"].combine_chunks()
    nth, edges = np.repeat(lattice["__nth"].to_numpy(), lists.value_lengths()), np.asarray(lists.flatten())
    if not len(nth):
        return _lists(pa.array([], pa.int32()), np.zeros(1, np.int64)), 0
    scores, unknown, byte_ids = _scores(model)
    # by ends, then words, longer ones first; a bucket's characters fit into far fewer bits than 55
    order = np.argsort(edges >> 32 << int(nth.max()).bit_length() + 8 | nth.astype(np.int64) << 8 | edges >> 24 & 255)
    nth, edges = nth[order], edges[order]
    end, length, code = edges >> 32, 255 - (edges >> 24 & 255), edges & 0xFFFFFF
    gain = np.where(code < UNKNOWN, scores[np.minimum(code, len(scores) - 1)], unknown)
    sizes = np.zeros(int(nth.max()) + 1, np.int64)
    sizes[nth] = end  # the last one stays
    # a node for each position of each word, from 0
    roots, n_nodes = _ends(sizes + 1)[:-1], int((sizes + 1).sum())
    to = roots[nth] + end
    best, back = np.zeros(n_nodes), np.zeros(n_nodes, np.int64)
    cuts = np.append(np.flatnonzero(np.diff(end[: np.searchsorted(end, LONG, "right")], prepend=0)), np.searchsorted(end, LONG, "right")).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        nodes = to[i:j]
        score = best[nodes - length[i:j]] + gain[i:j]
        new = np.diff(nodes, prepend=-1) > 0
        starts = np.flatnonzero(new)
        top = np.maximum.reduceat(score, starts)
        group = np.cumsum(new) - 1
        hits = np.flatnonzero(score == top[group])
        hits = hits[np.diff(group[hits], prepend=-1) > 0]
        best[nodes[starts]], back[nodes[starts]] = top, hits + i
    late = np.arange(cuts[-1], len(end))
    late = late[np.argsort(nth[late], kind="stable")]
    for ks in np.split(late, np.flatnonzero(np.diff(nth[late])) + 1) if len(late) else []:
        root = int(roots[nth[ks[0]]])
        known, ways = best[root : root + LONG + 1].tolist(), []
        for k, e, n, g in zip(ks.tolist(), end[ks].tolist(), length[ks].tolist(), gain[ks].tolist(), strict=True):
            score = known[e - n] + g
            if e == len(known):
                known.append(score)
                ways.append(k)
            elif score > known[e]:
                known[e], ways[-1] = score, k
        back[root + LONG + 1 : root + LONG + 1 + len(ways)] = ways
    taken, now, left = np.zeros(len(edges), bool), roots + sizes, np.flatnonzero(sizes)
    while len(left):
        if len(left) <= 8:  # long words
            for w in left.tolist():
                node, root = int(now[w]), int(roots[w])
                while node > root:
                    k = int(back[node])
                    taken[k] = True
                    node -= int(length[k])
            break
        ways = back[now[left]]
        taken[ways] = True
        now[left] -= length[ways]
        left = left[now[left] > roots[left]]
    taken = np.flatnonzero(taken)
    taken = taken[np.argsort(nth[taken], kind="stable")]
    code, nth = code[taken], nth[taken]
    # characters without a piece are spelled in bytes
    odd = code >= UNKNOWN
    points = code[odd] - UNKNOWN
    n = np.ones(len(code), np.int64)
    n[odd] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ids, spelled = np.repeat(code, n).astype(np.int32), np.repeat(odd, n)
    ids[spelled] = byte_ids[np.frombuffer("".join(map(chr, points.tolist())).encode(errors="surrogatepass"), np.uint8)]
    return _lists(pa.array(ids), _ends(np.bincount(nth, n, len(sizes)).astype(np.int64))), int((sizes > 0).sum())


class Cut:
    """Texts as units (a run of spaces and what follows up to the next one, without the first space) and units as fragments.

    Each text and its leading space is a row of units, and no fragment reaches from one unit to the next, so that whatever is known of
    the different units of a block is known of its texts.
    """

    def __init__(self, model: str):
        import regex

        pieces = [p for p, _, _ in read_model(model)[0]]
        self.whole = spans_words(pieces)
        self._find = regex.compile(fragment_pattern(pieces)).findall
        self._runs = re.compile(" +[^ ]*").findall

    def units(self, text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, " ")
        if not text or self.whole:
            return [text] if text else []
        return [u[1:] for u in self._runs(" " + text)] if text[0] == " " or "  " in text else text.split(" ")

    def fragments(self, units: Iterable[str]) -> tuple[list[str], list[str]]:
        """``units`` in another order, and their fragments in a row; those that begin with a mark are the first of their unit."""
        if self.whole:
            return list(units), [MARK + u.replace(" ", MARK) for u in units]
        letters, blank, rest = [], [], []
        for u in units:
            (letters if u.isalpha() else rest if u.strip(" ") else blank).append(u)
        found = self._find((" " + " ".join(rest)).replace(" ", MARK)) if rest else []
        return letters + rest + blank, [MARK + u for u in letters] + found + [MARK * (len(u) + 1) for u in blank]

    def buckets(self, fragments: list[str], n: int) -> dict[int, list[str]]:
        """Different fragments by bucket, in an order of their own, whatever the order in which they come."""
        words = list(set(fragments))
        crc = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.int64, len(words))
        of = crc % n
        order = np.argsort(of << 32 | crc)
        crc, of = crc[order], of[order]
        placed = list(map(words.__getitem__, order.tolist()))
        for i in np.flatnonzero(np.diff(crc) == 0).tolist()[::-1]:  # a run of equal ones is sorted from its end on
            j = i + int((crc[i : i + 100] == crc[i]).sum())
            placed[i:j] = sorted(placed[i:j])
        cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist() + [len(words)]
        return {int(of[i]): placed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)}


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _expanded(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the texts that a stretch of the input sends to a block: their keys, their sizes in bytes and all of them compressed."""

    def packs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        t = t.take(pa.array(np.argsort(t["__block"].to_numpy(), kind="stable")))
        blocks = t["__block"].to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
        data = t["__text"].combine_chunks().cast(pa.large_binary()).to_pylist()
        offsets = pa.array(cuts, pa.int32())
        keys = pa.ListArray.from_arrays(offsets, t["__key"].combine_chunks())
        sizes = pa.ListArray.from_arrays(offsets, pa.array([len(x) for x in data], pa.int32()))
        packed = pa.array([_squeezed(b"".join(data[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]], pa.int32()), keys, sizes, packed], names=["__block", "__keys", "__sizes", "__packed"])

    held, size = [], 0
    for b in batches:
        for start in range(0, b.num_rows, TEXTS_AT_ONCE):
            part = b.slice(start, TEXTS_AT_ONCE)
            held.append(part)
            size += part["__text"].nbytes
            if size >= PACK_BYTES:
                yield packs(held)
                held, size = [], 0
    if held:
        yield packs(held)
    pa.default_memory_pool().release_unused()


def _unpacked(sizes: list[int], packed: bytes) -> Iterator[list[str]]:
    """The texts of one pack, some at a time."""
    data, at = _expanded(packed, sum(sizes)), 0
    for start in range(0, len(sizes), TEXTS_AT_ONCE):
        out = []
        for n in sizes[start : start + TEXTS_AT_ONCE]:
            out.append(data[at : at + n].decode())
            at += n
        yield out


def _words_of_blocks(model: str, buckets: int):
    """The different fragments of each block, packed by bucket; a block lies in one task, which holds its units as a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Cut(model), {}
        for b in batches:
            for i in range(b.num_rows):
                units = seen.setdefault(b["__block"][i].as_py(), set())
                for texts in _unpacked(b["__sizes"][i].as_py(), b["__packed"][i].as_py()):
                    units.update(*map(cut.units, texts))
        for block in list(seen):
            found = cut.buckets(cut.fragments(seen.pop(block))[1], buckets)
            data = [" ".join(words).encode() for words in found.values()]
            first = block // REGION * buckets
            columns = (pa.array([block] * len(data), pa.int32()), pa.array([first + k for k in found], pa.int32()), pa.array(map(len, data), pa.int32()), pa.array(map(_squeezed, data), pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["__block", "__bucket", "__size", "__words"])
        pa.default_memory_pool().release_unused()

    return run


def _unpacked_words(words: bytes, size: int) -> list[str]:
    """No fragment holds a space."""
    return _expanded(words, size).decode().split(" ")


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each bucket, numbered in their order."""
    seen: dict[int, set[str]] = {}
    for b in batches:
        for bucket, size, words in zip(*(b[c].to_pylist() for c in ("__bucket", "__size", "__words")), strict=True):
            seen.setdefault(bucket, set()).update(_unpacked_words(words, size))
    for bucket in list(seen):
        words = sorted(seen.pop(bucket))
        t = pa.table({"__of": pa.array(np.full(len(words), bucket, np.int32)), "__nth": pa.array(np.arange(len(words), dtype=np.int32)), "word": pa.array(words, pa.string())})
        yield from t.to_batches(max_chunksize=20_000)
    pa.default_memory_pool().release_unused()


def _answers(model: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each pack of words their pieces in the same order: how many each has, and all of them, compressed."""

    def run(packs: pa.Table, lattice: pa.Table) -> pa.Table:
        words = [_unpacked_words(w, n) for w, n in zip(packs["__words"].to_pylist(), packs["__size"].to_pylist(), strict=True)]
        nth = {w: i for i, w in enumerate(sorted(set().union(*words)))}
        paths, n_paths = best_paths(lattice, model)
        if len(nth) != n_paths:
            raise ValueError(f"{len(nth)} words, but {n_paths} paths")
        counts, sizes, data = [], [], []
        for ws in words:
            got = paths.take(pa.array(np.fromiter(map(nth.__getitem__, ws), np.int64, len(ws))))
            both = np.concatenate([np.asarray(got.value_lengths()), np.asarray(got.flatten())]).astype(np.int32)
            # bytes of equal weight lie together, which compresses well
            raw = np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()
            counts.append(len(ws))
            sizes.append(len(raw))
            data.append(_squeezed(raw))
        pa.default_memory_pool().release_unused()
        return pa.table({"__for": packs["__block"], "__bucket": packs["__bucket"], "__count": pa.array(counts, pa.int32()), "__size": pa.array(sizes, pa.int32()), "__ids": pa.array(data, pa.binary())})

    return run


def _piece_bytes(model: str) -> pa.Array:
    return pa.array([bytes.fromhex(h) for h in read_model(model)[2]], pa.large_binary())


def _texts(pieces: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """The texts of lists of ``ids`` that end at ``ends``: the bytes of all pieces lie in a row, and each text is a stretch of them."""
    taken = pieces.take(ids)
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends].tolist()
    data = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b""
    return pa.array([data[x + 1 : y].decode(errors="replace") for x, y in zip(at, at[1:], strict=False)], pa.string())


def _lists(items: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _assemble(model: str, buckets: int, and_decode: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pieces of a block's texts: of its different fragments, then of its different units, then of its texts, by taking lists at once."""

    def glue(texts: pa.Table, answers: pa.Table) -> pa.Table:
        cut, pieces = Cut(model), _piece_bytes(model) if and_decode else None
        packs = list(zip(texts["__keys"], texts["__sizes"].to_pylist(), texts["__packed"].to_pylist(), strict=True))
        numbers: dict[str, int] = {}
        parts = []  # the numbers of all units of some texts, and where each text ends
        for _, sizes, packed in packs:
            for part in map(list, map(partial(map, cut.units), _unpacked(sizes, packed))):
                units = list(chain.from_iterable(part))
                for u in set(units).difference(numbers):
                    numbers[u] = len(numbers)
                parts.append((np.fromiter(map(numbers.__getitem__, units), np.int32, len(units)), _ends(np.fromiter(map(len, part), np.int64, len(part)))))
        order, fragments = cut.fragments(numbers)
        given = {b: (n, s, x) for b, n, s, x in zip(*(answers[c].to_pylist() for c in ("__bucket", "__count", "__size", "__ids")), strict=True)}
        first = texts["__block"][0].as_py() // REGION * buckets
        words, lengths, ids = [], [], []
        for k, ws in cut.buckets(fragments, buckets).items():
            n, size, data = given[first + k]
            if n != len(ws):
                raise ValueError(f"{len(ws)} words, but {n} answers")
            both = np.ascontiguousarray(np.frombuffer(_expanded(data, size), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
            words += ws
            lengths.append(both[:n])
            ids.append(both[n:])
        row = {w: i for i, w in enumerate(words)}
        none = [np.empty(0, np.int32)]
        lists = _lists(pa.array(np.concatenate(ids + none)), _ends(np.concatenate(lengths + none)))
        flat = np.fromiter(map(row.__getitem__, fragments), np.int64, len(fragments))
        # where a fragment begins with a mark, a unit begins
        starts = np.flatnonzero(np.fromiter((w[0] == MARK for w in fragments), bool, len(fragments)))
        ends = _ends(np.asarray(lists.value_lengths())[flat])
        bounds = np.append(ends[starts], ends[-1])
        lists = _lists(lists.take(pa.array(flat)).flatten(), bounds)
        size = np.diff(bounds)
        as_bytes = None
        if pieces is not None:
            taken = pieces.take(lists.values)
            at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][bounds]
            as_bytes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), taken.buffers()[2]])
        place = np.empty(len(order), np.int64)
        place[np.fromiter(map(numbers.__getitem__, order), np.int64, len(order))] = np.arange(len(order))
        del row, words, order, numbers, fragments, flat, given
        out, done = [], iter(parts)
        for keys, sizes, _ in packs:
            for at in range(0, len(sizes), TEXTS_AT_ONCE):
                units, marks = next(done)
                flat = place[units]
                found = {"__key": keys.values.slice(at, len(marks) - 1), "ids": _lists(lists.take(pa.array(flat)).flatten(), _ends(size[flat])[marks])}
                out.append(pa.table(found if pieces is None else found | {"decoded": _texts(as_bytes, pa.array(flat), marks)}))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return glue


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, block_bytes: int = BLOCK_BYTES, and_decode: bool = False) -> DataFrame:
    """``key`` and ``ids`` array<int> of each row; with ``and_decode`` also ``decoded``, the text of the pieces."""
    text_, key_ = column(text), column(key)
    size = df.agg(F.sum(F.octet_length(text_))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    buckets = min(BUCKETS, 4 * n)
    total = math.ceil(n / REGION) * buckets
    t = F.coalesce(text_, F.lit(""))
    key_type = df.schema[key].dataType.simpleString()
    # equal rows go to one block, but what shares a key or a length does not
    texts = df.select(key_.alias("__key"), t.alias("__text"), F.pmod(F.xxhash64(key_, t), F.lit(n)).cast("int").alias("__block"))
    dealt = texts.mapInArrow(_pack, f"__block int, __keys array<{key_type}>, __sizes array<int>, __packed binary").repartition(n, "__block")
    words = dealt.mapInArrow(_words_of_blocks(model, buckets), "__block int, __bucket int, __size int, __words binary").repartition(total, "__bucket")
    lattice = lattice_edges(words.mapInArrow(_different, "__of int, __nth int, word string").repartition(total, "__of"), model, ("__of", "__nth"))
    answers = words.groupBy("__bucket").cogroup(lattice.groupBy("__of")).applyInArrow(_answers(model), "__for int, __bucket int, __count int, __size int, __ids binary")
    glued = dealt.groupBy("__block").cogroup(answers.groupBy("__for")).applyInArrow(
        _assemble(model, buckets, and_decode), f"__key {key_type}, ids array<int>" + ", decoded string" * and_decode
    )
    return glued.withColumnRenamed("__key", key)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of ``ids``: bytes of the pieces one after the other, without the leading space that encoding adds."""
    _, _, hexes = read_model(model)
    pieces = F.split(F.lit(",".join(hexes)), ",")
    return F.substring(F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8"), 2, 2**31 - 1)


def decoded(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` plus ``out``, the text of ``ids``, put together by Arrow; as ``decode``, for tables."""
    pieces = _piece_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(start, TEXTS_AT_ONCE)
                ends = np.concatenate([[0], np.cumsum(np.asarray(part[ids].value_lengths().fill_null(0)))])
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(pieces, part[ids].flatten(), ends)], names=[*part.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = encode(docs, and_decode=True)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: doc_id, the pieces and the text that they decode to."""
    e = encode(docs, and_decode=True)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded")
