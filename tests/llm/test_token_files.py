"""Token files: ids as the tokenizer's own, grammars that expand to what they were made of, random access, and the whole query."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import token_files as tf

RNG = np.random.default_rng(8)
SIGNS = list("abcdefgh  \n\t\r.,'-#019ABÉ") + ["'s", "'LL", "\u00e9", "e\u0301", "\u0301", "\u00a0", "\u0085", "\u1c5a", "\u0130", "ß", "ª", "²", "÷", "×", "日本", "🙂", "<|endoftext|>", "<|", "\x1c", "\u00ad", "ſ", "Ａ", "\u2028", "ﬁ", "ΑΣ ", "\x7f", "\x00"]
TEXTS = ["".join(RNG.choice(SIGNS, RNG.integers(0, 80))) for _ in range(400)] + ["It's THE end, isn't it? I'LL see: x2³ naïve ÀÉÎ", "", " ", "\n\n", "z" * 500, "<|startoftext|> a<|endoftext|>b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(name, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(name)
    e, t = tf.Encoder(path), Tokenizer.from_file(path)
    assert e.by_part == (name == "word_bpe_49k.json")
    monkeypatch.setattr(tf, "HELD", 50)
    for x in TEXTS:
        assert np.frombuffer(e.encode(x), e.kind).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_real_texts_have_the_tokenizers_ids(spark):
    e, t = tf.Encoder(tf.tokenizer_path()), Tokenizer.from_file(tf.tokenizer_path())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(e.encode(r.text), e.kind).tolist() == t.encode(r.text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_shards_expand_to_their_tokens_anywhere(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 90, rng.integers(1, 5)) for _ in range(30)]
    ids = [np.concatenate([words[w] for w in rng.integers(0, 30, n)] or [np.empty(0, int)]).astype(np.uint16) for n in [*rng.integers(0, 60, 40), 0, 3000]]
    ids.append(np.full(1001, 7, np.uint16))
    docs = [*range(len(ids) - 1), None]
    data = tf.packed(docs, ids, 100, 2, 2)
    s = tf.Shard(data)
    assert s.docs == docs and len(s.left) > 10 and len(data) < 2 * sum(map(len, ids))
    whole = [[*x.tolist(), 2] for x in ids]
    assert [x.tolist() for x in s.all_tokens()] == whole
    assert s.first_token.tolist() == np.cumsum([0, *map(len, whole)])[:-1].tolist() and s.n_tokens == sum(map(len, whole))
    for _ in range(200):
        d = int(rng.integers(0, len(whole)))
        a, n = int(rng.integers(0, len(whole[d]) + 2)), int(rng.integers(0, 40))
        assert s.tokens(d, a, n).tolist() == whole[d][a : a + n]
        assert s.tokens(d).tolist() == whole[d]
    # lengths of rules are those of their sides
    size = np.concatenate([np.ones(100, int), s.lengths])
    assert (s.lengths == size[s.left] + size[s.right]).all()


def test_frequent_pairs_become_rules():
    s, left, right = tf.repair(np.tile(np.array([5, 6, 7, 9], np.uint32), 100), 10, 2, 1000)
    assert len(s) <= 100 and {(5, 6), (7, 9)} <= set(zip(left.tolist(), right.tolist(), strict=True))
    assert len(tf.repair(np.tile(np.array([5, 6], np.uint32), 7), 10, 2, 1000)[1]) == 0
    assert len(tf.repair(np.tile(np.array([5, 6, 7, 9], np.uint32), 100), 10, 2, 1)[1]) == 1


@pytest.mark.parametrize("summed", [4096, 3])
def test_files_give_the_documents_back(spark, monkeypatch, summed):
    monkeypatch.setattr(tf, "SUMMED", summed)
    rows = [(int(i), t, "x", -1) for i, t in zip(RNG.permutation(len(TEXTS)), TEXTS, strict=True)] + [(None, None, "x", 0), (None, "a b", "x", 0), (7, "again", "x", 0), (7, "again", "x", 0), (2**63 - 1, None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `doc.own` string, shard int").repartition(5)
    shards = tf.write(df, shard_tokens=300)
    assert shards.count() > 10 and all(bytes(r["data"][:4]) == tf.MAGIC for r in shards.collect())
    t = Tokenizer.from_file(tf.tokenizer_path())
    key = lambda r: (2**63 - 1 if r[0] is None else r[0], r[0] is None)
    got = sorted(tf.read(shards).collect(), key=lambda r: r.start)
    assert [key(r) for r in got] == sorted(map(key, rows))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    want = sorted((str(i), str([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, _, _ in rows)
    assert sorted((str(r.doc_id), str(r.ids)) for r in got) == want
    sums = {(r.start, r.n_tokens): r.ids_crc32 for r in tf.checksums(shards).collect()}
    assert all(sums[r.start, r.n_tokens] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert tf.checksums(tf.write(df.limit(0))).count() == 0


def test_query_is_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    t, at = Tokenizer.from_file(tf.tokenizer_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.op11(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.col("doc_id")).collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
