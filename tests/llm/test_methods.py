"""What the methods promise: prunes that prune and lose nothing, naive versions of learned scores, splits of hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, preference_chat, quality_cnn, quality_rules, repeats, secret_scan, sentencepiece_lattice, simhash_dedup, substring_dedup, suffix_dedup

RNG = np.random.default_rng(11)


def test_score_is_the_naive_forward_pass():
    net = quality_cnn.Network.fresh(3)
    for text in (b"", b"short", bytes(RNG.integers(0, 256, 256).astype(np.uint8)), bytes(RNG.integers(0, 256, 1111).astype(np.uint8))):
        symbols = list(text) + [quality_cnn.PAD] * (quality_cnn.CHUNK - len(text))
        starts = list(range(0, len(symbols) - quality_cnn.CHUNK + 1, quality_cnn.STEP))
        if starts[-1] != len(symbols) - quality_cnn.CHUNK:
            starts.append(len(symbols) - quality_cnn.CHUNK)
        hidden = []
        for s in starts:
            x = net.vectors[symbols[s : s + quality_cnn.CHUNK]]
            z = np.array([[max(0.0, float((x[p : p + quality_cnn.WIDTH] * net.filters[:, :, f]).sum() + net.bias[f])) for f in range(quality_cnn.FILTERS)] for p in range(quality_cnn.PLACES)])
            hidden.append(np.maximum(np.concatenate([z.max(0), z.mean(0)]) @ net.hidden + net.hidden_bias, 0))
        want = 1 / (1 + np.exp(-(np.mean(hidden, axis=0) @ net.out + net.out_bias[0])))
        assert net.score(text, net.tables()) == pytest.approx(want, abs=1e-5)
        assert len(quality_cnn.chunks_of(text)) == len(starts)


def test_training_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 30, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_cnn, "MAX_TRAINING_ROWS", 20)
    monkeypatch.setattr(quality_cnn, "train", lambda chunks, own, y: seen.append(len(y)) or 0.5)
    quality_cnn.fit(docs, labels)
    assert seen == [20]


def _balls(n, spread):
    c = [int(x) for x in RNG.integers(0, 2**63, 5)]
    fps = {c[int(RNG.integers(5))] ^ sum(1 << int(b) for b in set(RNG.integers(0, 64, int(RNG.integers(0, spread))))) for _ in range(n)}
    return sorted(f - 2**64 if f >> 63 else f for f in fps)


def test_chains_prune_and_lose_no_pair(spark):
    fps = _balls(150, 12)
    chains = simhash_dedup.equal_chains(spark.createDataFrame([(f,) for f in fps], "fp long"))
    shorter, longer = {r.fp for r in chains.collect()}, {r.fp: r.free for r in simhash_dedup.long_chains(chains).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    linked = {a for a in fps for b in fps if a != b and apart(a, b) <= 2}
    assert linked <= set(longer) < shorter


def test_multi_index_prunes_and_loses_nothing_within_the_radius():
    items = RNG.integers(0, 2**63, (400, 2)).astype(np.uint64)
    asked = items[:150].copy()
    for row in asked:
        for b in RNG.choice(128, int(RNG.integers(0, 60)), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    index = decontaminate.MultiIndex(items)
    apart = np.bitwise_count(asked[:, None] ^ items[None]).sum(axis=-1)
    row, item, d = index.near(asked)
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)), strict=True))
    assert d.tolist() == apart[row, item].tolist()
    assert len(index.candidates(asked)[0]) < 0.8 * apart.size


def test_a_benchmark_of_several_rounds_gives_the_same_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(RNG.choice(words, 20))) for i in range(12)] + [(100, None), (None, "a b c d e f"), (7, "a b c d e f")]
    texts = [" ".join(RNG.choice(words, 30)) + " " + items[i % 12][1] for i in range(20)] + ["x a b c d e f y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 1)
    monkeypatch.setattr(decontaminate.rounds, "__defaults__", ("item_id", "text", 300))
    assert len(list(decontaminate.rounds(bench))) > 2
    assert sorted(map(str, decontaminate.contaminated(docs, bench).collect())) == once
    assert len(once) >= 22 and any("item_id=None" in r for r in once)


@pytest.mark.parametrize("run", [suffix_dedup.dedup_bytes, substring_dedup.dedup_words])
def test_hot_anchors_are_split_without_a_change(spark, monkeypatch, run):
    core = " ".join(f"c{i}" for i in RNG.integers(0, 9999, 45))
    tail = [" ".join(f"t{i}" for i in RNG.integers(0, 9999, 30)) for _ in range(4)]
    texts = [" ".join(f"h{i}" for i in RNG.integers(0, 9999, 30)) + " " + core + " " + tail[k % 4] for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").repartition(3)
    out = run.__defaults__[-1]
    got = lambda: sorted((r.doc_id, r[out].n_removed, r[out].kept_sha256) for r in run(df).collect())
    plain = got()
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "STRETCHES_PER_TASK", 5)
    assert got() == plain
    assert sum(n for _, n, _ in plain) > 0


def test_a_word_of_100000_letters_is_encoded(spark):
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefghijklmnopé"), 100_000))
    got = {r.doc_id: r for r in sentencepiece_lattice.encode(spark.createDataFrame([(1, long), (2, "z" * 100_000)], "doc_id long, text string"), and_decode=True).collect()}
    assert got[1].decoded == long and got[2].decoded == "z" * 100_000
    table = {p: (i, s) for p, i, s in sentencepiece_lattice.read_model()[0]}
    w = "▁" + long
    best, back = [0.0] + [-1e18] * len(w), [(0, 0)] * (len(w) + 1)
    for e in range(1, len(w) + 1):
        for b in range(max(0, e - 16), e):
            if w[b:e] in table and best[b] + table[w[b:e]][1] > best[e]:
                best[e], back[e] = best[b] + table[w[b:e]][1], (b, table[w[b:e]][0])
    ids, e = [], len(w)
    while e:
        e, i = back[e]
        ids.append(i)
    assert got[1].ids == ids[::-1]


def test_no_plan_of_the_lattice_holds_the_model(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert len(sentencepiece_lattice.encode(df, and_decode=True)._jdf.queryExecution().toString()) < 100_000


def test_best_paths_of_many_words_equal_a_plain_loop(spark):
    at = sentencepiece_lattice.LONG
    words = ["▁" + "ab" * at, "▁日本語🙂é", "x" * (at - 1), "the" * (at // 3), "y" * (at + 1), "▁" + "information" * 40, "▁", "a", "e\u0301\u0301", "\x00\x7f\x80", "▁international"]
    rows = spark.createDataFrame(list(enumerate(words)), "__nth int, word string")
    got, n = sentencepiece_lattice.best_paths(sentencepiece_lattice.lattice_edges(rows, keys=("__nth",)).toArrow())
    pieces, byte_ids, _ = sentencepiece_lattice.read_model()
    table, least = {p: (i, s) for p, i, s in pieces}, min(s for _, _, s in pieces) - sentencepiece_lattice.UNKNOWN_PENALTY
    assert n == len(words)
    for w, ids in zip(words, got.to_pylist(), strict=True):
        best, back = [0.0], [[]]
        for e in range(1, len(w) + 1):
            ways = [(b, *table.get(w[b:e], ([byte_ids[x] for x in w[b:e].encode()], least))) for b in range(max(0, e - 16), e) if w[b:e] in table or b == e - 1]
            b, i, s = max(ways, key=lambda x: best[x[0]] + x[2])  # the first of equal ones: the longest
            best.append(best[b] + s)
            back.append(back[b] + (i if isinstance(i, list) else [i]))
        assert ids == back[-1]


def test_secrets_are_told_from_look_alikes_on_findings_not_learned_from(spark):
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    fresh = secret_scan.labelled_findings(spark, 2000, first=10_000).withColumn("doc_id", F.monotonically_increasing_id())
    found = secret_scan.scan(fresh, model).groupBy("doc_id").agg(F.max("secret").alias("said"))
    r = fresh.join(found, "doc_id", "left").select("secret", F.coalesce("said", F.lit(False)).alias("said")).toPandas()
    precision = (r.secret[r.said] == 1).mean()
    recall = r.said[r.secret == 1].mean()
    assert precision > 0.95 and recall > 0.95, (precision, recall)


def test_kinds_change_where_they_change(spark):
    df = spark.createDataFrame([(1, "deadbeefdeadbeefdddd1"), (2, "aaaaaaaaaaaaaaaa1A")], "doc_id long, text string")
    rows = secret_scan.candidates(df).select("doc_id", *secret_scan.features()).collect()
    assert {r.doc_id: r.changes for r in rows} == {1: pytest.approx(1 / 21), 2: pytest.approx(2 / 18)}


def test_pairs_part_at_any_reply_and_everyone_has_a_donor(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}" if t % 2 else f"ask {t}") for c in range(60) for t in range(8)]
    convs = preference_chat.conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = preference_chat.formatted(preference_chat.sampled_pairs(convs)).collect()
    assert {r.pair.prompt_turns for r in got} == {1, 3, 5, 7}
    assert all(r.pair.rejected and r.pair.chosen != r.pair.rejected for r in got)
    named = preference_chat.sampled_pairs(convs.withColumn("conv_id", F.concat(F.lit("c"), "conv_id")))
    assert named.count() == 60


def test_every_rule_can_fail(spark):
    good = "the cat and the dog went to that old house by this river and it was for them as good a day as any that they had known to be with one at home or on the road in all of those long and slow years they lived which had not been kind"
    texts = [good, good.replace(" ", "\n\n\n"), " ".join(w * 6 for w in good.split()), " ".join("# " + w for w in good.split()), " ".join("z" + w for w in good.split())]
    texts.append("\n".join(f"the {w} of that {i}\nand so on" for i, w in enumerate(good.split()[:20])))
    q = [r.quality.kept for r in quality_rules.with_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert q == [True, False, False, False, False, False]
