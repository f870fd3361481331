"""Each operator on tables with clashing and dotted names, nulls, repeats, very long texts and no rows; the SQL of those that have it; the pipeline against plain Python."""

import glob
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, line_dedup, near_sets, preference_chat, quality_cnn, quality_rules, queries, secret_scan, sentencepiece_lattice, simhash_dedup, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(21)
WORDS = ["".join(RNG.choice(list("abcdefghi"), 5)) for _ in range(300)]
LONG = " ".join(RNG.choice(WORDS, 60_000))
NAMES = ["__own", "__w", "__row", "__text", "a.b", "own", "tx", "row", "none", "fp", "copy", "starts", "head", "c1", "doc", "n", "__block", "score", "value"]


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["the one and the other", None, "", "\n\n", LONG, LONG, "the one and the other", "z" * 30_000, "\n".join(["a line of words", "and one more"] * 3)]
    ids = [1, 2, None, 4, 5, 6, 1, None, 9]
    rows = [(i, t, *(f"{n}{k}" for n in NAMES)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    kinds = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, kinds).repartition(2)


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.fit(secret_scan.labelled_findings(spark, 400))


def bench(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[500:540])), (2, None)], "item_id long, text string")


KEEPING = {
    "bytes": suffix_dedup.dedup_bytes, "words": substring_dedup.dedup_words, "rules": quality_rules.with_quality, "lines": line_dedup.dedup_lines, "line pairs": line_dedup.dedup_line_pairs,
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_are_kept(odd, name):
    got = KEEPING[name](odd)
    assert got.columns[: len(odd.columns)] == odd.columns
    back = got.select(*(F.col(f"`{c}`") for c in odd.columns))
    assert back.count() == odd.count() and back.exceptAll(odd).count() == 0
    with pytest.raises(ValueError):
        KEEPING[name](odd.withColumn(got.columns[-1], F.lit(1)))
    assert KEEPING[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["simhash", "near sets", "benchmark"])
def test_rows_are_kept_whole(spark, odd, name):
    keep = {"simhash": simhash_dedup.keep_first, "near sets": near_sets.keep_first, "benchmark": lambda d: decontaminate.clean(d, bench(spark))}[name]
    got = keep(odd)
    assert got.columns == odd.columns and got.exceptAll(odd).count() == 0
    texts = Counter(r.text for r in got.collect())
    if name == "benchmark":
        assert texts[LONG] == 0 and sum(texts.values()) == odd.count() - 2
    else:
        assert texts[LONG] == 1 and texts["the one and the other"] == 1
    assert keep(odd.limit(0)).count() == 0


def test_results_of_their_own(spark, odd, model):
    # null ids and repeated rows give a row each
    assert quality_cnn.scores(odd, 0.25).count() == odd.count()
    net = quality_cnn.Network.fresh()
    s = {(r.doc_id, round(r.score, 6)) for r in quality_cnn.scores(odd, net).collect()}
    assert len({x for i, x in s if i == 1}) == 1
    assert simhash_dedup.near_duplicates(odd).count() == odd.count()
    found = decontaminate.contaminated(odd, bench(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word, r.similarity) for r in found) == [(5, 1, 500, 1.0), (6, 1, 500, 1.0)]
    e = sentencepiece_lattice.encode(odd, and_decode=True)
    assert Counter(r.decoded for r in e.collect()) == Counter(r.text or "" for r in odd.select("text").collect())
    secret = odd.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')))
    assert secret_scan.scan(secret, model).filter("value LIKE '24be%'").count() == odd.count()


def test_no_rows(spark, odd, model):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_cnn.fit(none, labels) == 0.5 and quality_cnn.scores(none, 0.5).count() == 0
    assert decontaminate.contaminated(none, bench(spark)).count() == 0 and decontaminate.contaminated(odd, bench(spark).limit(0)).count() == 0
    assert decontaminate.clean(odd, bench(spark).limit(0)).count() == odd.count()
    assert secret_scan.scan(none, model).count() == 0
    convs = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert preference_chat.formatted(preference_chat.sampled_pairs(preference_chat.conversations(convs))).count() == 0


def test_pairs_keep_columns(spark):
    turns = "array<struct<role:string,text:string>>"
    one = [("user", "x"), ("assistant", "y" * 200_000)]
    df = spark.createDataFrame([(one, one[:1], "a", "b"), (None, one, "c", "d")], f"chosen {turns}, rejected {turns}, sides string, `a.b` string")
    got = preference_chat.formatted(df).collect()
    assert [(r.sides, r["a.b"], r.pair.prompt_turns) for r in got] == [("a", "b", 1), ("c", "d", 0)]
    assert len(got[0].pair.chosen) > 200_000 and got[0].pair.rejected == "" and got[1].pair.chosen == ""
    with pytest.raises(ValueError):
        preference_chat.formatted(df, out="sides")


def test_ids_of_the_same_name_are_refused(spark, odd):
    with pytest.raises(ValueError):
        decontaminate.contaminated(odd, bench(spark), doc_id="item_id")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs: sorted(tuple(str(r[c]) for c in cols) for r in rs)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, r, strict=True)) for r in want.fetchall())


def plain_pipeline(docs, items):
    """The five stages in plain Python: (id, text) rows in, id -> text out."""
    import re

    stop = set(quality_rules.ALL_STOP_WORDS)
    kept = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ls = t.split("\n")
        full = [x for x in ls if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + o for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for o in range(3)}
        if len(w) < 50 or 2 * len(again) > len(w):
            continue
        dup = len(full) - len(set(full))
        if 2 <= sum(map(len, w)) / len(w) <= 15 and len(re.findall(r"[#*$%&|<>]", t)) / len(w) <= 0.1 and sum(x.lower() in stop for x in w) / len(w) >= 0.02 and dup / len(full) <= 0.3 and len(w) / len(ls) >= 1:
            kept.append((i, t))
    seen, lined = set(), []
    for i, t in sorted(kept):
        ls, gone = t.split("\n"), set()
        for k in range(len(ls) - 1):
            if (ls[k] + ls[k + 1]).strip(" \t\n\r\x0b\x0c"):
                gone |= {k, k + 1} if (ls[k], ls[k + 1]) in seen else set()
                seen.add((ls[k], ls[k + 1]))
        lined.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone) if gone else t))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
    sets = []
    for _, t in lined:
        w = low(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(lined)))
    holds = {}
    for a, s in enumerate(sets):
        for g in s or {()}:
            holds.setdefault(g, []).append(a)
    for a, b in {(x, y) for v in holds.values() for x in v for y in v if y < x}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    single = [lined[r] for r in sorted(set(root))]
    gram = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    def leaked(t):
        w = low(t)
        for x in items:
            iw = low(x)
            n = min(len(iw), len(w))
            want = gram(iw) if iw else Counter()
            have = set(want)
            for s in range(len(w) - n + 1) if n else []:
                a = gram(w[s : s + n]) if len(iw) >= 5 or n < 5 else gram(w[s : s + n])
                if have & set(a):
                    both = sum((a & want).values())
                    if both / (sum(a.values()) + sum(want.values()) - both) >= 0.8:
                        return True
        return False

    return {i: t for i, t in single if not leaked(t)}


def test_pipeline_is_the_plain_one(spark, tmp_path):
    import corpus_pipeline

    stop = quality_rules.STOP_WORDS["en"]
    prose = lambda n: " ".join(str(w) for w in RNG.choice(WORDS + stop * 12, n))
    passage, items = [prose(14) for _ in range(3)], [prose(30) for _ in range(3)]
    texts = ["\n".join(prose(15) for _ in range(6)) for _ in range(14)]
    texts += [texts[0], texts[1].upper(), texts[2].replace(texts[2].split()[40], "changed")]  # copies
    texts += ["\n".join([prose(20), *passage, prose(20)]) for _ in range(4)]  # repeated lines
    texts += [prose(40) + " " + x + " " + prose(40) for x in items]  # benchmark passages
    texts += ["too short", "", prose(60).replace(" ", "\n\n\n"), " ".join(["one two three"] * 30), " ".join("# x" for _ in range(60))]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = plain_pipeline(docs, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: r.decoded for i, r in got.items()} == want and 10 < len(want) < len(docs) - 8
    assert all(r.n_pieces == len(r.ids) and bool(r.ids) == bool(r.decoded) for r in got.values())
