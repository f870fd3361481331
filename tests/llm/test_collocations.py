"""Collocations against plain Python counts of all n-grams, with sets broadcast or shuffled, and scores beyond 64 bits."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import collocations

RNG = np.random.default_rng(3)
WORDS = ["new", "York", "city", "é", "x\u00a0y", "of", "the", "a", "b"]


def text(n):
    w = RNG.choice(WORDS, n, p=[0.2, 0.15, 0.15, 0.1, 0.05, 0.15, 0.1, 0.05, 0.05])
    return "".join(x + RNG.choice([" ", "\t", "  ", ", ", ".\n", "\r", "!?"], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02]) for x in w)


ROWS = [(i, text(40), ["en", "de", None][i % 3]) for i in range(60)] + [(None, None, "en"), (3, "", "en"), (3, " ,. \t", None), (4, "In New York city, new york City", "en"), (4, "In New York city, new york City", "en"), (5, "y " * 3000 + "z", "fr")]


def plain(rows, max_n, least, keep, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for p in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            for m in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = []
        for p, a in cands.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= keep * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                held.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(held)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("max_n,least,keep,top,rows", [(5, 5, 100, 2000, 500_000), (5, 5, 60, 7, 0), (3, 2, 100, 50, 500_000), (2, 1, 100, 10, 0), (4, 3, 80, 1000, 10)])
def test_is_the_plain_count(spark, monkeypatch, max_n, least, keep, top, rows):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({"phrase": F.lit(1), "piece": F.lit("x"), "n": F.lit(None)}).repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, max_n=max_n, least=least, keep=keep, top=top).collect()]
    want = plain(ROWS, max_n, least, keep, top)
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("bits", [3, 9, 28])
def test_many_frequent_pairs_are_a_map_of_bits(spark, monkeypatch, bits):
    """Beyond what is broadcast as rows, grams are not shuffled to meet the frequent pairs; a map with too few bits changes nothing."""
    plans, write = [], collocations.materialized
    monkeypatch.setattr(collocations, "materialized", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(collocations, "MAP_BITS", bits)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    parts = collocations.pieces(df)
    plans.clear()
    freq = {(r.lang, r.phrase): r.f for r in collocations.frequent(parts, 5, 5).collect()}
    assert not any("SortMergeJoin" in p for p in plans) and any(p.count("BroadcastHashJoin") >= 4 for p in plans)
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 500_000)
    assert freq == {(r.lang, r.phrase): r.f for r in collocations.frequent(parts, 5, 5).collect()} and len(freq) > 20


def test_scores_pass_64_bits(spark):
    """A product beyond 2**63 over another one, against whole numbers of Python."""
    a, n, left, right = 3 * 10**12 + 7, 10**13 + 9, 4 * 10**12 + 1, 5 * 10**12 + 3
    rows = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    up, down = F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), big("l") * big("r")
    assert rows.select(up.alias("up"), down.alias("down")).selectExpr("up div down AS s").first().s == 1000 * a * n // (left * right)


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", None)], "doc_id long, text string, lang string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0
