"""Fill-in-middle against plain Python over lists of units, on odd tables too; cumulative sums over several levels of blocks."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from pairloom.llm import fill_in_middle as fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "char": r"[\s\S]"}
TEXTS = ["one\ntwo\n\n\nthree", "\n", "\n\n\n", "no break", "ends\n", "é🙂\r\n日本\n🙂", None, "", "has <P> in it\nx", "<M>", "a<\nS>\n<S\n>", " lead and  trail \n ", "one\ntwo\n\n\nthree", "".join(f"line {i}\n" * (i % 3) + "\n" * (i % 4) for i in range(4000))]
ROWS = [(i if i != 9 else None, t, i) for i, t in enumerate(TEXTS)] + [(i, "a\nbb\n\nccc\n" * (i % 5) + "end", i) for i in range(100, 160)]


def plain(doc_id, text, unit, rate=100, spm=50):
    t = text or ""
    units = re.findall(UNITS[unit], t)
    assert "".join(units) == t
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(s in t for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("word", 60, 20), ("char", 100, 100)])
def test_is_the_plain_version_and_comes_back(spark, unit, rate, spm):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, `a.b` int").repartition(3)
    got = fim.with_middles(df, unit=unit, rate=rate, spm=spm)
    assert got.columns == [*df.columns, "fim"]
    forms = set()
    for r in got.select("*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("again")).collect():
        assert tuple(r.fim) == plain(r.doc_id, r.text, unit, rate, spm), (r.doc_id, r.text)
        assert r.again == (r.text or "")
        forms.add(r.fim.form)
    assert forms >= {"plain", "spm"} and got.count() == len(ROWS)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 128 * 128 + 5, 128 * 300])
def test_cumulative_sums(spark, n):
    xs = [(i * 7) % 11 for i in range(n)]
    row = spark.createDataFrame([(xs,)], "xs array<long>").select(fim.cumulative(F.col("xs")).alias("c")).first()
    assert row.c == list(itertools.accumulate(xs))


def test_refuses_what_it_cannot_do(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, FIM string")
    with pytest.raises(ValueError):
        fim.with_middles(df)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<<", "<M>"), ("P", "SP", "M"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.with_middles(df, out="x", sentinels=bad)
    assert fim.with_middles(df.limit(0), out="x").count() == 0
