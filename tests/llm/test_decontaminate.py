"""Decontamination against all windows and items, where shingles repeat and where a text is shorter than an item."""

from collections import Counter

import numpy as np
import pytest

from pairloom.llm import decontaminate

RNG = np.random.default_rng(6)


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def alike(text, item):
    """The best similarity of a window of the text."""
    n = min(len(item), len(text))
    best = 0.0
    for s in range(len(text) - n + 1) if n else []:
        a, b = grams(text[s : s + n]), grams(item)
        both = sum((a & b).values())
        best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
    return best


def found(items, text):
    return {i: f[3] for f in decontaminate.Items([(" ".join(w), [i]) for i, w in enumerate(items)]).find(" ".join(text).encode()) for i in f[0]}


def test_items_of_two_words_in_turn_are_found():
    for n in (12, 13, 17, 21, 60):
        for _ in range(40):
            x, y = ("w" + str(v) for v in RNG.choice(10**6, 2, replace=False))
            item, text = [x, y] * (n // 2) + [x] * (n % 2), [y, x] * (n // 2) + [y] * (n % 2)
            want = alike(text, item)
            got = found([item], ["some", "words", *text, "more"])
            assert (want >= 0.8) == bool(got) and got.get(0, 0) >= (want if want >= 0.8 else 0)


@pytest.mark.parametrize("letters", [2, 3, 30, 3000])
def test_all_that_is_alike_is_found(letters):
    """Texts over few words repeat their shingles; some end before the item does."""
    hits = 0
    for k in range(150):
        items = [[f"v{x}" for x in RNG.integers(0, letters, RNG.integers(1, 45))] for _ in range(6)]
        base = list(items[k % 6])
        for _ in range(RNG.integers(0, 3)):
            base[RNG.integers(0, len(base))] = "v" + str(RNG.integers(0, letters))
        base = base[: len(base) - RNG.integers(0, 1 + len(base) // 8)]
        text = [f"v{x}" for x in RNG.integers(0, letters, RNG.integers(0, 20))] * (k % 3 > 0) + base + ["tail"] * (k % 2)
        want = {i: s for i, w in enumerate(items) if (s := alike(text, w)) >= 0.8 - 1e-12}
        got = found(items, text)
        assert got == pytest.approx(want)
        hits += len(want)
    assert hits > 20


def test_bits_that_may_turn_are_enough():
    """Replacing as many shingles as similarity 0.8 allows turns none of the other bits."""
    for m in (3, 9, 12, 30, 100):
        h = RNG.integers(0, 2**63, m).astype(np.uint64)
        sums = decontaminate.votes(h).sum(axis=0, keepdims=True)
        c = m - decontaminate.needed(m, m)
        limit = decontaminate.may_turn(sums, m)[0]
        for _ in range(50):
            g = h.copy()
            g[RNG.choice(m, c, replace=False)] = RNG.integers(0, 2**63, c).astype(np.uint64)
            assert decontaminate.apart(decontaminate.packed(sums), decontaminate.packed(decontaminate.votes(g).sum(axis=0, keepdims=True)))[0] <= limit
