"""Two-sided contests: unfolding into participants, orientation, halves and difference designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, shared: list[str], sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows for each contest: ``shared`` columns, ``side`` and, for each name in ``sides``, its column of that side. One scan, no shuffle."""
    row = lambda k, label: F.struct(F.lit(label).alias("side"), *(F.col(c[k]).alias(n) for n, c in sides.items()))
    return df.select(*shared, F.explode(F.array(row(0, "a"), row(1, "b"))).alias("__s")).select(*shared, "__s.*")


def differences(keys: list[str], a: str = "a_", b: str = "b_") -> list[Column]:
    return [(F.col(a + k) - F.col(b + k)).alias("d_" + k) for k in keys]


def halves(column: str, name: str) -> list[Column]:
    """An antisymmetric value as two side columns whose difference it is."""
    return [(F.col(column) / 2).alias("a_" + name), (-F.col(column) / 2).alias("b_" + name)]


def design(df: DataFrame, keys: list[str], raw: list[str], context: list[str], swap: bool = False) -> DataFrame:
    """``d_`` differences, both sides' raw values and context; ``swap`` exchanges the sides."""
    a, b = ("b_", "a_") if swap else ("a_", "b_")
    return df.select(*differences(keys, a, b), *(F.col(a + r).alias("s1_" + r) for r in raw), *(F.col(b + r).alias("s2_" + r) for r in raw), *context)


def canonical_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
