"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.tables import release, scratch, written as materialized  # noqa: F401

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
NULL_OWNER = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The written table that ``make`` gives; all others that it wrote on the way are deleted."""
    with scratch() as keep:
        return keep(make())


def named(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, one for each wanted one."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def owner(doc_id: Column) -> Column:
    """Order key of a document; rows without an id count as one owner after all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_OWNER))


def sql_list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def texts(column: pa.Array, at_once: int = 256) -> Iterator[bytes | None]:
    """The texts of a batch as bytes, a few at a time; Arrow's memory goes back when the batch is done."""
    for start in range(0, len(column), at_once):
        yield from column.slice(start, at_once).cast(pa.large_binary()).to_pylist()
    pa.default_memory_pool().release_unused()
