"""Writers: replaced and appended CSV, one JSON document, and a log whose rows are numbered on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_csv(df: DataFrame, path: str, files: int = 1) -> None:
    """A small report as ``files`` CSV files with headers; what was there goes."""
    df.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files; every file has the header, so that readers need not know which came first."""
    df.write.mode("append").option("header", True).csv(path)


def json_document(df: DataFrame, path: str, **columns: Column) -> None:
    """One JSON object: each of ``columns`` is an aggregate over ``df``. Meant for summaries that fit in one row."""
    df.agg(F.to_json(F.struct(*(c.alias(n) for n, c in columns.items()))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_numbered(df: DataFrame, path: str, number: str = "attempt") -> int:
    """Rows added to a Parquet log, all with the next number after the greatest there; returns that number. One writer at a time."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    last = spark.read.parquet(path).agg(F.max(number)).first()[0] if there else None
    n = (last or 0) + 1
    df.withColumn(number, F.lit(n)).write.mode("append").parquet(path)
    return n
