"""Append-only quote streams: daily windows with late data, and the latest quote that is not stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import joins


def daily(stream: DataFrame, ts: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Tumbling day windows by key: count, sum and greatest value. Time stamps without zone are read in the session's zone."""
    s = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    w = s.groupBy(F.window("__t", "1 day").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return w.select(F.to_date("w.start").alias("day"), key, "n", "total", "most")


def latest(quotes: DataFrame, key: str, ts: str, value: str, now: str, hours: int = 36) -> DataFrame:
    """The newest ``value`` of each key that is at most ``hours`` old at ``now``."""
    t = F.col(ts).cast("timestamp")
    fresh = quotes.filter(t.between(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(now).cast("timestamp")))
    return fresh.groupBy(key).agg(F.max_by(F.col(value), F.struct(t, F.col(value))).alias(value), F.max(t).alias("at"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, then stop."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def isolated(steps: dict[str, Callable[[], object]]) -> dict[str, str]:
    """Runs all ``steps``, one after the other, and returns the first line of what went wrong in each that failed."""
    failed = {}
    for name, step in steps.items():
        try:
            step()
        except Exception as e:  # a source that is down must not keep the others back
            failed[name] = f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"
    return failed


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, page: str, key: list[str], order: str) -> None:
    """Everything that is there now, merged by page into a versioned table: rows of refreshed pages go, of repeated keys the last in ``order`` stays.

    Each batch writes version ``batch=<id>`` below ``path`` from the version before it, so that a repeated batch replaces its own version
    only; ``newest`` reads the last one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = newest(batch.sparkSession, path, before=number)
        new = joins.upsert(batch.limit(0) if old is None else old, batch, page, key, F.col(order))
        new.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last version of an ``upsert_stream`` table, or the last one before a batch; None if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = sorted(n for n in names if n.startswith("batch=") and (before is None or int(n[6:]) < before))
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None
