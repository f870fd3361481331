"""Tables that cut lineage: written once to the folder that driver and executors share, read back, and deleted when done with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application's tables.
_FOLDER: dict[str, str] = {}
#: Tables of the innermost ``scratch`` that this thread is in.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("tables of the innermost scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. Only a local session (tests) may do without one: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back: lineage ends here, and a lost executor loses nothing.

    All tables of an application lie in one folder, which goes when the application ends; ``release`` deletes single ones before.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _FOLDER:
        _FOLDER[app] = f"{shared_folder(spark)}/pairloom-{app}-{uuid.uuid4().hex[:8]}"
        fs, folder = _path(spark, _FOLDER[app])
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    path = f"{_FOLDER[app]}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._pairloom_path = path
    if (made := _MADE.get()) is not None:
        made.append(back)
    return back


def release(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` wrote. Nothing that is still to be computed may read them."""
    for df in frames:
        fs, folder = _path(df.sparkSession, df._pairloom_path)
        fs.delete(folder, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``written`` writes inside is deleted at the end, but for tables that go through the function that this yields.

    Only tables of this block and this thread are meant: what others have written, and may still read, stays.
    """
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._pairloom_path)
        return df

    outer = _MADE.get()
    token = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(token)
        for df in made:
            if df._pairloom_path not in kept:
                release(df)
            elif outer is not None:
                outer.append(df)
