"""Tables that a job writes once and reads again, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
_STAGES: ContextVar[list[str] | None] = ContextVar("stages", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="spark-ledgerline-"))
    return _OWN_FOLDER[0]


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at the end of the block of stages() around it."""
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    own = _STAGES.get()
    if own is not None:
        own.append(path)
    return path


def staged(df: DataFrame, compression: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends here, so a lost executor costs a read.

    Rows that take long for their bytes are written to files of few rows, so that as many tasks can read them.
    """
    path = scratch(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark reaches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def stages(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that staged() writes within the block. All are deleted at its end, but for those that the block takes off the list.

    For callers that write an operator's result and need its staged tables no longer. Blocks may be nested, and run in several threads.
    """
    own: list[str] = []
    token = _STAGES.set(own)
    try:
        yield own
    finally:
        _STAGES.reset(token)
        for path in own:
            delete(spark, path)
