"""Tables that a job writes for itself in the folder which the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables that the innermost scope() of this thread has written; other threads have scopes of their own.
_scope: ContextVar[list[str] | None] = ContextVar("helixframe-tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode where that setting is absent (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, paths: list[str] | None = None, per_file: int | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors, and what follows never recomputes the frame.  The path is
    added to `paths`, for discard() once nothing reads the table any more.  per_file: rows of a file at
    most, for a table of few bytes whose rows are much work, which one file would leave to one task.
    """
    path = fresh_path(df.sparkSession, tag)
    (df.write if per_file is None else df.write.option("maxRecordsPerFile", per_file)).parquet(path)
    if (own := _scope.get()) is not None:
        own.append(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that materialise() wrote, by the file system they are on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    if (own := _scope.get()) is not None:
        gone = set(paths)
        own[:] = [p for p in own if p not in gone]
    paths.clear()


@contextmanager
def scope(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Delete at the end what materialise() wrote inside, in this thread, but for `keep`.

    `keep` is filled meanwhile, by the caller; nothing may read the other tables afterwards.  What is kept
    belongs to the scope around, if there is one.
    """
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        kept = [p for p in own if p in keep]
        discard(spark, [p for p in own if p not in keep])
        if (outer := _scope.get()) is not None:
            outer.extend(kept)
