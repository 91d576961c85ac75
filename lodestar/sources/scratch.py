"""Tables between the steps of a job, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder of the context. Where neither is set, a
    temporary folder if driver and executors are one machine (a local master), else an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        found = context.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: The tables written in each open scope of this thread, innermost last.
_SCOPES = threading.local()


def _open() -> list[list[str]]:
    if not hasattr(_SCOPES, "stack"):
        _SCOPES.stack = []
    return _SCOPES.stack


#: Shuffle files go when the command that made them ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives any executor. The shuffle files of
    the write are removed with its end, as nothing else can read them."""
    path, conf = fresh_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    if _open():
        _open()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scoped(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a table, and every other table that it wrote on the way removed, as the result no
    longer needs them."""
    _open().append([])
    try:
        made = make()
        inner = _open()[-1]
        before = len(inner)
        out = written(made)
        path = inner.pop(before)
    finally:
        gone = _open().pop()
        place = spark._jvm.org.apache.hadoop.fs.Path
        for old in gone:
            place(old).getFileSystem(spark._jsc.hadoopConfiguration()).delete(place(old), True)
    if _open():
        _open()[-1].append(path)
    return out
