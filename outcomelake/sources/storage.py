"""Where intermediate tables and checkpoints go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local, as in tests, a temporary folder is made and
    kept as the context's checkpoint directory, so that later calls find the same one. On a cluster that
    names neither a folder nor a checkpoint directory this is an error: a folder of the driver's own machine
    is none that executors can read.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="outcomelake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Folders of :func:`scratch` that are open, the innermost last.
_scratch: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, under this application's part of the shared folder."""
    return f"{_scratch[-1] if _scratch else _own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at the end, so nothing that reads it may outlast it; write results to a path made before."""
    folder = new_path(spark, "scratch")
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        remove(spark, folder)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/outcomelake-{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> bool:
    """Remove all that this application wrote to the shared folder; for the end of a job, when no result is read any more."""
    return remove(spark, _own_dir(spark))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, or at ``path``, and read it back.

    This cuts the lineage: a lost executor costs the tasks that ran on it, never the steps before.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
