"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where nothing is set a local session (tests, a laptop) gets a temporary one; on a cluster executors would each write to
    their own disk, so there it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Folders of this process, for ``clear``.
_made: list[str] = []


def new_folder(spark: SparkSession, prefix: str = "job") -> str:
    _made.append(f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Deletes the tables and job folders that this process has written, once nothing reads them any more.

    Checkpoints are Spark's own; ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes those out of reach.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    while _made:
        place = path(_made.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The same rows as a table in the shared folder, whose size the planner then knows. ``codec``: zstd for tables of whole rows."""
    path = new_folder(df.sparkSession, "table")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
