"""The folder that driver and executors share, and results that are kept there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where ``spark.checkpoint.dir`` names none, one under ``/tmp`` is set if driver and executors are one process (tests,
    the command line); on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder, and read again: for large results, and for loops.

    A checkpoint keeps its plan's estimate of size, which joins multiply from round to round until planning takes longer
    than the work; a table has the size of its files. The tables stay until ``remove_saved``, as results that aren't
    yet computed may read them.
    """
    return df.sparkSession.read.schema(df.schema).parquet(saved_path(df))


def saved_path(df: DataFrame) -> str:
    """The folder of ``df`` written so, for tasks that read parts of it themselves, several times."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def remove_saved(spark: SparkSession) -> None:
    """Deletes all that this application has ``saved``; to be called when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
