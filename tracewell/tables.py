"""Tables of a run in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that are few enough to be sent to all tasks.
FEW_ROWS = 1 << 20


def shared_dir(spark: SparkSession, keep: bool = False) -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes when the driver ends, if not told to ``keep``.

    Where that setting is absent, a temporary folder of this machine stands in
    for it if all of Spark runs in this process; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tracewell-shared")
    path = f"{base.rstrip('/')}/tracewell-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_dir`` made."""
    try:
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to: it does when the driver has collected them."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write a table to the shared folder, with ``options`` of the writer, and read it back: ends its lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    # Nothing looks for the marker file of a table that only this run reads.
    df.write.mode("overwrite").options(**options).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_by(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``rows``, a written table; only keys are met with the others.

    A filter, unlike a semi join, goes below the expressions of ``df``. So what is not
    held is neither computed nor, if keys are few, moved.
    """
    keys = rows.select(key).distinct()
    return df.where(F.col(key).isin(F.broadcast(keys) if keys.count() <= FEW_ROWS else keys))
