"""Python workers and this package."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession | None = None) -> None:
    """Let Python workers on this machine import the package where the driver did.

    Call it before a Python function of the package goes into a plan. On a
    cluster the package is shipped as usual (--py-files or an installed wheel).
    """
    env = (spark or SparkSession.active()).sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def spread(spark: SparkSession) -> int:
    """Partitions for rows that are few but dear, which size alone would put into one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to all cores where it comes from fewer files than there are cores.

    Tables of many files are read by many tasks anyway and are left as they are.
    """
    n = spread(df.sparkSession)
    return df.repartition(n, key) if len(df.inputFiles()) < n else df
