"""Keeping an index current from a stream of changes.

A file source cannot see deletions, so changes come as rows: a key, columns, a
version and an action (upsert or delete); the last write of a key wins.

The state is a list of runs, tables of the changes of one or more micro-batches. A
micro-batch writes a run of its own; a run that is not well smaller than the one
before it is merged with it, so runs grow geometrically: a row is written again as
often as the state doubles, not with each batch, and a reader merges a few runs. A
manifest, put in place by one rename, names the runs of a version. Until then the
version before is read, by readers that came in between too, and a repeated batch
finds its manifest and does nothing.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.store import upsert


def apply_changes(state: DataFrame | None, changes: DataFrame, key: str, version: list[str], action: str = "action") -> DataFrame:
    """The next state, deletions kept as rows so that late older changes stay out."""
    return changes if state is None else upsert(state, changes, key, version, sticky=())


def live(state: DataFrame, action: str = "action") -> DataFrame:
    return state.where(F.col(action) != "delete").drop(action)


class IndexSink:
    """A foreachBatch target: runs and manifests in ``folder``; what the last two versions need is kept."""

    #: A run is merged with the one before it unless that has so many times its rows.
    GROWTH = 2

    def __init__(self, folder: str, key: str, version: list[str]):
        self.folder, self.key, self.version = folder.rstrip("/"), key, version

    def _fs(self, spark: SparkSession, name: str = ""):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, spark: SparkSession, start: str) -> list[str]:
        fs, p = self._fs(spark)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if n.startswith(start))

    def _manifest(self, spark: SparkSession, name: str) -> list[tuple[str, int]]:
        """(name, rows) of a version's runs, the oldest first."""
        text = spark.read.text(f"{self.folder}/{name}").first()["value"]
        return [tuple(run) for run in json.loads(text)]

    def _publish(self, spark: SparkSession, batch: int, runs: list[tuple[str, int]]) -> None:
        fs, part = self._fs(spark, f".manifest-{batch:012d}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        fs.rename(part, self._fs(spark, f"manifest-{batch:012d}")[1])

    def runs(self, spark: SparkSession) -> list[tuple[str, int]]:
        names = self._names(spark, "manifest-")
        return self._manifest(spark, names[-1]) if names else []

    def _merged(self, spark: SparkSession, runs: list[str]) -> DataFrame:
        tables = [spark.read.parquet(f"{self.folder}/{r}") for r in runs]
        return tables[0] if len(tables) == 1 else reduce(lambda a, b: apply_changes(a, b, self.key, self.version), tables)

    def state(self, spark: SparkSession) -> DataFrame | None:
        """The last version of each key; None before the first batch."""
        found = self.runs(spark)
        return self._merged(spark, [name for name, _ in found]) if found else None

    def _write(self, spark: SparkSession, name: str, rows: DataFrame) -> tuple[str, int]:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name, spark.read.parquet(f"{self.folder}/{name}").count()

    def __call__(self, changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        done = self._names(spark, "manifest-")
        if done and int(done[-1].removeprefix("manifest-")) >= batch:
            return
        runs = self._manifest(spark, done[-1]) if done else []
        # The last change of each key alone: a run holds a key once.
        own = upsert(changes.limit(0), changes, self.key, self.version, sticky=())
        runs.append(self._write(spark, f"run-{batch:012d}-0", own))
        merges = 0
        while len(runs) > 1 and runs[-2][1] < self.GROWTH * runs[-1][1]:
            merges += 1  # names are of this batch, so a run that a reader has is never written over
            pair = self._merged(spark, [name for name, _ in runs[-2:]])
            runs[-2:] = [self._write(spark, f"run-{batch:012d}-{merges}", pair)]
        self._publish(spark, batch, runs)
        self._clean(spark, done[-1:], runs)

    def _clean(self, spark: SparkSession, before: list[str], runs: list[tuple[str, int]]) -> None:
        """Drop what neither this version nor the one before it names."""
        kept = {name for name, _ in runs} | {name for m in before for name, _ in self._manifest(spark, m)}
        old = [n for n in self._names(spark, "run-") if n not in kept] + [m for m in self._names(spark, "manifest-")[:-1] if m not in before]
        for name in old:
            fs, p = self._fs(spark, name)
            fs.delete(p, True)


def watch(changes: DataFrame, sink: IndexSink, checkpoint: str, once: bool = False):
    """Start the stream; ``once`` takes what is there and stops."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
