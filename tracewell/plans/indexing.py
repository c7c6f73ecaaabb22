"""An index of Word files that persists: scanned, planned, parsed and stored incrementally.

A store is a folder with one table of document features for each state of the
index, named by its number, and one of key-value rows beside it. Only files that
are new or changed are opened; a state that does not change is not written again.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.constants import INDEX_VERSION
from tracewell.operators import store
from tracewell.operators.semantic import embed
from tracewell.sources.files import docx_documents, scan
from tracewell.workers import prepare

Progress = Callable[[int, int, str], None]
_FILE = "filepath string, filename string, folder_name string, file_size bigint, last_modified double"


def _read(path: str) -> bytes | None:
    """A file's bytes; None where it has gone or cannot be read."""
    try:
        fs, p = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
        with fs.open_input_stream(p) as f:
            return f.read()
    except OSError:
        return None


def _contents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file at a time, so a batch never holds many of them."""
    for batch in it:
        for i in range(batch.num_rows):
            row, body = batch.slice(i, 1), _read(batch.column(0)[i].as_py())
            if body is not None:
                digest = hashlib.sha256(body).hexdigest()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body], pa.binary()), pa.array([digest])], [*row.schema.names, "content", "file_hash"])


class Store:
    """States of an index in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}-{n:09d}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def last(self) -> int:
        """The number of the last whole state, 0 if there is none; its meta table is written last."""
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return 0
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
        return max((int(n.removeprefix("meta-")) for n, at in names if n.startswith("meta-") and fs.exists(at.suffix("/_SUCCESS"))), default=0)

    def documents(self) -> DataFrame | None:
        n = self.last()
        return self.spark.read.parquet(self._path("documents", n)) if n else None

    def meta(self) -> DataFrame:
        n = self.last()
        return self.spark.read.parquet(self._path("meta", n)) if n else self.spark.createDataFrame([], "key string, value string")

    def save(self, documents: DataFrame) -> None:
        """The next state; the one before it stays for readers, older ones go."""
        n, meta = self.last(), store.set_index_version(self.meta(), INDEX_VERSION)
        documents.write.mode("overwrite").parquet(self._path("documents", n + 1))
        meta.write.mode("overwrite").parquet(self._path("meta", n + 1))
        for kind in ("documents", "meta"):
            fs, p = self._fs(self._path(kind, n - 1))
            fs.delete(p, True)


def refresh(spark: SparkSession, folder: str, target: str, recursive: bool = True, progress: Progress | None = None, model: Callable | None = None) -> DataFrame:
    """Bring the index in ``target`` up to date with ``folder``; its documents.

    Files whose time and size are those of the index stay as they are. Others are
    opened and hashed; those of equal content and time stay too, the rest is parsed.
    Files that have gone leave the index. An index of an older version is made anew.
    ``progress`` is told (done, total, message) before and after parsing; ``model``
    gives parsed documents an embedding.
    """
    prepare(spark)
    tell = progress or (lambda done, total, message: None)
    at = Store(spark, target)
    held = at.documents()
    found = scan(spark, folder, recursive).drop("content")
    old_version = held is not None and store.index_version(at.meta()).first()[0] < INDEX_VERSION
    old = ["filepath", "file_size", "last_modified", "file_hash"]
    if held is None or old_version:
        changed = found
    else:
        before = held.select("filepath", *[F.col(c).alias(f"old_{c}") for c in old[1:]])
        same = F.coalesce(store.unchanged(F.col("last_modified"), F.col("file_size"), F.col("old_last_modified"), F.col("old_file_size")), F.lit(False))
        changed = found.join(before, "filepath", "left").where(~same).select(*found.columns)
    opened = changed.mapInArrow(_contents, f"{_FILE}, content binary, file_hash string")
    if held is not None and not old_version:
        before = held.select("filepath", *[F.col(c).alias(f"old_{c}") for c in old[1:]])
        fresh = store.up_to_date(*[F.col(c) for c in ("last_modified", "file_size", "file_hash", "old_last_modified", "old_file_size", "old_file_hash")])
        opened = opened.join(before, "filepath", "left").where(~fresh).select(*found.columns, "content")
    total = changed.count()
    if held is not None and not total and not old_version:
        _, gone = store.prune(held, found)
        if gone.isEmpty():
            tell(0, 0, "All document indexes are up to date.")
            return held
    tell(0, total, "Indexing")
    parsed = docx_documents(opened.select(*found.columns, "content"))
    if model is not None:
        parsed = embed(parsed, model)
    kept = parsed if held is None or old_version else _replaced(held, found, parsed)
    at.save(kept)
    tell(total, total, "Indexed")
    return at.documents()


def _replaced(held: DataFrame, found: DataFrame, parsed: DataFrame) -> DataFrame:
    """The next state: rows of files that are still there, parsed ones in place of older ones.

    Each row's version is its turn, so the last one wins; an embedding that a new row lacks stays.
    """
    kept, _ = store.prune(held, found)
    rows = store.upsert(kept.withColumn("turn", F.lit(0)), parsed.withColumn("turn", F.lit(1)), "filepath", ["turn"])
    return rows.drop("turn")
