"""The document index: reading, upserts, pruning and incremental planning.

An index is a set of DataFrames; a write produces the next state, which the
caller stores. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.constants import INDEX_VERSION
from tracewell.tables import cut


def join_index(index: DataFrame, features: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Indexed documents with their features, and an embedding where there is one."""
    return index.join(features, "filepath").join(embeddings, "filepath", "left")


def keep_longest(docs: DataFrame, hash_col: str = "file_hash", text_col: str = "full_text", time_col: str = "last_modified", key_col: str = "filepath") -> DataFrame:
    """One row for each content hash: the longest text, then the latest, then the least key.

    A null hash counts as the empty one, so all such rows are one group. Two
    aggregations of a struct take the place of a window: they combine before the
    shuffle, so a hash that many rows share is no hot partition.
    """
    order = F.struct((-F.length(text_col)).alias("a"), (-F.col(time_col)).alias("b"), F.col(key_col).alias("k"))
    h = F.coalesce(F.col(hash_col), F.lit(""))
    best = docs.groupBy(h.alias("__h")).agg(F.min(order).alias("__best")).select(F.col("__best.k").alias(key_col))
    return docs.join(best, key_col, "left_semi")


def prune(index: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to remove): those whose path the scan found or not."""
    return index.join(scanned, "filepath", "left_semi"), index.join(scanned, "filepath", "left_anti")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys, "filepath", "left_semi")


def upsert(current: DataFrame, changes: DataFrame, key: str, version: list[str], sticky: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """The last version of each key; a null in a sticky column keeps the older value.

    ``version`` orders the rows of a key; rows of ``changes`` must order after
    the current ones they replace. The aggregate combines before the shuffle.
    """
    rows = current.unionByName(changes, allowMissingColumns=True)
    order = F.struct(*version)
    sticks = [c for c in sticky if c in rows.columns]
    others = [c for c in rows.columns if c != key and c not in sticks]
    aggs = [F.max_by(F.struct(*others), order).alias("__row")]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in sticks]
    out = rows.groupBy(key).agg(*aggs)
    return out.select(*[F.col(c) if c == key or c in sticks else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def delete(current: DataFrame, keys: DataFrame, key: str = "filepath") -> DataFrame:
    return current.join(keys, key, "left_anti")


def unchanged(mtime: Column, size: Column, old_mtime: Column, old_size: Column) -> Column:
    return F.coalesce((F.abs(mtime - old_mtime) < 1.0) & (size == old_size), F.lit(False))


def up_to_date(mtime: Column, size: Column, file_hash: Column, old_mtime: Column, old_size: Column, old_hash: Column) -> Column:
    """Missing: no; another time: no; same size: yes; else by hash."""
    return (
        F.when(old_mtime.isNull(), F.lit(False))
        .when(F.abs(mtime - old_mtime) >= 1.0, F.lit(False))
        .when(size.isNotNull() & (size == old_size), F.lit(True))
        .otherwise(F.coalesce(file_hash == old_hash, F.lit(False)))
    )


def plan_index(scan: DataFrame, index: DataFrame, stored_version: int = INDEX_VERSION, version: int = INDEX_VERSION) -> DataFrame:
    """(filepath, action): insert, update, skip or delete.

    ``scan`` and ``index`` have filepath, file_size, last_modified and file_hash.
    An older stored version updates all documents.
    """
    old = index.select(
        "filepath", F.col("file_size").alias("old_size"), F.col("last_modified").alias("old_time"), F.col("file_hash").alias("old_hash"), F.lit(True).alias("indexed")
    )
    both = scan.select("filepath", "file_size", "last_modified", "file_hash", F.lit(True).alias("scanned")).join(old, "filepath", "full")
    fresh = unchanged(F.col("last_modified"), F.col("file_size"), F.col("old_time"), F.col("old_size")) | up_to_date(
        F.col("last_modified"), F.col("file_size"), F.col("file_hash"), F.col("old_time"), F.col("old_size"), F.col("old_hash")
    )
    action = (
        F.when(F.col("scanned").isNull(), F.lit("delete"))
        .when(F.col("indexed").isNull(), F.lit("insert"))
        .when(F.lit(stored_version < version), F.lit("update"))
        .when(fresh, F.lit("skip"))
        .otherwise(F.lit("update"))
    )
    return both.select("filepath", action.alias("action"))


def index_version(meta: DataFrame) -> DataFrame:
    """One row, the stored version; 0 where none is stored or it is no number."""
    stored = F.max(F.when(F.col("key") == "index_version", F.try_to_number("value", F.lit("999999999")).cast("int")))
    return meta.agg(F.coalesce(stored, F.lit(0)).alias("index_version"))


def set_index_version(meta: DataFrame, version: int) -> DataFrame:
    new = meta.sparkSession.createDataFrame([("index_version", str(version))], "key string, value string")
    return meta.select("key", "value").where("key <> 'index_version'").unionByName(new)


def positions(docs: DataFrame) -> DataFrame:
    """The corpus order as ``pos`` from 1: latest first, then by path (for reports; ranks all rows).

    A range-partitioned sort numbers the rows of each partition; the sizes of
    the partitions before it, one row each, are all that one task adds up.
    """
    placed = cut(docs.orderBy(F.desc("last_modified"), "filepath").withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    out = placed.withColumn("__part", part).join(sizes, "__part")
    return out.withColumn("pos", (F.col("__before") + row + 1).cast("long")).drop("__part", "__at", "__before")
