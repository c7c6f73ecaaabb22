"""Mix sources to target weights by hash thresholds.

Each source's rows are put in a pseudo-random order by the hash of their id. A
source's budget is a whole number of passes over it and a remainder; the
remainder is a threshold in that order. It is found by nested histograms: sum
the words by source and hash bucket, find the bucket in which the running sum
crosses the budget, and split only that bucket by the next bits. Rows are then
filtered by comparing hashes; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import cut

#: Bits of the hash that one histogram resolves, and the number of histograms.
LEVEL_BITS, LEVELS = 12, 5
#: Keys that the rows of one source are dealt over in joins with its plan.
SALTS = 64
_BITS = LEVEL_BITS * LEVELS


def order_hash(id_col: Column, seed: str) -> Column:
    """60 bits of the md5 of seed and id; equal in other SQL engines."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Water-filling over (source, source_size): adds target.

    Sources in code point order, null last, weigh ``weights``, repeating. All of
    them get ``share`` times the total by weight, but none more than ``most``
    times its size; the excess goes to the others by weight. The table has one
    row for each source, so the single-partition windows here see no documents.
    """
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((at - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", each.alias("w"))
    cap = F.col("source_size") * F.lit(float(most))
    # Sources fill up in the order of cap / w. Before a source fills, the level is
    # (budget - caps of the full ones) / (weight of the others).
    fill = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(after))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # The level is that of the first source that does not fill. Levels fall from
    # there on, so it is the largest one below its own source's ratio.
    levels = levels.withColumn("final", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("final")))
    return levels.select("source", "source_size", target.alias("target"))


def _beside(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """Each row with columns of its source's plan; a source's rows are dealt over SALTS keys."""
    salted = plan.select(F.col("source").alias("s"), *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") % SALTS == F.col("salt"))).drop("salt")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken.

    size counts words (null text: 0). taken is the number of words that the mix
    takes from the document, repeats counted: as many whole passes as the
    source's target holds, and one more for documents whose hash lies below the
    source's threshold. The document in which the running sum crosses the budget
    gives only as many words as are left, so a source's sum is its target rounded.

    A null source is one more source, the last. Rows with equal ids (or null
    ids) share a hash; at the threshold they share what is left in equal parts,
    in proportion to size. Empty tables give no rows, other columns play no part.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            order_hash(F.col(id_col), seed).alias("h"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    goal = F.round("target").cast("long")
    # passes, and the words that are left for a part of the source
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    plan = cut(
        plan.withColumn("passes", passes.cast("long"))
        .withColumn("left", goal - F.col("passes") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
    )
    for level in range(1, LEVELS + 1):
        shift = _BITS - LEVEL_BITS * level
        bucket = F.shiftright("h", shift)
        # Only rows of the bucket on the boundary; sums meet before the shuffle.
        inside = _beside(rows, plan, "prefix").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        up = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
        hist = hist.join(
            plan.select(F.col("source").alias("s"), "left", F.col("below").alias("under")), F.col("source").eqNullSafe(F.col("s"))
        )
        # The boundary bucket is the first whose running sum passes what is left.
        edge = hist.where(F.col("under") + F.col("before") + F.col("n") > F.col("left"))
        edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("e"))
        edge = edge.select(F.col("source").alias("s"), "e.bucket", "e.before")
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "passes", "left",
            # nothing crosses: the source is used up, and the last bucket is passed
            F.coalesce("bucket", (F.col("prefix") + 1) * (1 << LEVEL_BITS)).alias("prefix"),
            (F.col("below") + F.coalesce("before", F.lit(0))).alias("below"),
        )
        plan = cut(plan)
    tied = _beside(rows, plan, "prefix").where("h = prefix").groupBy(F.col("s").alias("t")).agg(F.sum("size").alias("tied"))
    plan = cut(plan.join(tied, F.col("source").eqNullSafe(F.col("t")), "left").drop("t"))
    part = F.floor(F.col("size") * (F.col("left") - F.col("below")) / F.greatest(F.col("tied"), F.lit(1)))
    extra = F.when(F.col("h") < F.col("prefix"), F.col("size")).when(F.col("h") == F.col("prefix"), part).otherwise(F.lit(0))
    return _beside(rows, plan, "source_size", "target", "passes", "left", "prefix", "below", "tied").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"),
    )
