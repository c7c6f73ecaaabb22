"""Connected components of an edge table, by alternating star contraction.

The large-star and small-star steps of Kiveris et al. ("Connected components in
MapReduce and beyond", 2014): each round points all neighbours of a node to the
smallest one. Rows stay distributed; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, drop, shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Each node's neighbours get its minimum."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back) if large else edges
    # The minimum is combined before the shuffle; AQE splits a hot u in the join.
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = around.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) for each node of an edge; component_id is the least node.

    Null ends and loops are left out, repeated edges count once, no edges give
    no rows.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    path = shared_dir(spark)
    e, state = cut(e, path), None
    while True:
        new_path = shared_dir(spark)
        e = cut(_star(_star(e, True), False), new_path)
        drop(spark, path)
        path = new_path
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
