"""Connected components by alternating large and small stars, on DataFrames.

Each round is two joins with grouped minima; its edges are written to the shared
folder, so lineage stays short.  Minima are pre-aggregated before shuffling and
joins on a hot node can be split by adaptive execution, so no node's neighbours
are gathered in one place.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: larger neighbours point to the least neighbour.  Small star: the smaller ones and the node itself do."""
    if larger:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long); root is the least node of its component.

    Loops and repeated edges change nothing; edges with a null end are ignored; no edges give no rows.
    """
    now = edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(now, f"{name}-0")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    round_ = 0
    while mark[0]:
        round_ += 1
        now = scratch.save(_stars(_stars(now, True), False), f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
