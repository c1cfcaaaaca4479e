"""Pooling of a subject's ordered vectors into one, as blocks of moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of each method: statistic and the records it is taken over.
METHODS = {
    "mean": [("mean", "all")],
    "temporal_pyramid": [("mean", "all"), ("mean", "early"), ("mean", "late")],
    "mean_std_halves": [("mean", "all"), ("std", "all"), ("mean", "early"), ("mean", "late")],
    "segment_moments": [("mean", "all"), ("std", "all"), ("mean", "early"), ("mean", "late"), ("std", "early"), ("std", "late")],
}


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def prefix(vector: Column, dims: int) -> Column:
    """The first dimensions of a vector whose prefixes are embeddings themselves."""
    return F.slice(vector, 1, dims)


def l2_normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def pooled_long(rows: DataFrame, subject: str, vector: str, method: str, *, normalize: bool = True) -> DataFrame:
    """(subject, block, dim, value) over rows with `early` and `late` (see windowing.halves); each block has unit length.

    Blocks are aggregates by subject and dimension, so partial sums combine before the shuffle and no subject's
    matrix is gathered; all blocks come from one pass.
    """
    flat = rows.select(subject, "early", "late", F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    pick = {"all": F.col("x"), "early": F.when(F.col("early"), F.col("x")), "late": F.when(F.col("late"), F.col("x"))}
    stat = {"mean": F.avg, "std": F.stddev_pop}
    wide = flat.groupBy(subject, "dim").agg(*(stat[s](pick[over]).alias(f"b{k}") for k, (s, over) in enumerate(METHODS[method])))
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), F.col(f"b{k}").alias("value")) for k in range(len(METHODS[method]))))
    long = wide.select(subject, "dim", F.inline(blocks))
    if not normalize:
        return long.select(subject, "block", "dim", "value")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(subject, "block")))
    return long.select(subject, "block", "dim", (F.col("value") / F.greatest(norm, F.lit(1e-12))).alias("value"))


def pooled(rows: DataFrame, subject: str, vector: str, method: str) -> DataFrame:
    """(subject, pooled: array) of the blocks one after the other."""
    long = pooled_long(rows, subject, vector, method)
    ordered = F.sort_array(F.collect_list(F.struct("block", "dim", "value")))
    return long.groupBy(subject).agg(F.transform(ordered, lambda s: s["value"]).alias("pooled"))
