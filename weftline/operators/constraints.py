"""Checks that return their violations, so that an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of `a` that `b` lacks, once each."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def unequal_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    return set_difference(a, b, keys).withColumn("only_in", F.lit("left")).unionByName(set_difference(b, a, keys).withColumn("only_in", F.lit("right")))


def rerun_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one of two runs has."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.select(*a.columns).exceptAll(a).withColumn("only_in", F.lit("right")))


def unequal_sequences(a: DataFrame, b: DataFrame, subject: str, position: str, value: str) -> DataFrame:
    """Subjects whose ordered values differ; compared position by position, no sequence is gathered."""
    x = a.select(subject, F.col(position).alias("__pos"), F.col(value).alias("__a"), F.lit(1).alias("__ina"))
    y = b.select(subject, F.col(position).alias("__pos"), F.col(value).alias("__b"), F.lit(1).alias("__inb"))
    both = x.join(y, [subject, "__pos"], "full_outer")
    same = F.col("__ina").isNotNull() & F.col("__inb").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))
    return both.where(~same).select(subject).distinct()


def inconsistent(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys for which one of the columns isn't constant."""
    spread = df.groupBy(key).agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns))
    return spread.where(F.greatest(*columns, F.lit(0)) > 1).select(key)


def not_close(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose values differ by more than the tolerance, or that one side lacks."""
    both = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), list(keys), "full_outer")
    return both.where(F.coalesce(F.abs(F.col("left") - F.col("right")) > tolerance, ~F.col("left").eqNullSafe(F.col("right"))))


def misaligned(predictions: DataFrame, assignments: DataFrame, run: Sequence[str]) -> DataFrame:
    """Out-of-fold rows whose (label, fold) isn't the split's, and test subjects without a row."""
    keys = [*run, "subject_id"]
    a = predictions.where("role = 'test'").select(*keys, "label", F.col("outer_fold").alias("fold"))
    b = assignments.where("role = 'test'").select(*keys, F.col("label_id").alias("__label"), F.col("outer_fold").alias("__fold"))
    return a.join(b, keys, "full_outer").where(~(F.col("label").eqNullSafe(F.col("__label")) & F.col("fold").eqNullSafe(F.col("__fold"))))


def leaks(features: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Rows where a modality that the condition excludes is present."""
    present = F.lit(False)
    for c in excluded:
        present = present | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    return features.where(present)
