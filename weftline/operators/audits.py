"""Second computations of stored results: fitted scalers, decisions of linear models, summaries of benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import models, stats


def differences(stored: DataFrame, again: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, column, stored, again) wherever two tables differ by more than the tolerance, relative to 1 or the value.

    A row that one side lacks differs in every column; nulls and NaN equal only themselves.
    """
    side = lambda df, name: df.select(*keys, F.struct(*(F.col(v).cast("double").alias(v) for v in values)).alias(name))
    both = side(stored, "__s").join(side(again, "__a"), list(keys), "full_outer")
    cells = F.array(*(F.struct(F.lit(v).alias("column"), F.col(f"__s.{v}").alias("stored"), F.col(f"__a.{v}").alias("again")) for v in values))
    rows = both.select(*keys, F.col("__s").isNotNull().alias("__hs"), F.col("__a").isNotNull().alias("__ha"), F.inline(cells))
    near = F.abs(F.col("stored") - F.col("again")) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("again"))
    same = F.col("__hs") & F.col("__ha") & (F.col("stored").eqNullSafe(F.col("again")) | F.coalesce(near, F.lit(False)))
    return rows.where(~same).drop("__hs", "__ha")


def scaler_audit(training: DataFrame, stored: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Where a stored scaler (keys, feature, mean, scale) isn't what its training rows give."""
    return differences(stored, models.standardizer(training, keys), [*keys, "feature"], ["mean", "scale"], tolerance)


def decision_audit(features: DataFrame, coefficients: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("split_seed", "outer_fold"), tolerance: float = 1e-9) -> DataFrame:
    """Where stored decisions and scores aren't what the features and the stored coefficients give."""
    again = models.linear_score(features, predictions, coefficients, keys)
    return differences(predictions, again, [*keys, "subject_id"], ["decision_value", "score"], tolerance)


def summary_audit(predictions: DataFrame, stored: DataFrame, experiment: Sequence[str] = ("experiment",), tolerance: float = 1e-9) -> DataFrame:
    """Where a stored summary of repetitions isn't what the out-of-fold rows give."""
    return differences(stored, stats.repeated_summary(predictions, experiment), [*experiment, "metric"], ["n", "mean", "sample_sd", "ci95_low", "ci95_high"], tolerance)


def fusion_audit(primary: DataFrame, secondary: DataFrame, fused: DataFrame, weight: float, keys: Sequence[str] = ("split_seed", "subject_id"), tolerance: float = 1e-9) -> DataFrame:
    """Where stored fused scores aren't the weighted means of their two sides; the three must hold the same rows."""
    again = stats.fuse(primary, secondary, weight, keys=keys)
    return differences(fused, again, list(keys), ["label", "outer_fold", "score", "prediction"], tolerance)


def misaligned_sides(sides: dict[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, side, problem) over any number of tables that must hold the same rows: missing, repeated, or other values than the first side's.

    The tables are one tagged union, aggregated once, so three sides cost one shuffle and not two joins.
    """
    tagged = None
    for k, (_, df) in enumerate(sides.items()):
        part = df.select(*keys, F.lit(k).alias("__side"), F.xxhash64(*(F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in values)).alias("__v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    n = len(sides)
    own = lambda k, c: F.when(F.col("__side") == k, c)
    each = tagged.groupBy(*keys).agg(*(F.count(own(k, F.lit(1))).alias(f"__n{k}") for k in range(n)), *(F.min(own(k, F.col("__v"))).alias(f"__l{k}") for k in range(n)), *(F.max(own(k, F.col("__v"))).alias(f"__h{k}") for k in range(n)))
    found = []
    for k, name in enumerate(sides):
        other = (F.col(f"__n{k}") > 0) & (F.col("__n0") > 0) & ((F.col(f"__l{k}") != F.col("__l0")) | (F.col(f"__h{k}") != F.col("__h0")))
        for problem, bad in (("missing", F.col(f"__n{k}") == 0), ("repeated", F.col(f"__n{k}") > 1), ("other values", other)):
            found.append(F.when(bad, F.struct(F.lit(name).alias("side"), F.lit(problem).alias("problem"))))
    return each.select(*keys, F.inline(F.filter(F.array(*found), lambda r: r.isNotNull())))
