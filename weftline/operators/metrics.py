"""Classification metrics by group, exact and without pairwise loops."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")

# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom; 1.96 beyond.
T_975 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def confusion(predictions: DataFrame, group: Sequence[str], label: str, prediction: str) -> DataFrame:
    cell = lambda p, y: F.sum(((F.col(prediction) == p) & (F.col(label) == y)).cast("long"))
    return predictions.groupBy(*group).agg(F.count("*").alias("n"), cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is."""
    c = F.col
    df = counts.withColumn("accuracy", _share(c("tp") + c("tn"), c("n"))).withColumn("precision", _share(c("tp"), c("tp") + c("fp"))).withColumn("recall", _share(c("tp"), c("tp") + c("fn")))
    return df.withColumn("f1", _share(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def roc_auc(predictions: DataFrame, group: Sequence[str], label: str, score: str, parts: int = 1) -> DataFrame:
    """Mann-Whitney with ties at half; null where a class is missing. Scores are grouped before they are ordered.

    With `parts` above 1 a group's scores are cut at that many of its quantiles, roughly found: the losers below a score
    are those of lower ranges, a sum carried over one row a range, and those below it in its own range. No window then
    holds a whole group, so groups may be of any size; the result is the same.
    """
    by_score = predictions.groupBy(*group, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    keys = list(group)

    def before(within: Sequence[str], order: str) -> Column:
        return F.sum("q").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("q")

    def summed(df: DataFrame, within: Sequence[str]) -> DataFrame:
        wins = df.withColumn("w", F.col("p") * (before(within, score) + F.col("q") / 2))
        return wins.groupBy(*within).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))

    if parts > 1:
        cuts = [k / parts for k in range(1, parts)]
        step = math.isqrt(parts - 1) + 1  # every step-th cut is looked at first, then those up to the next
        bounds = by_score.groupBy(*keys).agg(F.percentile_approx(score, cuts, 20 * parts).alias("__cuts"))
        bounds = bounds.withColumn("__marks", F.array(*(F.get("__cuts", F.lit(k - 1)) for k in range(step, parts, step))))
        cut = by_score.join(bounds, keys) if keys else by_score.join(F.broadcast(bounds))  # a row a group
        below = lambda some: F.size(F.filter(some, lambda c: c < F.col(score)))
        cut = cut.withColumn("__mark", below(F.col("__marks")) * step)
        cut = cut.withColumn("__part", F.col("__mark") + below(F.slice("__cuts", F.col("__mark") + 1, F.lit(step - 1)))).drop("__cuts", "__marks", "__mark")
        ranges = summed(cut, [*keys, "__part"])
        ranges = ranges.withColumn("w", F.col("w") + F.col("p") * before(keys, "__part"))
        total = ranges.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    else:
        total = summed(by_score, keys)
    return total.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("roc_auc"))


def binary_metrics(predictions: DataFrame, group: Sequence[str], label: str = "label", score: str = "score", threshold: float = 0.5, parts: int = 1) -> DataFrame:
    """All metrics of each group; a score at the threshold is positive. `parts` is that of `roc_auc`, for large groups.

    A label other than 0 and 1, a score that is null or NaN and, without groups, an empty input are errors.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is between 0 and 1")
    fine = F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    bad = F.raise_error(F.lit("labels are 0 or 1 and scores are numbers"))
    sound = predictions.withColumn(label, F.when(F.coalesce(fine, F.lit(False)), F.col(label)).otherwise(bad))
    counts = rates(confusion(sound.withColumn("__p", (F.col(score) >= threshold).cast("int")), group, label, "__p"))
    if group:
        return counts.join(roc_auc(sound, group, label, score, parts), list(group))
    some = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no rows to judge")))
    return counts.withColumn("n", some).join(roc_auc(sound, group, label, score, parts))  # one row each


def t_critical(n: Column) -> Column:
    """For n values; null below two."""
    table = F.array(*map(F.lit, T_975))
    return F.when(n >= 2, F.coalesce(F.get(table, (n - 2).cast("int")), F.lit(1.96)))


def moments(value: str) -> list[Column]:
    """Aggregates that `with_interval` needs: n, mean, sample SD."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd")]


def intervals(values: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample SD and 95 % interval; spread is null for one value."""
    return with_interval(values.groupBy(*group).agg(*moments(value)))


def with_interval(df: DataFrame) -> DataFrame:
    margin = t_critical(F.col("n")) * F.col("sample_sd") / F.sqrt("n")
    return df.withColumn("ci95_low", F.col("mean") - margin).withColumn("ci95_high", F.col("mean") + margin)


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = METRICS) -> DataFrame:
    """(keys, metric, value)."""
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.inline(cells))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
