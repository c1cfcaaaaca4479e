"""Linear models per (split_seed, outer_fold): exact solvers on each training set, scoring as a join.

A training set of one fold is one group, as the cohort of a study bounds it; folds and
seeds are dealt to tasks. Solvers work in the space of the rows, so wide features cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.metrics import sigmoid

BIAS = "(bias)"


def squared_hinge(k: np.ndarray, y: np.ndarray, c: float, rounds: int = 200) -> np.ndarray:
    """Row weights b with f = k @ b that minimise |w|^2 / 2 + c * sum(max(0, 1 - y f)^2); y is -1 or 1.

    On the rows within the margin the optimum solves a linear system; the set of these rows is found by Newton steps.
    """
    active = np.ones(len(y), bool)
    b = np.zeros(len(y))
    value = np.inf
    for _ in range(rounds):
        new = np.zeros(len(y))
        rows = np.flatnonzero(active)
        if len(rows):
            new[rows] = np.linalg.solve(k[np.ix_(rows, rows)] + np.eye(len(rows)) / (2 * c), y[rows])
        step = 1.0
        while True:
            trial = b + step * (new - b)
            f = k @ trial
            now = 0.5 * trial @ f + c * np.sum(np.maximum(0, 1 - y * f) ** 2)
            if now <= value + 1e-12 or step < 1e-6:
                break
            step /= 2
        b, value = trial, now
        margin = y * f < 1
        if step == 1.0 and (margin == active).all():
            return b
        active = margin
    return b


def logistic(k: np.ndarray, y: np.ndarray, c: float, rounds: int = 100) -> np.ndarray:
    """Row weights b with f = k @ b that minimise |w|^2 / 2 + c * sum(log(1 + exp(-y f))); y is -1 or 1."""
    b = np.zeros(len(y))
    for _ in range(rounds):
        f = k @ b
        p = 1 / (1 + np.exp(-y * f))
        w = np.maximum(p * (1 - p), 1e-12)
        target = f + y * (1 - p) / w
        new = np.linalg.solve(k + np.diag(1 / (c * w)), target)
        done = np.max(np.abs(new - b)) < 1e-12 * max(1.0, np.max(np.abs(new)))
        b = new
        if done:
            break
    return b


_SOLVERS = {"svm": squared_hinge, "logistic": logistic}


def _fit(solver: str, c: float, keys: Sequence[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        subjects, s = np.unique(rows["subject_id"].astype(str).to_numpy(), return_inverse=True)
        features, j = np.unique(rows["feature"].astype(str).to_numpy(), return_inverse=True)
        x = np.zeros((len(subjects), len(features)))
        x[s, j] = rows["value"].to_numpy(float)
        y = np.zeros(len(subjects))
        y[s] = np.where(rows["label"].to_numpy() == 1, 1.0, -1.0)
        if len(np.unique(y)) < 2:
            raise ValueError(f"training fold {key} has one class")
        b = _SOLVERS[solver](x @ x.T + 1.0, y, c)  # the bias is a constant feature, penalised like the others
        out = pd.DataFrame({"feature": [*features, BIAS], "coefficient": [*(x.T @ b), b.sum()]})
        return out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "feature", "coefficient"]]

    return run


def fit_linear(train: DataFrame, solver: str, c: float = 1.0, keys: Sequence[str] = ("split_seed", "outer_fold")) -> DataFrame:
    """(keys, feature, coefficient) from training rows (keys, subject_id, label, feature, value); features absent are 0."""
    if solver not in _SOLVERS:
        raise ValueError(f"unknown solver {solver!r}")
    kinds = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)
    rows = train.select(*keys, F.col("subject_id").cast("string"), "label", F.col("feature").cast("string"), "value")
    return rows.groupBy(*keys).applyInPandas(_fit(solver, c, keys), f"{kinds}, feature string, coefficient double")


def linear_score(rows: DataFrame, subjects: DataFrame, coefficients: DataFrame, keys: Sequence[str] = ("split_seed", "outer_fold")) -> DataFrame:
    """(keys, subject_id, decision_value, score): features (keys, subject_id, feature, value) times coefficients, plus the bias.

    `subjects` (keys, subject_id) names who is scored, also those without features.
    """
    weights = coefficients.where(F.col("feature") != BIAS)
    sums = rows.select(*keys, "subject_id", F.col("feature").cast("string").alias("feature"), "value").join(weights, [*keys, "feature"])
    sums = sums.groupBy(*keys, "subject_id").agg(F.sum(F.col("value") * F.col("coefficient")).alias("__s"))
    bias = coefficients.where(F.col("feature") == BIAS).select(*keys, F.col("coefficient").alias("__b"))
    out = subjects.select(*keys, "subject_id").join(sums, [*keys, "subject_id"], "left").join(bias, list(keys))
    decision = F.coalesce("__s", F.lit(0.0)) + F.col("__b")
    return out.select(*keys, "subject_id", decision.alias("decision_value"), sigmoid(decision).alias("score"))


def standardizer(rows: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """(keys, feature, mean, scale) over rows of training posts; population SD, 1 where a feature is constant."""
    scale = F.when(F.max(value) == F.min(value), F.lit(1.0)).otherwise(F.stddev_pop(value))
    return rows.groupBy(*keys, feature).agg(F.avg(value).alias("mean"), scale.alias("scale"))


def feature_moments(rows: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """(keys, feature, n, value, m2, low, high) of rows such as a subject's posts; `value` is the mean, m2 the sum of squared distances to it."""
    return rows.groupBy(*keys, feature).agg(F.count(value).alias("n"), F.avg(value).alias("value"), (F.var_pop(value) * F.count(value)).alias("m2"), F.min(value).alias("low"), F.max(value).alias("high"))


def pooled_standardizer(moments: DataFrame, keys: Sequence[str], feature: str = "feature") -> DataFrame:
    """As `standardizer`, from rows of `feature_moments`: folds then meet rows of subjects rather than of posts.

    The spread of the means is summed about the pooled mean, so nothing cancels.
    """
    mean = (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean")
    centre = moments.groupBy(*keys, feature).agg(mean)
    about = F.col("n") * (F.col("value") - F.col("mean")) ** 2
    scale = F.when(F.max("high") == F.min("low"), F.lit(1.0)).otherwise(F.sqrt(F.sum(F.col("m2") + about) / F.sum("n")))
    return moments.join(centre, [*keys, feature]).groupBy(*keys, feature).agg(F.first("mean").alias("mean"), scale.alias("scale"))


def standardize(rows: DataFrame, fitted: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    return rows.join(fitted, [*keys, feature]).withColumn(value, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def subject_means(rows: DataFrame, subjects: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, subject_id, feature, value): means over a subject's rows, zeros for a subject without rows."""
    means = rows.groupBy(*keys, "subject_id", "feature").agg(F.avg("value").alias("value"))
    every = subjects.select(*keys, "subject_id").withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    return every.join(means, [*keys, "subject_id", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
