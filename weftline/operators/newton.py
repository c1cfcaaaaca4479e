"""Linear models of many folds fitted by sums over all their rows: no fold is gathered anywhere.

All folds move together.  In each step tasks add up, for every fold, the objective, its gradient, and either the
curvature matrix (narrow features) or its product with a direction (wide ones, solved by conjugate gradients that the
curvature's diagonal preconditions); Spark sums them, and the driver, which holds coefficients and matrices alone, solves
and moves.  The objective is strongly convex with modulus 1, so coefficients are within the gradient's length of the
optimum, which is the stopping rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.models import BIAS

#: Coefficients of all folds together that driver and tasks hold; more are an error.
COEFFICIENTS = 1 << 24
#: Up to so many features (the bias included) the curvature is summed as a matrix, if all folds' matrices fit.
NARROW = 1024
#: Cells of rows that a task has spread out at once.
CELLS = 1 << 19

Losses = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def squared_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature by the margin y * f."""
    short = np.maximum(1 - margin, 0)
    return short * short, -2 * short, 2.0 * (short > 0)


def logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.exp(-np.logaddexp(0, margin))  # of the other class
    return np.logaddexp(0, -margin), -p, p * (1 - p)


LOSSES: dict[str, Losses] = {"svm": squared_hinge, "logistic": logistic}


class _Rows:
    """A batch of sparse rows in order of their folds."""

    def __init__(self, batch: pa.RecordBatch):
        fold, order = batch.column(0).to_numpy(), np.argsort(batch.column(0).to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        self.fold, self.y = fold[order], batch.column(1).to_numpy().astype(float)
        index, value = batch.column(2), batch.column(3)
        self.start = index.offsets.to_numpy() - index.offsets[0].as_py()
        self.index, self.value = index.flatten().to_numpy(), value.flatten().to_numpy()
        edges = np.flatnonzero(np.diff(self.fold)) + 1
        self.parts = list(zip(np.append(0, edges), np.append(edges, len(self.fold)), strict=True)) if len(self.fold) else []


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[_Rows]:
    """A batch cut so that each part has about `CELLS` cells, or as many in rows of a width that isn't 0."""
    index = batch.column(2)
    cells = len(index) * width or (index.offsets[-1].as_py() - index.offsets[0].as_py() if len(index) else 0)
    step = max(1, batch.num_rows * CELLS // max(cells, CELLS))
    for at in range(0, batch.num_rows, step):
        yield _Rows(batch.slice(at, step))


def _size(width: int, what: str) -> int:
    return 1 + width + (width * width if what == "matrix" else width)


def _sums(held, solver: str, width: int, what: str):
    """Rows (fold, at, x): at 0 the objective; then the gradient; then the curvature's matrix, diagonal or product."""
    loss = LOSSES[solver]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, along, c = held.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, (a, b) in ((r, part) for r in _slices(batch, width if what == "matrix" else 0) for part in r.parts):
                fold = int(rows.fold[a])
                if fold not in weights:
                    continue
                lo, hi = rows.start[a], rows.start[b]
                index, value, begin = rows.index[lo:hi], rows.value[lo:hi], rows.start[a:b] - lo
                row = np.repeat(np.arange(b - a), np.diff(np.append(begin, hi - lo)))
                y = rows.y[a:b]
                f = np.add.reduceat(value * weights[fold][index], begin)
                value0, slope, bend = loss(y * f)
                if fold not in total:
                    total[fold] = np.zeros(_size(width, what))
                out = total[fold]
                out[0] += c * value0.sum()
                out[1 : 1 + width] += np.bincount(index, c * value * (y * slope)[row], width)
                if what == "matrix":
                    x = np.bincount(row * width + index, value, (b - a) * width).reshape(b - a, width)
                    out[1 + width :] += (c * (x * bend[:, None]).T @ x).ravel()
                elif what == "product":
                    moved = np.add.reduceat(value * along[fold][index], begin)
                    out[1 + width :] += np.bincount(index, c * value * (bend * moved)[row], width)
                else:
                    out[1 + width :] += np.bincount(index, c * value * value * bend[row], width)
        for fold, v in total.items():
            if what == "matrix":  # one half tells the other
                v[1 + width :] = np.triu(v[1 + width :].reshape(width, width)).ravel()
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), fold, np.int32)), pa.array(at), pa.array(v[at])], ["fold", "at", "x"])

    return run


def fit_distributed(train: DataFrame, solver: str, c: float = 1.0, keys: Sequence[str] = ("split_seed", "outer_fold"), *, tolerance: float = 1e-8, rounds: int = 100, narrow: int = NARROW) -> DataFrame:
    """(keys, feature, coefficient) as `models.fit_linear` gives them, from the same rows (keys, subject_id, label, feature, value).

    Features absent are 0, repeated ones add up, and the bias is a constant feature, penalised like the others.
    A fold with one class is an error, as is one that hasn't come within `tolerance` of its optimum after `rounds`.
    """
    if solver not in LOSSES:
        raise ValueError(f"unknown solver {solver!r}")
    spark = train.sparkSession
    # read four times below, and the rows often come from long plans; on disk, as they grow with the input
    given = train.select(*keys, "subject_id", "label", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value")).persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(spark, given, solver, c, keys, tolerance, rounds, narrow)
    finally:
        given.unpersist()


def _fitted(spark: SparkSession, given: DataFrame, solver: str, c: float, keys: Sequence[str], tolerance: float, rounds: int, narrow: int) -> DataFrame:
    per_fold = given.groupBy(*keys).agg(F.countDistinct("label").alias("classes"))
    folds = [tuple(r) for r in per_fold.orderBy(*keys).limit(COEFFICIENTS).collect()]
    one = next((f[:-1] for f in folds if f[-1] < 2), None)
    if one is not None:
        raise ValueError(f"training fold {one} has one class")
    most = COEFFICIENTS // max(1, len(folds))
    features = [r[0] for r in given.select("feature").distinct().limit(most).collect()]
    if len(features) >= most:
        raise ValueError(f"more than {most} features in {len(folds)} folds: fit fewer seeds at once")
    features.sort()
    width = len(features) + 1
    kind = T.StructType([*(given.schema[k] for k in keys), T.StructField("fold", T.IntegerType())])
    of_fold = spark.createDataFrame([(*f[:-1], i) for i, f in enumerate(folds)], kind)
    of_feature = spark.createDataFrame(pd.DataFrame({"feature": [*features, BIAS], "at": np.arange(width, dtype=np.int32)}))
    # both tables are within the bound above; a subject's features are its own, so rows stay narrow
    cells = given.join(F.broadcast(of_fold), list(keys)).join(F.broadcast(of_feature), "feature")
    pair = F.struct("at", "value")
    subjects = cells.groupBy("fold", "subject_id").agg(F.max("label").alias("label"), F.collect_list(pair).alias("x"))
    x = F.concat("x", F.array(F.struct(F.lit(width - 1).alias("at"), F.lit(1.0).alias("value"))))
    rows = subjects.select("fold", F.when(F.col("label") == 1, 1).otherwise(-1).alias("y"), F.transform(x, lambda s: s["at"]).alias("index"), F.transform(x, lambda s: s["value"]).alias("value")).persist(StorageLevel.DISK_ONLY)
    matrix = width <= narrow and len(folds) * width * width <= COEFFICIENTS

    def ask(weights: dict[int, np.ndarray], what: str, along: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        held = spark.sparkContext.broadcast((weights, along, c))
        got = rows.mapInArrow(_sums(held, solver, width, what), "fold int, at bigint, x double").groupBy("fold", "at").agg(F.sum("x").alias("x")).toArrow()
        held.destroy()
        out = {i: np.zeros(_size(width, what)) for i in weights}
        fold, at, x = (col.to_numpy() for col in got.columns)
        for i in out:
            own = fold == i
            out[i][at[own]] = x[own]
            out[i][0] += weights[i] @ weights[i] / 2
            out[i][1 : 1 + width] += weights[i]
            if what == "matrix":
                half = out[i][1 + width :].reshape(width, width)
                half += np.triu(half, 1).T
        return out

    def directions(now: dict[int, np.ndarray], seen: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Newton's directions: (1 + curvature) d = -gradient."""
        slope = {i: v[1 : 1 + width] for i, v in seen.items()}
        if matrix:
            return {i: np.linalg.solve(np.eye(width) + v[1 + width :].reshape(width, width), -slope[i]) for i, v in seen.items()}
        d = {i: np.zeros(width) for i in now}
        scale = {i: 1 + v[1 + width :] for i, v in seen.items()}
        left = {i: -g for i, g in slope.items()}
        p = {i: r / scale[i] for i, r in left.items()}
        for _ in range(10 * width):
            goes = {i: p[i] for i in p if np.linalg.norm(left[i]) > min(0.1, np.sqrt(np.linalg.norm(slope[i]))) * np.linalg.norm(slope[i])}
            if not goes:
                break
            bent = ask({i: now[i] for i in goes}, "product", goes)
            for i, q in goes.items():
                h = q + bent[i][1 + width :]
                before = left[i] @ (left[i] / scale[i])
                step = before / (q @ h)
                d[i] += step * q
                left[i] = left[i] - step * h
                p[i] = left[i] / scale[i] + left[i] @ (left[i] / scale[i]) / before * q
        return d

    try:
        now = {i: np.zeros(width) for i in range(len(folds))}
        done: dict[int, np.ndarray] = {}
        seen = ask(now, "matrix" if matrix else "slope")
        for _ in range(rounds):
            done |= {i: now[i] for i in now if np.linalg.norm(seen[i][1 : 1 + width]) <= tolerance}
            now = {i: w for i, w in now.items() if i not in done}
            if not now:
                break
            move = directions(now, {i: seen[i] for i in now})
            share, waiting = dict.fromkeys(now, 1.0), dict(now)
            while waiting:  # halve the steps of folds whose objective would rise
                tried = {i: now[i] + share[i] * move[i] for i in waiting}
                found = ask(tried, "matrix" if matrix else "slope")
                for i in list(waiting):
                    if found[i][0] <= seen[i][0] + 1e-4 * share[i] * (seen[i][1 : 1 + width] @ move[i]) + 1e-12 * abs(seen[i][0]) or share[i] < 1e-8:
                        now[i], seen[i] = tried[i], found[i]
                        del waiting[i]
                    else:
                        share[i] /= 2
        if now:
            raise ValueError(f"{len(now)} folds haven't come within {tolerance} of their optimum")
    finally:
        rows.unpersist()
    names = [*features, BIAS]
    # a feature that a fold never met has coefficient 0 there and isn't named, as if it were fitted alone
    flat = spark.createDataFrame(pd.DataFrame({"fold": np.repeat(np.arange(len(folds), dtype=np.int32), width), "feature": names * len(folds), "coefficient": np.concatenate([done[i] for i in range(len(folds))]) if folds else np.empty(0)}), "fold int, feature string, coefficient double")
    return flat.where((F.col("coefficient") != 0) | (F.col("feature") == BIAS)).join(F.broadcast(of_fold), "fold").select(*keys, "feature", "coefficient")
