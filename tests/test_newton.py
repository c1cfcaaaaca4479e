import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import newton
from weftline.operators.models import BIAS, fit_linear

KIND = "split_seed int, outer_fold int, subject_id string, label int, feature string, value double"


def rows(spark, n=60, p=6, folds=3, seed=0, dense=0.6):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = draw.normal(size=p) * (draw.random(p) < dense)
        label = int(x.sum() + draw.normal() > 0.2)
        for f in range(folds):
            if i % (folds + 1) != f:
                out += [(7, f, f"s{i}", label, f"f{k}", float(v)) for k, v in enumerate(x) if v] or [(7, f, f"s{i}", label, "f0", 0.0)]
    return spark.createDataFrame(out, KIND).repartition(5)


def coefficients(df):
    return {(r["split_seed"], r["outer_fold"], r["feature"]): r["coefficient"] for r in df.collect()}


@pytest.mark.parametrize("solver", ["svm", "logistic"])
@pytest.mark.parametrize("c", [0.1, 10.0])
def test_equals_the_solver_of_single_groups(spark, solver, c):
    train = rows(spark)
    want = coefficients(fit_linear(train, solver, c))
    got = coefficients(newton.fit_distributed(train, solver, c))
    assert all(abs(got.get(k, 0.0) - v) < 1e-6 for k, v in want.items()) and set(got) <= set(want)


@pytest.mark.parametrize("solver", ["svm", "logistic"])
def test_products_give_what_matrices_give(spark, solver):
    train = rows(spark, 40, 12, 2, 1, 0.4)
    a = coefficients(newton.fit_distributed(train, solver, 1.0))
    b = coefficients(newton.fit_distributed(train, solver, 1.0, narrow=0))
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_errors_and_bounds(spark, monkeypatch):
    train = rows(spark, 12, 3, 1)
    with pytest.raises(ValueError, match="one class"):
        newton.fit_distributed(train.withColumn("label", F.lit(1)), "svm")
    with pytest.raises(ValueError, match="optimum"):
        newton.fit_distributed(train, "logistic", rounds=1)
    with pytest.raises(ValueError, match="solver"):
        newton.fit_distributed(train, "other")
    monkeypatch.setattr(newton, "COEFFICIENTS", 3)
    with pytest.raises(ValueError, match="more than 3 features"):
        newton.fit_distributed(train, "svm")


def test_no_rows_and_repeated_cells(spark):
    assert newton.fit_distributed(spark.createDataFrame([], KIND), "svm").collect() == []
    twice = [(1, 0, s, y, "f", v) for s, y, v in (("a", 1, 0.5), ("a", 1, 0.5), ("b", 0, -1.0), ("c", 0, 0.2))]
    once = [(1, 0, "a", 1, "f", 1.0), *twice[2:]]
    a, b = (coefficients(newton.fit_distributed(spark.createDataFrame(r, KIND), "logistic")) for r in (twice, once))
    assert a == pytest.approx(b) and (1, 0, BIAS) in a


def test_many_subjects_without_a_dense_matrix(spark):
    """A fold of 300,000 subjects, whose square would be 720 GB."""
    base = spark.range(300_000).select(F.lit(1).alias("split_seed"), F.lit(0).alias("outer_fold"), "id", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("k"))
    value = (F.pmod(F.xxhash64("id", "k"), F.lit(2001)) - 1000) / 1000
    train = base.select("split_seed", "outer_fold", F.col("id").cast("string").alias("subject_id"), (F.pmod(F.xxhash64("id"), F.lit(10)) < 4).cast("int").alias("label"), F.concat(F.lit("f"), F.col("k")).alias("feature"), value.alias("value"))
    found = coefficients(newton.fit_distributed(train, "logistic", tolerance=1e-6))
    assert abs(found[1, 0, BIAS] - np.log(0.4 / 0.6)) < 0.02 and all(abs(v) < 0.05 for k, v in found.items() if k[2] != BIAS)
