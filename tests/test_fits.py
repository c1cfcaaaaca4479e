"""Queries that fit linear models do so by sums over all rows; no fold is gathered in a task."""

import os

import pytest
from pyspark.sql import functions as F

from weftline.operators import models as mod
from weftline.operators import newton
from weftline.plans import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


def gathered(*_):
    raise AssertionError("a fold is gathered in one task")


def scores(df):
    return {(r["split_seed"], r["outer_fold"], r["subject_id"]): r["decision_value"] for r in df.collect()}


def fit_by_group(monkeypatch, name, spark):
    """The query's scores with the solver of single groups in place of the sums."""
    with monkeypatch.context() as m:
        m.setattr(newton, "fit_distributed", mod.fit_linear)
        return scores(q.QUERIES[name](spark, DATA))


def same_without_groups(monkeypatch, name, spark):
    want = fit_by_group(monkeypatch, name, spark)
    monkeypatch.setattr(mod, "fit_linear", gathered)
    got = scores(q.QUERIES[name](spark, DATA))
    assert got.keys() == want.keys() and got and all(abs(got[k] - want[k]) <= 2e-6 for k in want)


def test_svm_of_folds_gathers_no_fold(spark, monkeypatch):
    same_without_groups(monkeypatch, "svm_fit_predict", spark)


def test_logistic_fit_of_folds_gathers_no_fold(spark, monkeypatch):
    same_without_groups(monkeypatch, "lr_fit_predict", spark)


def test_svm_of_characters_gathers_no_fold(spark, monkeypatch):
    same_without_groups(monkeypatch, "tfidf_svm", spark)


def test_rows_kept_between_passes_take_no_memory(spark, monkeypatch):
    stored = spark.sparkContext._jsc.sc().getRDDStorageInfo
    before, seen, sums = {r.id() for r in stored()}, [], newton._sums

    def watched(*args):
        seen.extend((r.memSize(), r.diskSize()) for r in stored() if r.id() not in before)
        return sums(*args)

    monkeypatch.setattr(newton, "_sums", watched)
    assert q.QUERIES["lr_fit_predict"](spark, DATA).count()
    assert any(disk for _, disk in seen) and not any(memory for memory, _ in seen)
