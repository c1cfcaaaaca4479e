"""Outer folds without gathering a label: against the sequential rule, on counts that end in mid-round or are all alike."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import folds


def by_hand(rows, k, seed):
    """Subjects in order, one by one: to the fold with fewest subjects, fewest posts, then the tie order."""
    out = {}
    for label in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == label), key=lambda r: (-r[2], hashlib.sha256(f"{seed}\x1fouter\x1f{label}\x1f{r[0]}".encode()).hexdigest(), r[0]))
        tie, n, posts = folds.tie_order(seed, label, k), [0] * k, [0] * k
        for r in own:
            f = min(range(k), key=lambda f: (n[f], posts[f], tie[f]))
            out[seed, r[0]] = f
            n[f] += 1
            posts[f] += r[2]
    return out


@pytest.mark.parametrize("k", [2, 3, 5])
@pytest.mark.parametrize("most", [1, 3, 9, 400])
def test_equals_the_sequential_rule(spark, k, most):
    draw = random.Random(most * 10 + k)
    rows = [(i, i % 3 % 2, draw.randint(0, most)) for i in range(301)]
    df = spark.createDataFrame(rows, "subject_id long, label_id int, split_post_count long")
    got = {(r.split_seed, r.subject_id): r.outer_fold for r in folds.outer_folds(df, [1, 2], k).collect()}
    assert got == by_hand(rows, k, 1) | by_hand(rows, k, 2)


def test_no_task_gathers_a_label(spark, monkeypatch):
    """What a Python task meets is a row per post count, whatever the number of subjects."""
    met = []
    plain = type(spark.range(1).groupBy("id")).applyInPandas

    def counted(self, f, schema):
        met.append(self._df)
        return plain(self, f, schema)

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", counted)
    df = spark.range(5000).select(F.col("id").alias("subject_id"), (F.col("id") % 2).cast("int").alias("label_id"), (F.col("id") % 7).alias("split_post_count"))
    assert folds.outer_folds(df, [1], 5).groupBy("outer_fold").count().count() == 5
    assert [d.count() for d in met] == [14]
