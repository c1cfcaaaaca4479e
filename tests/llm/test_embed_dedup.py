"""Near-duplicate vectors against all pairs by brute force."""

import numpy as np
import pytest

from weftline.llm import embed_dedup
from weftline.llm.embed_dedup import near_duplicate_vectors, passes_needed


def _brute(rows, threshold):
    ids = [i for i, _ in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                near[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(near[todo.pop()]).tolist():
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((ids[a], int(near[a].sum()), min((ids[b] for b in seen), key=lambda x: (x is None, x))))
    return sorted(out, key=str)


def _check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, root string")
    got = near_duplicate_vectors(df, **options).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == _brute(rows, options.get("threshold", 0.95))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_groups_chains_and_awkward_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + k, (base[0] + 0.02 * rng.standard_normal(16)).tolist()) for k in range(90)]  # tight, larger than the window
    rows += [(300 + k, (base[1] * np.cos(a) + base[2] * np.sin(a)).tolist()) for k, a in enumerate(np.linspace(0, 1.5, 40))]  # a chain
    rows += [(400 + k, (2.5 * base[3]).tolist()) for k in range(3)] + [(400, base[3].tolist()), (400, base[4].tolist())]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (None, base[0].tolist()), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [1e-200, 2e-200])]
    _check(spark, rows, window=8)


@pytest.mark.parametrize("cosine", [0.85, 0.9, 0.93])
def test_hot_direction(spark, cosine):
    # rows about one direction, mostly unlinked, with planted pairs; beside them others and a tight group
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hot = unit(np.sqrt(cosine) * unit(rng.standard_normal(64)) + np.sqrt(1 - cosine) * unit(rng.standard_normal((700, 64))))
    aside = rng.standard_normal((100, 64))
    aside = unit(aside - (aside * hot[:100]).sum(axis=1, keepdims=True) * hot[:100])
    planted = 0.952 * hot[:100] + np.sqrt(1 - 0.952**2) * aside
    tight = unit(hot[200] + 0.01 * rng.standard_normal((300, 64)))
    x = rng.permutation(np.concatenate([hot, planted, tight, unit(rng.standard_normal((900, 64)))]))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while (least := np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))).tolist() != label.tolist():
        label = least
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, window=4).collect())
    assert got == [(i, int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))]


def test_blocks_of_crowded_runs(spark, monkeypatch):
    # blocks smaller than runs and components: pairs of blocks of all kinds
    monkeypatch.setattr(embed_dedup, "_RUN_BLOCK", 50)
    test_hot_direction(spark, 0.9)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicate_vectors(df).count() == 0


@pytest.mark.parametrize("background", [0.0, 0.8, 0.88])
def test_recall_of_planted_pairs(spark, background):
    # all vectors share a direction; every planted pair is at 0.951 to 0.97
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(background) * unit(rng.standard_normal(64)) + np.sqrt(1 - background) * unit(rng.standard_normal((3000, 64))))
    cosines = rng.uniform(0.951, 0.97, (300, 1))
    aside = rng.standard_normal((300, 64))
    aside = unit(aside - (aside * x[:300]).sum(axis=1, keepdims=True) * x[:300])
    x = np.concatenate([x, cosines * x[:300] + np.sqrt(1 - cosines**2) * aside])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in near_duplicate_vectors(df, window=16).collect()}
    assert sum(got[3000 + i] == got[i] for i in range(300)) >= 297


def test_more_vectors_need_more_passes():
    assert passes_needed(10**9, 0.95, 32, 1e-4) > passes_needed(10**4, 0.95, 32, 1e-4) > 5
