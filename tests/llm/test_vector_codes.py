import hashlib
import math

import numpy as np
import pytest

from weftline.llm.vector_codes import ApproximationFile, compress

KIND = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, parts=4, entries=8, rounds=2):
    """The same by comparing everything, in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in kept:
                own[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else e for e, xs in zip(book, own)]
    out = []
    for i, v, g in kept:
        found = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, g, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sums = {}
    for _, g, _, e in out:
        sums[g] = sums.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[g], digest) for i, g, c, e in out), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "own") for r in rows], KIND).repartition(3)
    found = compress(df, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equals_full_comparison_with_awkward_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=8) * draw.choice([0.01, 1, 30])).tolist(), [None, 1, 1, 2][i % 4]) for i in range(200)]
    rows += [(500 + i, [0.5] * 8, 1) for i in range(60)]  # repeated rows, and ties between equal entries
    rows += [(3, rows[3][1], 2), (None, rows[9][1], None)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [math.nan] + [1.0] * 7, 1), (903, [math.inf] * 8, None)]
    assert got(spark, rows, parts=4, entries=8) == plain(rows)


def test_fewer_vectors_than_entries_and_one(spark):
    rows = [(i, [i / 7, -i / 3, 0.1, 2.0], 0) for i in range(5)]
    assert got(spark, rows, parts=4, entries=64) == plain(rows, 4, 64)
    assert got(spark, rows[:1], parts=2, entries=64) == plain(rows[:1], 2, 64)


def test_no_rows_and_refused_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 3, 1)], [(1, [], 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="components|equal parts|64 bits"):
            got(spark, bad, parts=4)


def test_long_vectors(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=2048).tolist(), i % 2) for i in range(40)]
    assert got(spark, rows, parts=16, entries=8) == plain(rows, 16, 8)


def test_bounds_leave_the_nearest_and_rule_others_out():
    draw = np.random.default_rng(7)
    entries, x = draw.integers(-300, 300, (64, 4)), draw.integers(-400, 400, (500, 4))
    full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    left = ApproximationFile(entries).candidates(x)
    assert left[np.arange(500), full.argmin(axis=1)].all() and left.mean() < 0.5
    code, least = ApproximationFile(entries).nearest(x)
    assert (code == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
