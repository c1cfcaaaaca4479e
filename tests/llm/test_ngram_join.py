"""Near-duplicate classes against all pairs by brute force, and components against union-find."""

import random
import re

import pytest

from weftline.llm import ngram_join
from weftline.llm.components import components
from weftline.llm.ngram_join import keep_one_per_class, near_duplicate_classes
from weftline.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least[top(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    rows = []
    passage = text(30)
    for _ in range(60):  # unrelated documents that share a passage
        rows.append(text(rng.randint(20, 120)) + passage + text(20))
    for n in (60, 200):  # near copies of an original, some too far from it
        base = text(n)
        for _ in range(70):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                own[rng.randrange(n)] = word()
            rows.append(own)
    chain = text(100)
    for _ in range(12):  # each near the one before only
        chain = chain[:]
        at = rng.randrange(95)
        chain[at : at + 2] = text(2)
        rows.append(chain)
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs += [(1000, docs[3][1].upper()), (1001, None), (1002, ""), (1003, " \n\t"), (1004, "one two"), (1005, "One\ttwo "), (1006, "one two three"), (1001, docs[5][1]), (5, docs[5][1]), (None, docs[5][1]), (None, None)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("few, side, wide", [(48, 256, 4096), (3, 16, 4096), (1, 8, 24)])
def test_classes_are_exact(spark, monkeypatch, few, side, wide):
    monkeypatch.setattr(ngram_join, "_FEW", few)
    monkeypatch.setattr(ngram_join, "_SIDE", side)
    monkeypatch.setattr(ngram_join, "_WIDE", wide)
    rows = corpus(few)
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, node long, root string").repartition(3)
    got = near_duplicate_classes(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_common_shingles_are_dealt_to_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_BUCKET", 8)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicate_classes(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_many_texts_under_one_id_and_templates_stay_linear(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(600):  # one id, 600 near copies of one text
        own = list(base)
        own[rng.randrange(120)] = word()
        rows.append((1, " ".join(own)))
    form = [word() for _ in range(130)]
    rows += [(10 + i, " ".join(form + [word() for _ in range(rng.randint(34, 40))])) for i in range(600)]  # share much, link with none
    compared = []
    join = ngram_join._Join.with_text
    monkeypatch.setattr(ngram_join._Join, "with_text", lambda self, *a: compared.append(join(self, *a)) or compared[-1])
    counted = []
    save = ngram_join.Scratch.save

    def saved(self, df, name):
        out = save(self, df, name)
        if name.endswith("-roles"):
            counted.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.Scratch, "save", saved)
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.component_id == 1 for r in got) == 600 and all(r.component_id == r.doc_id for r in got)
    assert sum(counted) < 2 * len(rows)


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = near_duplicate_classes(spark.createDataFrame([(2, long), (1, long + " end"), (3, "w1 " * 100_000)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 59_997, 1), (2, 59_996, 1), (3, 1, 3)}


def test_one_of_each_class_stays(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base, "a"), (2, base.upper(), "b"), (2, base.upper(), "b"), (7, "something else", "c"), (None, base, "d"), (9, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    kept = keep_one_per_class(df)
    assert kept.columns == df.columns and sorted(r.slot for r in kept.collect()) == ["b", "c", "d", "e"]
    assert near_duplicate_classes(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "test")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in root}
    assert components(df.limit(0), Scratch(spark, "test")).count() == 0
