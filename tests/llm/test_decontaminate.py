"""Benchmark windows against a plain search."""

import random
import re

from weftline.llm.decontaminate import add_contamination, drop_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for key, item in items:
        own = words(item)
        n = min(10, len(own))
        if key is None or not n:
            continue
        for i in range(len(own) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == own[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"] + [f"w{i}" for i in range(12)] + ["é1", "été"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for k in range(25)] + [(98, None), (99, " -- "), (None, "lost item"), (3, "a second text of item three that is long enough to be one")]
    rows = [(0, None), (1, ""), (2, "...")]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(3)]
        if i % 2:
            own = (rng.choice(items[:25])[1]).split()
            at = rng.randrange(len(own))
            parts.insert(1, rng.choice([", ", "\n", "! "]).join(own[at:]).upper().replace("É", "é"))
        rows.append((10 + i % 40, " ".join(parts)))
    return rows, items


def test_spans_and_items(spark):
    for seed, block in ((1, 1 << 24), (2, 300)):  # the second takes the items in several blocks
        rows, items = case(seed)
        docs = spark.createDataFrame([(d, t, "keep") for d, t in rows], "doc_id long, text string, contamination string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = add_contamination(docs, bench, block_words=block).collect()
        seen = sorted((r.doc_id, r.text or "", r.contamination.n_words, sum(s.past - s.first for s in r.contamination.spans), sorted(r.contamination["items"])) for r in got)
        assert seen == sorted((d, t or "", *brute(t, items)) for d, t in rows)
        clean = drop_contaminated(docs, bench, block_words=block)
        assert clean.columns == docs.columns and sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for d, t in rows if not brute(t, items)[2])


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    r = add_contamination(docs, bench).first().contamination
    assert (r.n_words, r.spans, r["items"]) == (3, [], [])
    assert add_contamination(docs.limit(0), bench).count() == 0


def test_blocks_leave_one_index_and_merge_spans(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"t{i}" for i in range(40)) + " y"), (1, None), (2, "word " * 200_000), (3, "t0")], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"t{i}" for i in range(k, k + 12))) for k in range(28)] + [(100, "word")], "item_id long, text string")
    whole, blocks = (add_contamination(docs, items, block_words=w) for w in (1 << 20, 30))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(blocks) and whole.columns == blocks.columns
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # nothing is judged again when results are read
    assert add_contamination(docs.limit(0), items, block_words=30).count() == 0
