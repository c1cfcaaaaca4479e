import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from weftline.llm import collocations as c

KIND = "doc_id long, text string, lang string, phrase string"


def plain(rows, least, longest=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        mine = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            mine.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        mine.sort(key=lambda m: (-m[0], -m[1], m[2].encode()))
        out += [(lang, k + 1, m[2], m[1], m[3], m[4], totals[lang], m[0]) for k, m in enumerate(mine[:top])]
    return sorted(out)


def got(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, t, g, "own") for i, (t, g) in enumerate(rows)], KIND).repartition(parts)
    return sorted(tuple(r) for r in c.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def invented(n, seed=1):
    draw = random.Random(seed)
    words = ["new", "york", "city", "The", "of", "é", "straße", "a-b", "x"]
    rows = []
    for _ in range(n):
        t = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(draw.randrange(40)))
        rows.append((t + draw.choice(["", "In New York City we trust", "one two three four five six seven"]), draw.choice(["en", "de", None, "und"])))
    return rows


def test_equals_plain_counting(spark):
    rows = [*invented(300), (None, "en"), ("", None), ("...", "fr"), ("alone", "fr"), *[("same row again and again", "es")] * 30]
    want = plain(rows, 12)
    assert len(want) > 50 and got(spark, rows, least=12) == want
    assert got(spark, rows, parts=1, least=12) == want


def test_first_ones_with_ties(spark):
    rows = [(f"{a} {b}", "en") for a, b in (("b", "a"), ("é", "z"), ("a", "c"), ("z", "é")) for _ in range(5)]
    assert got(spark, rows, least=5, top=3) == plain(rows, 5, top=3)


def test_small_buffers_and_ranges_change_nothing(spark, monkeypatch):
    rows = invented(200, 2)
    want = plain(rows, 8)
    monkeypatch.setattr(c, "POINTERS", 40)  # hot prefixes are split over many ranges
    assert got(spark, rows, least=8) == want


def test_long_text_and_no_rows(spark):
    rows = [("ab cd ef gh " * 30_000, "en")]
    assert got(spark, rows, least=100) == plain(rows, 100)
    assert got(spark, []) == [] and got(spark, [(None, None)]) == []


def test_shared_keys_are_found(spark, monkeypatch):
    rows = invented(50, 3)
    true, calls = c._count_words, []

    def clashing(seed):
        run = true(seed)

        def out(batches):
            for b in run(batches):
                if seed == 0:
                    b = pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int64)), *b.columns[1:]], b.schema.names)
                yield b

        calls.append(seed)
        return out

    monkeypatch.setattr(c, "_count_words", clashing)
    assert got(spark, rows, least=4) == plain(rows, 4) and calls == [0, 1]


def test_growth_is_depth_first_and_keeps_the_ends():
    words = np.array([[1, 2, 0], [1, 2, 3], [1, 2, 4], [5, 6, 0], [7, 8, 9]])
    found = list(c.grow(words, np.array([1, 2, 3, 1, 1]), 3))
    assert found == [([1, 2], 6), ([1, 2, 4], 3), ([7, 8], 1), ([7, 8, 9], 1)]
