"""Trained operators: held-out accuracy, compiled rules, defined results of awkward rows."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import langid, quality, url_filter

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


@needs_data
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).select("score", "quality").collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.95


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc AB.!|#\n1é"), 80)) for _ in range(200)] + ["", None, "word " * 50_000]
    labels = [(i, int(t is not None and t.count("!") < 7), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, s string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, k long")
    model = quality.train_quality(docs, marks)
    assert model.rules
    measured = quality.with_statistics(docs).select("statistics", model.column(F.col("statistics")).alias("p")).collect()
    x = np.array([list(r.statistics) for r in measured])
    assert np.allclose(model.predict(x), [r.p for r in measured]) and np.isfinite(x).all()
    scored = quality.score_quality(docs, model)
    assert scored.count() == len(texts) and scored.where("score IS NULL").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0
    flat = quality.train_quality(docs, marks.where("quality = 1"))
    assert not flat.rules and flat.predict(x).min() > 0.9
    assert quality.train_quality(docs, marks.limit(0)).bias == 0


def test_lasso_reaches_the_optimum():
    rng = np.random.default_rng(0)
    r = (rng.random((300, 8)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 1])))).astype(float)
    w = quality.lasso_logistic(r, y, 0.01, steps=4000)
    p = 1 / (1 + np.exp(-(w[0] + r @ w[1:])))
    g = r.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-5 and (np.abs(g) < 0.01 + 1e-5).all() and np.allclose(g[w[1:] != 0], -0.01 * np.sign(w[1:][w[1:] != 0]), atol=1e-5)
    assert (w[1:] == 0).any()


@needs_data
def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train_languages(docs)
    rows = langid.identify_languages(docs, model).where(langid.held_out("doc_id")).select("lang", "language").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.language.lang for r in rows]) > 0.97


def test_language_mixtures_and_awkward_rows(spark):
    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, make("abcdef", 60), "aa") for i in range(40)] + [(100 + i, make("uvwxyz", 60), "zz") for i in range(40)] + [(200, make("абвгд", 60), None), (None, make("abcdef", 9), "aa")]
    model = langid.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(1, make("abcdef", 80)), (2, make("uvwxyz", 80).upper()), (3, make("abcdef", 120) + " " + make("uvwxyz", 60)), (4, None), (5, ""), (6, "123 !"), (7, "A"), (None, make("uvwxyz", 20)), (8, make("abcdef", 60_000))]
    docs = spark.createDataFrame([(d, t, "other") for d, t in tests], "doc_id long, text string, language string")
    found = langid.identify_languages(docs, model)
    got = {r.doc_id: r.language for r in found.collect()}
    assert [got[k].lang for k in (1, 2, 3, 4, 5, 6, None, 8)] == ["aa", "zz", "aa", "und", "und", "und", "zz", "aa"]
    assert set(got[3].mixture) == {"aa", "zz"} and got[3].mixture["aa"] == pytest.approx(2 / 3, abs=0.08) and set(got[1].mixture) == {"aa"}
    assert got[7].lang in ("aa", "zz") and 0 < got[7].score <= 1 and got[4].score == 0
    none = langid.train_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.language.lang for r in langid.identify_languages(docs, none).collect()} == {"und"}


def test_mixtures_equal_plain_em():
    rng = np.random.default_rng(8)
    log_p = np.log(rng.dirichlet(np.full(64, 0.3), 4).T).astype(np.float32)
    model = langid.LanguageModel(list("abcd"), log_p, 6.0, [0.25] * 4)
    mixes = [[1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.9, 0, 0.1, 0], [0.4, 0.3, 0.3, 0], [0.25] * 4, [0, 0.97, 0, 0.03]] * 4
    chance = np.exp(log_p.astype(float)) / np.exp(log_p.astype(float)).sum(axis=0)
    counts = [rng.multinomial(40 * 3 ** (i // 6), chance @ np.array(m)) for i, m in enumerate(mixes)]
    row, slot = np.nonzero(np.array(counts))
    rows, chosen = langid.infer(row, slot, np.array(counts)[row, slot], model)
    assert rows.tolist() == list(range(len(mixes)))

    def em(own, n, share, steps):
        for _ in range(steps):
            joint = [[pi * s for pi, s in zip(line, share)] for line in own]
            ll = sum(c * math.log(sum(j)) for c, j in zip(n, joint))
            share = [sum(c * j[k] / sum(j) for c, j in zip(n, joint)) / sum(n) for k in range(len(share))]
        return share, ll

    several = 0
    for r, count in enumerate(counts):
        at = np.flatnonzero(count)
        own, n = np.exp(log_p[at].astype(float)).tolist(), count[at].tolist()
        price = 6.0 * math.log(max(2, sum(n)))
        first, _ = em(own, n, [0.25] * 4, 8)
        order = sorted(range(4), key=lambda k: -first[k])
        singles = [sum(c * math.log(line[k]) for c, line in zip(n, own)) for k in range(4)]
        best, share = max(singles), [float(k == singles.index(max(singles))) for k in range(4)]
        for size in (2, 3, 4):
            begin = [max(first[k], 1e-6) if k in order[:size] else 0.0 for k in range(4)]
            fitted, ll = em(own, n, [b / sum(begin) for b in begin], 8)
            if ll - price * (size - 1) > best:
                best, share = ll - price * (size - 1), fitted
        several += sum(s > 0 for s in share) > 1
        assert np.allclose(chosen[r], share, atol=1e-6)
    assert 5 < several < len(counts)


def plain_statistics(text):
    """The statistics of a text by plain loops over characters, words and lines."""
    ascii_letter = lambda ch: "a" <= ch <= "z" or "A" <= ch <= "Z"
    small = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text)
    chars = max(1, len(text))
    words = [w for w in re.split("[ \\t\\n\\v\\f\\r]+", text) if w]
    plain = [w for w in re.split("[ \\t\\n\\v\\f\\r]+", small) if w]
    lines, plain_lines = [x for x in text.split("\n") if x], [x for x in small.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    length = lambda w: len(w.encode())
    # letters are bytes: each byte of a character beyond ASCII counts as one
    letters = lambda w: sum(1 if ascii_letter(ch) else length(ch) if ord(ch) > 127 else 0 for ch in w)
    capital = lambda w: sum("A" <= ch <= "Z" or "\u00c0" <= ch <= "\u00de" for ch in w)
    count = lambda signs: sum(ch in signs for ch in text) / chars
    pairs = list(zip(plain, plain[1:]))
    return {
        "log_chars": math.log1p(len(text)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)),
        "word_chars": chars / n, "line_words": n / m, "upper": capital(text) / max(1, letters(text)),
        "digit": count("0123456789"), "space": count(" \t\n\v\f\r"), "wide": sum(ord(ch) > 127 for ch in text) / chars,
        "stop_sign": count(".,;:?"), "bracket": count("()[]{}<>"), "exclaim": count("!"), "pipe": count("|"),
        "odd_sign": count("#$%&*"), "other_sign": count("\"'+-/=@\\^_`~"),
        "signed_word": sum(w[-1] in "#$%&*!|" for w in words) / n,
        "shout_word": sum(letters(w) == capital(w) > 2 for w in words) / n,
        "short_word": sum(length(w) <= 2 for w in words) / n, "long_word": sum(length(w) >= 14 for w in words) / n,
        "distinct_words": len(set(plain)) / n, "top_word": max(Counter(plain).values(), default=0) / n,
        "same_as_last": sum(a == b for a, b in pairs) / n, "distinct_pairs": len(set(pairs)) / n,
        "distinct_lines": len(set(plain_lines)) / m, "stopped_lines": sum(x[-1] in ".?!\"" for x in lines) / m,
    }


def test_statistics_equal_plain_loops(spark):
    rng = random.Random(9)
    texts = ["", None, "a", "\n\n", "One. one! ONE|\nTwo two\n\nTwo two", "É É éÀ ÜBER große", "x\v y\fz\r\n", "Æ中文 文 — ok"]
    texts += ["".join(rng.choice("abcAB é中É.!?|#$(\"-_7 \n\n  ") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_statistics(docs).collect():
        want = plain_statistics(texts[r.doc_id] or "")
        got = r.statistics.asDict()
        assert {k for k in want if not math.isclose(want[k], got[k], abs_tol=1e-9)} == set(), (texts[r.doc_id], want, got)
    assert set(want) == set(quality.STATISTICS)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_parts_and_rules(spark):
    rows = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"),
        ("https://example.net/fr", "example.net", "/fr", "net/"),
        ("x://badexample.com/de/", "badexample.com", "/de/", None),
        ("http://example.com/de/a://b", "example.com", "/de/a://b", "example.com/de/"),
        ("http://net", "net", "", None),
        ("http://É.org/fr/?q", "É.org", "/fr/", "org/fr/"),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("://h#f/", "h", "", None),
    ]
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(rows))] == [r[1:] for r in rows]
    assert got[1].verdict == "block" and got[0].verdict == "allow" and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    clash = df.select("url", F.col("page_id").alias("host"))
    assert {r.host_key: (r.host, r.verdict) for r in url_filter.filter_urls(clash, RULES, key="host").collect()} == {k: (r.host, r.verdict) for k, r in got.items()}


def test_long_and_repeated_urls(spark):
    rows = [(1, "http://a.org/fr/x"), (2, "http://example.com/de/y")] + [(None, "http://b.io/" + "long/" * 100_000), (None, None)] + [(None, "http://c.io/z")] * 3000
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(df, RULES).groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("verdict").alias("v")).collect()
    assert {r.host: (r.n, r.v) for r in got} == {"a.org": (1, 1), "example.com": (1, 1), "b.io": (1, 1), "": (1, 1), "c.io": (3000, 1)}


def markov_scores(texts, says):
    """Scores of all texts by brute force; those of a class 0 or 1 make the models."""
    symbols = [[256] * 5 + list(t.encode()) + [257] for t in texts]
    count = [Counter(), Counter()]
    for s, said in zip(symbols, says):
        if said is not None:
            for i in range(5, len(s)):
                for k in range(6):
                    count[said][tuple(s[i - k : i])] += 1
                    count[said][k, tuple(s[i - k : i + 1])] += 1
    out = []
    for s in symbols:
        total = 0.0
        for i in range(5, len(s)):
            p = [1 / 256, 1 / 256]
            for k in range(6):
                p = [(count[c][k, tuple(s[i - k : i + 1])] + 1.5 * p[c]) / (count[c][tuple(s[i - k : i])] + 1.5) for c in (0, 1)]
            total += math.log(p[1]) - math.log(p[0])
        out.append(total / (len(s) - 5))
    return out


def test_url_counts_grow_with_the_input(spark):
    # so many contexts that tables of a fixed size would mix them
    rng = random.Random(5)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    urls = [f"http://{name(12)}.{end}/{name(30)}" for end in ["net"] * 1800 + ["org/fr"] * 1800 + ["info"] * 300]
    texts = [u.partition("://")[2] for u in urls]
    says = [1 if ".org/fr/" in t else 0 if ".net/" in t else None for t in texts]
    score = markov_scores(urls, says)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.p_allow for r in url_filter.filter_urls(df, RULES).collect()}
    some = [i for i in range(len(urls)) if 1e-6 < got[i] < 1 - 1e-6]
    assert len(some) > 200
    x, logit = np.array([score[i] for i in some]), np.array([math.log(got[i] / (1 - got[i])) for i in some])
    slope, offset = np.polyfit(x, logit, 1)
    assert np.abs(slope * x + offset - logit).max() < 1e-6


def test_url_models_read_query_and_fragment(spark):
    rng = random.Random(6)
    slug = lambda words: "-".join(rng.choice(words) for _ in range(4))
    good, bad = ["garden", "river", "history", "music"], ["casino", "win777", "xxbonus", "pillz"]
    rows = [f"http://a.example.net/en/go{mark}to={slug(good)}" for mark in "?#" for _ in range(150)] + [f"http://a.example.net/fr/go{mark}to={slug(bad)}" for mark in "?#" for _ in range(150)]
    rows += [f"http://new.info/go{mark}to={slug(words)}" for words in (good, bad) for mark in "?#" for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, RULES).collect()}
    right = [got[600 + i] == ("allow" if i < 50 else "block") for i in range(100)]
    assert sum(right) > 90, sum(right)


def test_url_models_follow_the_text(spark):
    rng = random.Random(4)
    slug = lambda words: "-".join(rng.choice(words) for _ in range(4))
    good, bad = ["garden", "river", "history", "music"], ["casino", "win777", "xxbonus", "pillz"]
    rows = [(f"http://www.example.net/en/{slug(good)}",) for _ in range(300)] + [(f"http://b.net/{slug(bad)}",) for _ in range(300)]
    rows += [(f"http://new.info/{slug(good)}",) for _ in range(50)] + [(f"http://new.info/{slug(bad)}",) for _ in range(50)]
    df = spark.createDataFrame([(i, u) for i, (u,) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, RULES).collect()}
    assert np.mean([got[600 + i] == ("allow" if i < 50 else "block") for i in range(100)]) > 0.9
