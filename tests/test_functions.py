"""Scalar functions, windows, folds, metrics and models on small cases with known results."""

import datetime as dt
import hashlib
import hmac
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import identity, metadata, text
from weftline.operators import constraints, folds, metrics, models, neural, pooling, stats, tfidf, windowing


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, place, want",
    [
        ("分享图片", None, ""),
        ("  分享视频\n", None, ""),
        ("诗句\n河边", "河边", "诗句"),
        ("诗句\n 河边 \n\n", " 河边", "诗句"),
        ("诗句\n别处", "河边", "诗句\n别处"),
        ("话\n某人的微博视频", None, "话"),
        ("分享图片\n一行", None, ""),
        ("分享图片\n一行\n二行", None, "分享图片\n一行\n二行"),
        ("a\r\nb\rc　 ", "", "a\nb\nc"),
        (None, None, ""),
        ("   ", "x", ""),
    ],
)
def test_clean_text(spark, raw, place, want):
    assert _one(spark, text.clean_text(F.col("t"), F.col("p")), t=raw, p=place) == want


def test_keywords(spark):
    words = ["OCD", "强迫症", "強迫症"]
    c = F.col("t")
    assert _one(spark, text.count_keywords(c, words), t="ocd，强迫症，OCD；強迫症") == 4
    assert _one(spark, text.mask_keywords(c, words), t="雨天OCD，晴天强迫症") == "雨天[MASK]，晴天[MASK]"
    assert _one(spark, text.mask_keywords(c, ["a+b"], r"$1\x"), t="A+B aab") == r"$1\x aab"
    assert _one(spark, text.contains_keywords(c, []), t="x") is False
    assert _one(spark, text.contains_keywords(c, words), t=None) is False
    assert _one(spark, text.mentions(c, words), t="my ocd") is True


def test_mentions_folds_case(spark):
    texts = ["STRASSE", "straße", "Straẞe", "ΌΣΟΣ", "όσος", "ﬁne", "ſo", "K", "plain", "", None, "İx", "ΟΔΟΣ"]
    words = ["Straße", "ΌΣΟΣ", "Fine", "SO", "k", "i̇x", "οδος"]
    for word in words:
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.mentions(F.col("t"), [word]).alias("m")).collect()
        assert [r.m for r in rows] == [t is not None and word.casefold() in t.casefold() for t in texts], word


@pytest.mark.parametrize("raw, want", [(" 12 ", 12), ("4.9", 4), ("-3", 0), ("", 0), ("abc", 0), ("4d", 0), ("1e3", 1000), ("inf", 0), ("nan", 0), (None, 0), ("1_000", 1000), ("7.", 7)])
def test_parse_count(spark, raw, want):
    assert _one(spark, metadata.parse_count(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026-01-02 03:04:05", dt.datetime(2026, 1, 2, 3, 4, 5)),
        ("2026-1-2 3:4", dt.datetime(2026, 1, 2, 3, 4)),
        ("2026/01/02 03:04", dt.datetime(2026, 1, 2, 3, 4)),
        (" 2026-01-02 ", dt.datetime(2026, 1, 2)),
        ("2026-01-02T03:04:05", dt.datetime(2026, 1, 2, 3, 4, 5)),
        ("2026-13-02", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_datetime(spark, raw, want):
    assert _one(spark, metadata.parse_datetime(F.col("t")), t=raw) == want


def test_metadata_vector(spark):
    at = F.lit("2026-01-01 06:00:00").cast("timestamp_ntz")
    v = _one(spark, metadata.metadata_vector(F.lit(3), F.lit(0), F.lit(1), at))
    assert v == pytest.approx([math.log(4), 0, math.log(2), 1, 0], abs=1e-12)
    none = F.lit(None).cast("timestamp_ntz")
    assert _one(spark, metadata.metadata_vector(F.lit(-1), F.lit(None).cast("int"), F.lit(0), none)) == [0, 0, 0, 0, 0]
    assert _one(spark, metadata.preferred(F.col("a"), F.col("b")), a=" ", b="x") == " "


def test_identity(spark):
    key = b"k" * 80
    want = hmac.new(key, b"subject\0g\x007", hashlib.sha256).hexdigest()[:24]
    assert _one(spark, identity.pseudonym(key, "subject", F.lit("g"), F.lit(7))) == f"subject-{want}"
    digest = hashlib.sha256("58\x1fouter\x1f1\x1fa".encode()).digest()
    assert _one(spark, identity.stable_random(58, F.lit("outer"), F.lit(1), F.lit("a"))) == pytest.approx(int.from_bytes(digest[:8], "big") / 2**64, abs=1e-15)
    for name, post, ordinal, ext in (("d/a_900_3.JPG", "900", 3, ".jpg"), ("a_900.png", "900", 1, ".png"), ("a_x_3.png", None, None, ".png"), ("plain", None, None, "<none>")):
        p, o = identity.media_name(F.lit(name))
        assert (_one(spark, p), _one(spark, o), _one(spark, identity.extension(F.lit(name)))) == (post, ordinal, ext)


def test_window_before_condition(spark):
    rows = [("s", None, "0", "x"), ("s", 1, "1", "rain"), ("s", 2, "2", "the OCD word"), ("s", 3, "3", "snow")]
    df = spark.createDataFrame(rows, "subject string, time int, id string, text string")
    window = windowing.recent(df, "subject", "time", "id", 2)
    assert [r.id for r in windowing.apply_condition(window, "text", "removed", ["ocd"]).collect()] == ["3"]
    assert sorted(r.id for r in windowing.recent(df, "subject", "time", "id", 3).collect()) == ["1", "2", "3"]
    n = windowing.numbered(df, "subject", "time", "id")
    assert {r.id: r.pos for r in n.collect()} == {"0": 0, "1": 1, "2": 2, "3": 3}


@pytest.mark.parametrize("n, k, want", [(7, 3, [0, 3, 6]), (7, 0, []), (7, 1, [0]), (2, 5, [0, 1]), (6, 3, [0, 2, 5])])
def test_even_sampling(spark, n, k, want):
    df = windowing.numbered(spark.range(n).selectExpr("0 AS s", "id"), "s", "id", "id")
    assert sorted(r.pos for r in windowing.evenly_sampled(df, k).collect()) == want == ([round(i * (n - 1) / (k - 1)) for i in range(k)] if n > k > 1 else want)


def _folds_by_hand(rows, k, seed):
    out = {}
    for label in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == label), key=lambda r: (-r[2], hashlib.sha256(f"{seed}\x1fouter\x1f{label}\x1f{r[0]}".encode()).hexdigest()))
        order = list(range(k))
        random.Random(seed + label).shuffle(order)
        n, posts = [0] * k, [0] * k
        for r in own:
            f = min(range(k), key=lambda f: (n[f], posts[f], order.index(f)))
            out[r[0]] = f
            n[f] += 1
            posts[f] += r[2]
    return out


def test_outer_folds_are_the_sequential_ones(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", i % 2, rng.randint(1, 64), 70) for i in range(83)]
    df = spark.createDataFrame(rows, "subject_id string, label_id int, split_post_count long, post_count long")
    outer = folds.outer_folds(df, [17, 42], 5)
    for seed in (17, 42):
        assert {r.subject_id: r.outer_fold for r in outer.where(F.col("split_seed") == seed).collect()} == _folds_by_hand(rows, 5, seed)
    nested = folds.nested_assignments(df, outer, 5, 0.125)
    assert folds.violations(nested, df, 5).count() == 0
    broken = nested.where("NOT (role = 'test' AND outer_fold = 0 AND split_seed = 17)")
    assert {r.rule for r in folds.violations(broken, df, 5).collect()} == {"empty role", "not tested once"}
    with pytest.raises(ValueError):
        folds.outer_folds(df.limit(3), [1], 5)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.4), (1, 1, 0.35), (1, 1, 0.8), (2, 1, 0.5)], "run int, label int, score double")
    got = {r.run: r for r in metrics.binary_metrics(df, ["run"]).collect()}
    assert got[1].roc_auc == 0.75 and (got[1].tp, got[1].tn, got[1].fp, got[1].fn) == (1, 2, 0, 1)
    assert got[2].roc_auc is None and got[2].tp == 1
    five = spark.createDataFrame([(0, float(v)) for v in range(1, 6)], "g int, v double")
    r = metrics.intervals(five, ["g"], "v").first()
    assert (r.n, r.mean) == (5, 3) and r.ci95_high == pytest.approx(3 + 2.776 * math.sqrt(2.5 / 5))
    z = 3.7
    assert _one(spark, metrics.bce(F.lit(z), F.lit(1))) == pytest.approx(math.log1p(math.exp(-z)))


def test_sign_flip_and_holm(spark):
    values = [0.3, -0.1, 0.4, 0.2, 0.05, 0.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, d double")
    seen = abs(sum(values))
    want = sum(abs(sum(s * v for s, v in zip(signs, values))) >= seen - 1e-12 for signs in itertools.product((-1, 1), repeat=6)) / 64
    assert stats.sign_flip_p(df, ["g"], "d").first().p == pytest.approx(want)
    ps = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03)], "f int, k string, p double")
    assert {r.k: round(r.p_holm, 9) for r in stats.holm(ps, ["f"], "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    with pytest.raises(Exception, match="more than"):
        stats.sign_flip_p(df, ["g"], "d", limit=3).collect()


def test_paired_family_and_fusion(spark):
    rows = [(c, s, "f1", 0.7 - 0.005 * (c == "small") + s / 1000) for c in ("full", "small") for s in range(58, 66)]
    df = spark.createDataFrame(rows, "experiment string, split_seed int, metric string, value double")
    r = stats.paired_family(df, "experiment", "full").first()
    assert r.mean == pytest.approx(-0.005) and (r.wins, r.losses) == (0, 8) and r.p == pytest.approx(2 / 256)
    with pytest.raises(Exception, match="unmatched"):
        stats.paired_family(df.where("NOT (experiment = 'small' AND split_seed = 60)"), "experiment", "full").collect()
    a = spark.createDataFrame([(58, "x", 0, 1, 0.8), (58, "y", 1, 0, 0.2)], "split_seed int, subject_id string, outer_fold int, label int, score double")
    b = a.withColumn("score", F.when(F.col("label") == 1, 0.6).otherwise(0.4))
    assert stats.fuse(a, b, 0.1).where("label = 1").first().score == pytest.approx(0.9 * 0.8 + 0.1 * 0.6)
    assert stats.fuse(a, b, 0.0).where("label = 1").first().score == 0.8
    with pytest.raises(Exception, match="differ"):
        stats.fuse(a, b.withColumn("outer_fold", F.lit(3)), 0.1).collect()


def test_fingerprints_ignore_fold_numbers(spark):
    df = spark.createDataFrame([(1, i % 3, f"s{i}") for i in range(9)], "split_seed int, outer_fold int, subject_id string")
    other = df.withColumn("outer_fold", (F.col("outer_fold") + 1) % 3)
    assert stats.partition_fingerprint(df, ["split_seed"]).collect() == stats.partition_fingerprint(other, ["split_seed"]).collect()
    preds = df.withColumn("role", F.lit("test")).withColumn("experiment", F.lit("e"))
    again = preds.unionByName(preds.withColumn("split_seed", F.lit(2)))
    assert [r.problem for r in stats.repetition_problems(again).collect()] == ["repeated partition"]
    with pytest.raises(Exception, match="several test rows"):
        stats.oof(preds.unionByName(preds), ["split_seed"]).collect()


@pytest.mark.parametrize("method", ["temporal_pyramid", "mean_std_halves", "segment_moments"])
def test_pooling(spark, method):
    e = np.array([[1, 0], [2, 0], [0, 3], [0, 4]], float)
    rows = [("s", i, v.tolist()) for i, v in enumerate(e)] + [("one", 0, [3.0, 4.0])]
    df = windowing.halves(windowing.numbered(spark.createDataFrame(rows, "s string, i int, e array<double>"), "s", "i", "i"))
    got = {r.s: r.pooled for r in pooling.pooled(df, "s", "e", method).collect()}
    parts = {"all": e, "early": e[:2], "late": e[2:]}
    want = np.concatenate([(x := getattr(parts[o], s)(axis=0)) / max(np.linalg.norm(x), 1e-12) for s, o in pooling.METHODS[method]])
    assert got["s"] == pytest.approx(want.tolist()) and len(got["s"]) == {"temporal_pyramid": 6, "mean_std_halves": 8, "segment_moments": 12}[method]
    assert all(map(math.isfinite, got["one"]))


def test_tfidf_vocabulary_is_train_only(spark):
    rows = [(i, ("阳性特征" if i % 2 else "阴性特征") + ("☃" if i < 2 else "常规文本")) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc int, text string")
    counts = tfidf.grams(docs, ["doc"], "text")
    train = docs.where("doc >= 2").select(F.lit(0).alias("fold"), "doc")
    idf = tfidf.fit_idf(counts, train, ["fold"], "doc", minimum=1)
    assert idf.where("gram LIKE '%☃%'").count() == 0
    w = tfidf.transform(counts, docs.select(F.lit(0).alias("fold"), "doc"), idf, ["fold"], "doc")
    assert all(r.n == pytest.approx(1) for r in w.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    two = tfidf.grams(spark.createDataFrame([(1, "A  b")], "doc int, text string"), ["doc"], "text")
    assert {r.gram for r in two.collect()} == {"a", " ", "b", "a ", " b"}


def test_solvers_reach_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 6))
    y = np.sign(x[:, 0] + 0.5 * rng.standard_normal(40))
    k = x @ x.T + 1
    a = np.column_stack([x, np.ones(40)])
    for c in (0.1, 1.0):
        b = models.squared_hinge(k, y, c)
        w = a.T @ b
        gap = np.maximum(0, 1 - y * (a @ w))
        assert np.abs(w - 2 * c * a.T @ (y * gap)).max() < 1e-8
        w = a.T @ models.logistic(k, y, c)
        assert np.abs(w - c * a.T @ (y / (1 + np.exp(y * (a @ w))))).max() < 1e-8


def test_constraints(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x")], "s int, pos int, v string")
    b = a.where("NOT (s = 2)")
    assert [r.s for r in constraints.unequal_sequences(a, b, "s", "pos", "v").collect()] == [2]
    assert constraints.rerun_differences(a, a.repartition(4)).count() == 0
    assert [r.only_in for r in constraints.unequal_sets(a, b, ["s"]).collect()] == ["left"]
    assert [r.v for r in constraints.inconsistent(a, "v", ["pos"]).collect()] == []
    assert [r.s for r in constraints.inconsistent(a, "s", ["v"]).collect()] == [1]
    x = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k int, v double")
    y = spark.createDataFrame([(1, 0.5 + 1e-13), (3, 0.5)], "k int, v double")
    assert sorted(r.k for r in constraints.not_close(x, y, ["k"], "v").collect()) == [2, 3]


def test_attention_ignores_masked_rows():
    rng = np.random.default_rng(1)
    q, k, v = (rng.standard_normal((4, 8)) for _ in range(3))
    mask = np.array([True, True, False, True])
    out, w = neural.attention(q, k, v, mask, 2)
    k2, v2 = k.copy(), v.copy()
    k2[2] = v2[2] = 99
    assert np.allclose(neural.attention(q, k2, v2, mask, 2)[0], out) and np.allclose(w.sum(-1), 1) and (w[:, :, 2] == 0).all()
    assert neural.gelu(np.array([1.0]))[0] == pytest.approx(0.8413447, abs=1e-6)
    assert np.allclose(neural.token_mean(v, mask, mask), v[0]) and np.allclose(neural.last_token(v, mask), v[3])


def test_clean_text_is_linear_in_white_space(spark):
    import time

    blank = " \n\t" * 300_000
    start = time.time()
    assert _one(spark, text.clean_text(F.col("t"), F.lit("x")), t=f"a{blank}b{blank}") == f"a{blank}b"
    assert time.time() - start < 20


def test_limits_after_the_condition(spark):
    rows = [(s, k, f"{k}") for s in ("a", "b", "c") for k in range(4)]
    df = spark.createDataFrame(rows, "s string, t int, k string")
    got = windowing.limited(df, "s", "t", "k", post_limit=2, subject_limit=2).collect()
    assert sorted((r.s, r.t) for r in got) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    late = df.withColumn("o", F.when(F.col("s") == "c", 0).otherwise(F.col("t") + 1))
    assert {r.s for r in windowing.limited(late, "s", "t", "k", subject_limit=1, subject_order="o").collect()} == {"c"}
    with pytest.raises(ValueError):
        windowing.limited(df, "s", "t", "k", post_limit=0)


def test_bad_labels_scores_and_missing_subjects_are_errors(spark):
    good = [("r", "a", "test", 0, 0.2), ("r", "b", "test", 1, 0.8)]
    kind = "run string, subject_id string, role string, label int, score double"
    for bad in (("r", "c", "test", 2, 0.5), ("r", "c", "test", 1, None), ("r", "c", "test", 1, float("nan"))):
        with pytest.raises(Exception, match="labels are 0 or 1"):
            metrics.binary_metrics(spark.createDataFrame([*good, bad], kind), ["run"]).collect()
    with pytest.raises(Exception, match="no rows"):
        metrics.binary_metrics(spark.createDataFrame([], kind), []).collect()
    assert stats.oof(spark.createDataFrame(good, kind), ["run"]).count() == 2
    with pytest.raises(Exception, match="one test row"):
        stats.oof(spark.createDataFrame([*good, ("r", "c", "train", 1, 0.5)], kind), ["run"]).collect()
    with pytest.raises(Exception, match="one test row"):
        stats.oof(spark.createDataFrame(good, kind), ["run"], spark.createDataFrame([("r", "z")], "run string, subject_id string")).collect()


def test_audits_notice_moved_missing_and_undefined_rows(spark):
    from weftline.operators import audits

    kind = "k int, v double, w double"
    stored = spark.createDataFrame([(1, 1.0, None), (2, 2.0, float("nan")), (3, 3.0, 0.0), (4, 4.0, 4.0)], kind)
    again = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 2.5, float("nan")), (4, 4.0, None), (5, 5.0, 5.0)], kind)
    found = audits.differences(stored, again, ["k"], ["v", "w"])
    assert sorted((r.k, r["column"]) for r in found.collect()) == [(2, "v"), (3, "v"), (3, "w"), (4, "w"), (5, "v"), (5, "w")]
    assert audits.differences(stored.limit(0), again.limit(0), ["k"], ["v", "w"]).count() == 0
    a = spark.createDataFrame([(58, f"s{i}", 0, i % 2, i / 10) for i in range(6)], "split_seed int, subject_id string, outer_fold int, label int, score double")
    b = a.withColumn("score", 1 - F.col("score"))
    fused = stats.fuse(a, b, 0.25)
    assert audits.fusion_audit(a, b, fused, 0.25).count() == 0
    moved = fused.withColumn("score", F.col("score") + (F.col("subject_id") == "s2").cast("double"))
    assert [(r.subject_id, r["column"], r.stored - r.again) for r in audits.fusion_audit(a, b, moved, 0.25).collect()] == [("s2", "score", pytest.approx(1.0))]


def test_auc_over_ranges_equals_auc_over_groups(spark):
    rows = [("a", k % 2, float((k * 37) % 101)) for k in range(400)] + [("b", int(k % 3 == 0), 0.5) for k in range(50)] + [("c", 1, 1.0)] + [("d", k % 2, k / 7) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    ask = lambda group, parts: sorted(map(tuple, metrics.roc_auc(df, group, "label", "score", parts).collect()))
    for parts in (2, 3, 7, 64):
        assert ask(["g"], parts) == ask(["g"], 1) and ask([], parts) == ask([], 1)
