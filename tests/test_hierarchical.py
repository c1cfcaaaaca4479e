import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import hierarchical as hi
from weftline.operators import training as tr

S = hi.HierarchicalSettings
CASES = [
    S(4, 6, post_attention_heads=2, user_attention_heads=2, representations=2, metadata_dimension=3, raw_mean_skip_dim=3, user_position_encoding="relative_bias", relative_position_max_distance=2),
    S(4, 6, embedding_prefix_dim=5, attention_inner_dim=6, user_attention_heads=3, user_position_encoding="sinusoidal", classifier_head="linear"),
    S(4, 6, representations=2, architecture_variant="without_post_cross_attention"),
    S(4, 6, metadata_dimension=2, architecture_variant="without_user_self_attention"),
    S(4, 6, representations=2, architecture_variant="mean_pooling_at_both_levels", raw_mean_skip_dim=2),
]


def data(s, n=5, r=4, seed=0):
    draw = np.random.default_rng(seed)
    size = np.array([0, 1, r, 2, 3])[:n]
    mask = np.arange(r)[None] < size[:, None]
    return draw.normal(size=(n, r, s.representations, s.embedding_dimension)) * mask[:, :, None, None], draw.normal(size=(n, r, s.metadata_dimension)) * mask[:, :, None], mask, draw.integers(0, 2, n).astype(float)


def parameters(s, seed=3):
    draw = np.random.default_rng(seed)
    return {k: v + 0.3 * draw.normal(size=v.shape) for k, v in hi.initial(s, seed).items()}


# ---- the same, one subject at a time, with loops ----


def lin(p, name, x):
    return [sum(w * a for w, a in zip(row, x)) + b for row, b in zip(p[f"{name}.weight"], p[f"{name}.bias"])]


def norm(p, name, x):
    m = sum(x) / len(x)
    sd = math.sqrt(sum((a - m) ** 2 for a in x) / len(x) + 1e-5)
    return [(a - m) / sd * g + b for a, g, b in zip(x, p[f"{name}.gain"], p[f"{name}.shift"])]


def act(x):
    return [a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in x]


def add(x, y):
    return [a + b for a, b in zip(x, y)]


def ffn(p, name, x):
    return add(x, lin(p, f"{name}.ffn_out", act(lin(p, f"{name}.ffn_in", norm(p, f"{name}.ffn_norm", x)))))


def attend(p, name, query, contexts, heads, bias):
    q, ks, vs = lin(p, f"{name}.query", query), [lin(p, f"{name}.key", c) for c in contexts], [lin(p, f"{name}.value", c) for c in contexts]
    width, out = len(q) // heads, []
    for h in range(heads):
        part = slice(h * width, (h + 1) * width)
        e = [math.exp(sum(a * b for a, b in zip(q[part], k[part])) / math.sqrt(width) + bias(j, h)) for j, k in enumerate(ks)]
        out += [sum(w * v[part][i] for w, v in zip(e, vs)) / sum(e) for i in range(width)]
    return lin(p, f"{name}.output", out)


def mean(rows, width):
    return [sum(r[i] for r in rows) / max(1, len(rows)) for i in range(width)]


def plain(s, p, posts):
    """posts: (content vectors, metadata) of one subject, none of them padding."""
    encoded = []
    for content, metadata in posts:
        tokens = [lin(p, f"content{k}", c if k else c[: s.prefix]) if f"content{k}.weight" in p else list(c[: s.prefix]) for k, c in enumerate(content)]
        if s.metadata_dimension:
            tokens.append(lin(p, "metadata", norm(p, "metadata_norm", metadata)))
        if s.attends_within_posts:
            q = list(p["post.class_query"])
            x = ffn(p, "post", add(q, attend(p, "post", norm(p, "post.query_norm", q), [norm(p, "post.context_norm", t) for t in tokens], s.post_attention_heads, lambda j, h: 0.0)))
        else:
            x = mean(tokens, s.d_model)
            x = ffn(p, "post", x) if s.architecture_variant == "without_post_cross_attention" else x
        encoded.append(x)
    if s.user_position_encoding == "sinusoidal":
        for at, x in enumerate(encoded):
            for i in range(0, s.d_model, 2):
                angle = at * 10000 ** (-i / s.d_model)
                x[i] += math.sin(angle)
                x[i + 1] += math.cos(angle)
    if s.attends_over_posts:
        told = [norm(p, "user.context_norm", x) for x in encoded]
        far = s.relative_position_max_distance
        bias = lambda i: (lambda j, h: p["user.relative"][max(-far, min(far, j - i)) + far][h] if far else 0.0)
        encoded = [ffn(p, "user", add(x, attend(p, "user", told[i], told, s.user_attention_heads, bias(i)))) for i, x in enumerate(encoded)]
    elif s.architecture_variant == "without_user_self_attention":
        encoded = [ffn(p, "user", x) for x in encoded]
    final = mean(encoded, s.d_model)
    if s.raw_mean_skip_dim:
        final += act(lin(p, "skip", norm(p, "skip_norm", mean([c[0] for c, _ in posts], s.embedding_dimension))))
    final = norm(p, "head_norm", final)
    return lin(p, "head_out", act(lin(p, "head_in", final)) if s.classifier_head == "mlp" else final)[0]


@pytest.mark.parametrize("s", CASES)
def test_forward_equals_plain_loops_and_masks_count_for_nothing(s):
    content, metadata, mask, _ = data(s)
    p = parameters(s)
    logits, shown, _ = hi.forward(s, hi.Layers(p), content, metadata, mask)
    for i in range(len(mask)):
        posts = [(content[i, j].tolist(), metadata[i, j].tolist()) for j in np.flatnonzero(mask[i])]
        assert abs(logits[i] - plain(s, p, posts)) < 5e-6
    dirty = content + np.where(mask, 0, 1e3)[:, :, None, None]
    assert np.allclose(hi.forward(s, hi.Layers(p), dirty, metadata + np.where(mask, 0, 7.0)[:, :, None], mask)[0], logits, atol=1e-12)
    if "user_attention" in shown:
        w = shown["user_attention"]
        assert np.allclose(w.sum(axis=-1), mask[:, None, :].astype(float)) and not w[0].any()


@pytest.mark.parametrize("s", CASES)
def test_derivatives_equal_finite_differences(s):
    content, metadata, mask, labels = data(s)
    p = parameters(s)
    flat = hi.pack(p)
    loss, slopes = hi.loss_and_slopes(s, p, content, metadata, mask, labels)
    got, draw = hi.pack(slopes), np.random.default_rng(1)
    at = lambda v: hi.loss_and_slopes(s, hi.unpack(s, v), content, metadata, mask, labels)[0]
    assert abs(loss - at(flat)) < 1e-12
    for _ in range(12):  # along random directions, and along single parameters
        d = draw.normal(size=len(flat))
        assert abs((at(flat + 1e-4 * d) - at(flat - 1e-4 * d)) / 2e-4 - got @ d) < 2e-3 * max(1, abs(got @ d))
    for k in draw.choice(len(flat), 25, replace=False):
        e = np.zeros(len(flat))
        e[k] = 1e-4
        assert abs((at(flat + e) - at(flat - e)) / 2e-4 - got[k]) < 2e-3


def test_settings_are_strict():
    for bad in ({"architecture_variant": "other"}, {"user_attention_heads": 3}, {"user_position_encoding": "relative_bias"}, {"embedding_prefix_dim": 9}, {"dropout": 1.0}):
        with pytest.raises(ValueError):
            S(4, 6, **bad)


# ---- on Spark ----

KIND = "subject_id string, pos int, vec array<double>, meta array<double>"


def cohort(spark, n=40):
    draw = np.random.default_rng(8)
    rows, who = [], []
    for i in range(n):
        label = i % 2
        who.append((f"s{i:02d}", label))
        rows += [(f"s{i:02d}", k, (draw.normal(size=6) + (2 * label - 1) * 0.8).tolist(), [float(k), 1.0]) for k in range(i % 4)]
    subjects = spark.createDataFrame(who, "subject_id string, label_id int")
    roles = [(seed, fold, s, y, "test" if i % 4 == fold else "validation" if i % 4 == 1 - fold else "train") for seed in (1, 2) for fold in (0, 1) for i, (s, y) in enumerate((w[0], w[1]) for w in sorted(who, key=lambda w: w[0][::-1]))]
    return spark.createDataFrame(rows, KIND), subjects, spark.createDataFrame(roles, "split_seed int, outer_fold int, subject_id string, label_id int, role string")


def test_training_lowers_the_loss_and_restores_the_best(spark):
    posts, subjects, roles = cohort(spark)
    s = S(4, 6, metadata_dimension=2, embedding_prefix_dim=6, ffn_hidden_dim=6, classifier_hidden_dim=6)
    how = tr.TrainingSettings(epochs=12, learning_rate=0.05, early_stopping_patience=3)
    seqs = tr.sequences(posts, subjects, ["vec"], 4, metadata="meta")
    models, history = tr.fit(seqs, roles, s, how, 4)
    rows = history.collect()
    for key in {(r["split_seed"], r["outer_fold"]) for r in rows}:
        own = sorted((r for r in rows if (r["split_seed"], r["outer_fold"]) == key), key=lambda r: r["epoch"])
        values = [r["validation_loss"] for r in own]
        assert [r["epoch"] for r in own] == list(range(len(own))) and sum(r["best"] for r in own) == 1
        assert min(values) < values[0] and own[int(np.argmin(values))]["best"]
        assert len(own) == 13 or len(own) - 1 - int(np.argmin(values)) == 3
    scored = tr.score(seqs, roles, models, s, 4)
    assert scored.count() == roles.count()
    # the stored state is that of the best epoch
    for key, loss in {(r["split_seed"], r["outer_fold"]): r["validation_loss"] for r in rows if r["best"]}.items():
        own = scored.where(f"split_seed = {key[0]} AND outer_fold = {key[1]} AND role = 'validation'").collect()
        z, y = np.array([r["decision_value"] for r in own]), np.array([r["label"] for r in own])
        assert abs(hi.logistic_loss(z, y) / len(own) - loss) < 1e-9


def test_partitions_dont_matter_even_with_dropout_and_steps(spark):
    posts, subjects, roles = cohort(spark)
    s = S(4, 6, embedding_prefix_dim=6, dropout=0.3)
    how = tr.TrainingSettings(epochs=3, learning_rate=0.02, steps=2)
    ask = lambda n: sorted(map(tuple, tr.fit(tr.sequences(posts.repartition(n), subjects.repartition(n), ["vec"], 4), roles.repartition(n), s, how, 4)[1].select("split_seed", "outer_fold", "epoch", "validation_loss").collect()))
    a, b = ask(1), ask(5)
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-9)


def test_too_many_posts_and_bad_vectors_are_errors(spark):
    posts, subjects, roles = cohort(spark)
    with pytest.raises(Exception, match="more than 2 posts"):
        tr.sequences(posts, subjects, ["vec"], 2).collect()
    s = S(4, 5)
    models = tr.to_table(spark, {(a, b): hi.initial(s, 0) for a in (1, 2) for b in (0, 1)})
    with pytest.raises(Exception, match="every post has 5 numbers"):
        tr.score(tr.sequences(posts, subjects, ["vec"], 4), roles, models, s, 4).collect()


def test_mean_mlp_is_a_case_of_the_model():
    from weftline.operators import neural

    s = tr.mean_mlp_settings(6, 5)
    p = parameters(s)
    content, metadata, mask, _ = data(s)
    weights = {"norm_gain": p["head_norm.gain"], "norm_shift": p["head_norm.shift"], "w1": p["head_in.weight"].T, "b1": p["head_in.bias"], "w2": p["head_out.weight"][0], "b2": p["head_out.bias"][0]}
    want = [neural.mean_mlp(content[i, :, 0], mask[i], weights) for i in range(len(mask))]
    assert np.allclose(hi.forward(s, hi.Layers(p), content, metadata, mask)[0], want, atol=1e-12)


def test_sweep_over_training_seeds(spark):
    posts, subjects, _ = cohort(spark)
    own = (F.substring("subject_id", 2, 2).cast("int") / 2).cast("int") % 3
    roles = subjects.select(F.lit(1).alias("split_seed"), F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("outer_fold"), "*").withColumn("role", F.when(own == F.col("outer_fold"), "test").when((own + 1) % 3 == F.col("outer_fold"), "validation").otherwise("train"))
    how = tr.TrainingSettings(epochs=4, learning_rate=0.05)
    predictions, summary = tr.sweep(tr.sequences(posts, subjects, ["vec"], 4), roles, tr.mean_mlp_settings(6, 4), how, 4, (3, 4))
    assert predictions.count() == 2 * roles.count()
    rows = {r["metric"]: r for r in summary.collect()}
    assert set(rows) == {"accuracy", "precision", "recall", "f1", "roc_auc"} and all(r["n"] == 2 and r["split_seed"] == 1 for r in rows.values())
    with pytest.raises(ValueError):
        tr.sweep(posts, roles, tr.mean_mlp_settings(6), how, 4, (3, 3))
