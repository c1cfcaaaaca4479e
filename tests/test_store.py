import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import models as mod
from weftline.operators.neural import stub_encoder
from weftline.plans import build, store

POSTS = "subject_id string, post_id string, published_at timestamp_ntz, cleaned_text string, metadata_vector array<double>"


def tables(spark, n=30):
    subjects, posts, media = [], [], []
    for i in range(n):
        s = f"s{i:02d}"
        subjects.append((s, i % 2, i != 7, i % 6))
        for k in range(i % 6):
            posts.append((s, f"p{k}", datetime.datetime(2020, 1, 1 + k), ["a secret plan", "hello", "", None, "Secret again"][k], [float(k), 1.0]))
            media += [(s, f"m{i}-{k}-{j}", f"p{k}", "image" if j < 3 else "live_photo", j) for j in range(k * 2)]
    return {
        "subjects": spark.createDataFrame(subjects, "subject_id string, label_id int, eligible boolean, post_count long"),
        "posts": spark.createDataFrame(posts, POSTS),
        "media": spark.createDataFrame(media, "subject_id string, media_id string, post_id string, kind string, ordinal int"),
    }


MANIFEST = {"kind": "prepared", "id": "prepared-1", "maximum_posts": 4}


@pytest.fixture
def prepared(spark, tmp_path):
    store.publish(spark, {f"{tmp_path}/set": (tables(spark), MANIFEST)}, buckets=5)
    return store.Prepared(spark, f"{tmp_path}/set")


def test_lookups_read_their_buckets_alone(spark, prepared):
    found = prepared.posts(["s05", "s11"])
    assert sorted({r["subject_id"] for r in found.collect()}) == ["s05", "s11"] and found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert found.select(F.input_file_name()).distinct().count() <= 2 < prepared.table("posts").select(F.input_file_name()).distinct().count()
    assert prepared.subjects().count() == 29 and prepared.subjects(eligible_only=False).count() == 30
    assert prepared.subjects().agg(F.max("split_post_count")).first()[0] == 4


def test_conditions_follow_the_window(prepared):
    latest = prepared.posts(["s05"], maximum_posts=2, condition="removed", keywords=["secret"])
    assert [r["post_id"] for r in latest.collect()] == ["p3"]  # p4 is removed, p2 isn't taken for it
    masked = prepared.posts(["s05"], maximum_posts=2, condition="masked", keywords=["secret"])
    assert {r["cleaned_text"] for r in masked.collect()} == {None, "[MASK] again"}
    for bad in ({"condition": "other"}, {"maximum_posts": 0}):
        with pytest.raises(ValueError):
            prepared.posts(**bad)


def test_incomplete_and_foreign_sets_are_refused(spark, tmp_path, prepared):
    at = prepared.path
    with pytest.raises(ValueError, match="isn't 'features'|not 'features'"):
        store.FeatureSet(spark, at)
    with pytest.raises(ValueError, match="not 'other'"):
        store.Prepared(spark, at, identity="other")
    with pytest.raises(FileNotFoundError):
        store.Prepared(spark, f"{tmp_path}/none")
    for change, match in (({"version": 0}, "version"), ({"complete": False}, "complete")):
        manifest = json.load(open(f"{at}/manifest.json"))
        store.Files(spark).write_json(manifest | change, f"{at}/manifest.json")
        with pytest.raises(ValueError, match=match):
            store.Prepared(spark, at)
        store.Files(spark).write_json(manifest, f"{at}/manifest.json")
    os.remove(f"{at}/media/_SUCCESS")
    with pytest.raises(ValueError, match="lacks the table media"):
        store.Prepared(spark, at)


class Failing(store.Files):
    """Fails at the n-th change."""

    def __init__(self, spark, at):
        super().__init__(spark)
        self.left = at

    def _step(self):
        self.left -= 1
        if self.left < 0:
            raise OSError("planted")

    def move(self, a, b):
        self._step()
        super().move(a, b)

    def write_json(self, value, path):
        self._step()
        super().write_json(value, path)


def test_a_failure_anywhere_leaves_nothing(spark, tmp_path):
    small = {"subjects": tables(spark, 4)["subjects"]}
    both = {f"{tmp_path}/public": (small, MANIFEST), f"{tmp_path}/private": (small, {"kind": "identities", "id": "x"})}
    for at in range(4):  # two manifests, two moves
        with pytest.raises(OSError, match="planted"):
            store.publish(spark, both, files=Failing(spark, at))
        assert os.listdir(tmp_path) == []
    broken = {"subjects": small["subjects"].withColumn("bad", F.raise_error(F.lit("broken")))}
    with pytest.raises(Exception, match="broken"):
        store.publish(spark, both | {f"{tmp_path}/private": (broken, {})})
    assert os.listdir(tmp_path) == []
    store.publish(spark, both)
    assert sorted(os.listdir(tmp_path)) == ["private", "public"]
    with pytest.raises(FileExistsError):
        store.publish(spark, both)


def test_private_media_paths(spark, tmp_path):
    def mapping(rows, name, **manifest):
        df = spark.createDataFrame(rows, "subject_id string, media_id string, source_path string")
        who = spark.createDataFrame([("a", "raw a")], "subject_id string, raw_id string")
        store.publish(spark, {f"{tmp_path}/{name}": ({"media_paths": df, "identities": who}, {"kind": "identities", "id": "d"} | manifest)})
        return store.Dataset(spark, f"{tmp_path}/{name}")

    good = mapping([("a", "m1", "g/u/./x.jpg"), ("a", "m2", "g/u/../v/y.jpg")], "good")
    assert {r["media_id"] for r in store.media_paths(good, "/raw", "d", ["a"]).collect()} == {"m1", "m2"}
    for k, path in enumerate(["../x.jpg", "/etc/x.jpg", "g/../../x.jpg", "C:\\x.jpg", None]):
        with pytest.raises(Exception, match="leaves the root"):
            store.media_paths(mapping([("a", "m1", path)], f"bad{k}"), "/raw", "d", ["a"]).collect()
    with pytest.raises(Exception, match="named twice"):
        store.media_paths(mapping([("a", "m1", "x"), ("a", "m1", "y")], "twice"), "/raw", "d", ["a"]).collect()
    with pytest.raises(ValueError, match="isn't of this dataset"):
        store.media_paths(good, "/raw", "other", ["a"])
    with pytest.raises(KeyError, match="no subject"):
        store.media_paths(good, "/raw", "d", ["b"])


SETTINGS = build.BuildSettings(maximum_posts=4, condition="removed", keywords=("secret",), maximum_images=2, maximum_live_photos=1, token_limit=10, parts=3)
HOW = {"dimension": 8, "metadata_dimension": 2}


def made(spark, prepared, path, settings=SETTINGS, **more):
    return build.build_features(spark, prepared, stub_encoder(8), {"name": "stub"}, path, settings, **HOW, **more)


def test_a_killed_build_goes_on_and_equals_one_run(spark, tmp_path, prepared):
    want = made(spark, prepared, f"{tmp_path}/whole")
    assert want["subjects"] == 29 and want["posts"] > 0 and want["subjects_without_posts"] > 0
    calls = []

    def slow():
        calls.append(1)
        return stub_encoder(8)()

    for at in range(1, 5):  # identity, then the sums of each part; fails one step later each time
        with pytest.raises(OSError, match="planted"):
            made(spark, prepared, f"{tmp_path}/stopped", files=Failing(spark, 1 if at > 1 else at))
        assert not os.path.exists(f"{tmp_path}/stopped/manifest.json")
    assert made(spark, prepared, f"{tmp_path}/stopped") == want
    rows = lambda p: sorted(map(str, store.FeatureSet(spark, p).table("features").collect()))
    assert rows(f"{tmp_path}/stopped") == rows(f"{tmp_path}/whole") and not os.path.exists(f"{tmp_path}/stopped.building")
    assert made(spark, prepared, f"{tmp_path}/whole") == want  # found as it is
    with pytest.raises(ValueError, match="not 'features-"):
        made(spark, prepared, f"{tmp_path}/whole", build.BuildSettings(parts=3))


def test_counts_of_a_build(spark, tmp_path, prepared):
    got = made(spark, prepared, f"{tmp_path}/set2")
    rows, removed, window_removed = [], 0, 0
    kept = {r["subject_id"] for r in prepared.subjects().collect()}
    posts = [r for r in prepared.table("posts").collect() if r["subject_id"] in kept]
    for s in kept:
        own = sorted((p for p in posts if p["subject_id"] == s), key=lambda p: p["published_at"])
        hit = lambda p: "secret" in (p["cleaned_text"] or "").lower()
        removed += sum(map(hit, own))
        window_removed += sum(map(hit, own[-4:]))
        rows += [(p, min(2 * int(p["post_id"][1:]), 3), max(2 * int(p["post_id"][1:]) - 3, 0)) for p in own[-4:] if not hit(p)]
    total = lambda f: sum(f(*r) for r in rows)
    want = {
        "posts": len(rows), "keyword_posts_removed_from_history": removed, "keyword_posts_removed_from_window": window_removed, "subjects_without_posts": len(kept - {r[0]["subject_id"] for r in rows}),
        "posts_with_text": total(lambda p, i, v: bool((p["cleaned_text"] or "").strip())), "available_images": total(lambda p, i, v: i), "selected_images": total(lambda p, i, v: min(i, 2)),
        "available_live_photos": total(lambda p, i, v: v), "dropped_live_photos_by_cap": total(lambda p, i, v: max(v - 1, 0)), "posts_truncated_by_image_cap": total(lambda p, i, v: i > 2),
        "selected_visual_frames": total(lambda p, i, v: min(i, 2) + 8 * min(v, 1)), "tokens_before_truncation": total(lambda p, i, v: len(p["cleaned_text"] or "")), "empty_content_token_posts": total(lambda p, i, v: not p["cleaned_text"]),
    }
    assert {k: got[k] for k in want} == want


def test_feature_sets_are_checked(spark, tmp_path, prepared):
    made(spark, prepared, f"{tmp_path}/f")
    good = store.FeatureSet(spark, f"{tmp_path}/f")
    assert good.problems().collect() == [] and {r["subject_id"] for r in good.load(["s09", "s10"]).collect()} == {"s09", "s10"}
    with pytest.raises(KeyError, match="s07"):
        good.load(["s07"])  # not eligible
    df, who = good.table("features"), good.table("subjects")
    first = df.where("subject_id = 's09'").limit(1)
    faults = {
        "representations": first.withColumn("post_id", F.lit("new")).withColumn("representation", F.lit("odd")), "width": first.withColumn("post_id", F.lit("new")).withColumn("embedding", F.array(F.lit(1.0))),
        "metadata width": first.withColumn("post_id", F.lit("new")).withColumn("metadata", F.array(F.lit(1.0))), "repeated post": first, "not finite": first.withColumn("post_id", F.lit("new")).withColumn("metadata", F.array(F.lit(1.0), F.lit(float("nan")))),
        "too many posts": first.withColumn("post_id", F.explode(F.array(*(F.lit(f"n{k}") for k in range(5))))), "unknown subject": first.withColumn("subject_id", F.lit("ghost")),
    }
    for k, (rule, more) in enumerate(faults.items()):
        manifest = {n: good.manifest[n] for n in ("kind", "id", "encoder", "shape")}
        store.publish(spark, {f"{tmp_path}/bad{k}": ({"features": df.unionByName(more), "subjects": who}, manifest)})
        bad = store.FeatureSet(spark, f"{tmp_path}/bad{k}")
        assert {r["rule"] for r in bad.problems().collect()} == {rule}
        if rule != "unknown subject":
            with pytest.raises(ValueError, match=rule):
                bad.load(["s09"])
    for n, (change, match) in enumerate((({"encoder": {"model_path": "/home/x"}}, "path of another machine"), ({"complete": False}, "complete"))):
        store.publish(spark, {f"{tmp_path}/odd{n}": ({"features": df, "subjects": who}, manifest | change)})
        with pytest.raises(ValueError, match=match):
            store.FeatureSet(spark, f"{tmp_path}/odd{n}")
    store.publish(spark, {f"{tmp_path}/empty": ({"features": df.limit(0), "subjects": who.limit(0)}, manifest)})
    with pytest.raises(ValueError, match="no subjects"):
        store.FeatureSet(spark, f"{tmp_path}/empty")


def test_removed_condition_takes_vectors_over(spark, tmp_path, prepared):
    whole = build.BuildSettings(maximum_posts=4, parts=2)
    made(spark, prepared, f"{tmp_path}/original", whole)
    counts = made(spark, prepared, f"{tmp_path}/removed", SETTINGS, stored=store.FeatureSet(spark, f"{tmp_path}/original"))
    assert counts["posts"] == store.FeatureSet(spark, f"{tmp_path}/removed").table("features").count()
    with pytest.raises(Exception, match="lacks a post"):
        made(spark, prepared, f"{tmp_path}/again", whole, stored=store.FeatureSet(spark, f"{tmp_path}/removed"))


def test_scores_from_stored_models_equal_those_of_the_fit(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(s, f, f"u{i}", int(i % 3 == 0), f"f{k}", float(draw.normal() + (i % 3 == 0))) for s in (1, 2) for f in (0, 1) for i in range(12) for k in range(3)]
    df = spark.createDataFrame(rows, "split_seed int, outer_fold int, subject_id string, label int, feature string, value double")
    scaler = mod.standardizer(df, ["split_seed", "outer_fold"])
    fitted = mod.fit_linear(mod.standardize(df, scaler, ["split_seed", "outer_fold"]), "svm")
    build.save_models(spark, f"{tmp_path}/m", {"scaler": scaler, "coefficients": fitted}, {"c": 1.0})
    kept = build.load_models(spark, f"{tmp_path}/m", {"c": 1.0})
    who = df.select("split_seed", "outer_fold", "subject_id").distinct()
    score = lambda sc, co: {tuple(r)[:3]: r["score"] for r in mod.linear_score(mod.standardize(df, sc, ["split_seed", "outer_fold"]), who, co).collect()}
    assert score(kept["scaler"], kept["coefficients"]) == pytest.approx(score(scaler, fitted), abs=1e-12)
    with pytest.raises(ValueError, match="models-"):
        build.load_models(spark, f"{tmp_path}/m", {"c": 2.0})
    with pytest.raises(ValueError, match="has no outer_fold"):
        build.save_models(spark, f"{tmp_path}/n", {"x": df.drop("outer_fold")}, {})
