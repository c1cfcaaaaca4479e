"""Settings, stored runs, features, repeated evaluations and the stream."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.neural import stub_encoder
from weftline.operators import audits
from weftline.plans import catalog, config, evaluate, features
from weftline.streaming import ingest as stream

STUDY = {
    "raw_root": "/a/raw", "prepared_root": "/a/prepared", "private_root": "/a/private", "keywords": ["x", "x", "y"],
    "groups": [{"directory": "c", "label_name": "control", "label_id": 0}, {"directory": "p", "label_name": "positive", "label_id": 1}],
}


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("HERE", "/b")
    (tmp_path / "s.json").write_text(json.dumps(STUDY | {"raw_root": "${HERE}/raw"}))
    s = config.load(config.Study, str(tmp_path / "s.json"))
    assert s.raw_root == "/b/raw" and s.keywords == ("x", "y") and s.labels == {"c": ("control", 0), "p": ("positive", 1)}
    for bad in ({"extra": 1}, {"folds": 1}, {"private_root": "/a/prepared/in"}, {"groups": STUDY["groups"][:1]}, {"validation_fraction": 1.0}):
        with pytest.raises(ValueError):
            catalog.strict(config.Study, STUDY | bad)
    with pytest.raises(ValueError):
        catalog.expand_environment({"a": ["${NOT_SET_ANYWHERE}"]})
    for bad in ({"solver": "tree"}, {"seeds": [1]}, {"condition": "none"}, {"pooling": "max"}):
        with pytest.raises(ValueError):
            catalog.strict(config.LinearExperiment, bad)
    with pytest.raises(ValueError):
        config.Benchmark(seeds=(1, 2))
    assert catalog.parse_seeds("42,58-61") == [42, 58, 59, 60, 61]
    for bad in ("", "a", "3-1", "1,1"):
        with pytest.raises(ValueError):
            catalog.parse_seeds(bad)


def test_stored_runs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    m = catalog.run_manifest(spark, "features", {"dims": 8}, {"dataset": "d"})
    assert m["run_id"] != catalog.run_manifest(spark, "features", {"dims": 9}, {"dataset": "d"})["run_id"]
    for _ in range(2):
        assert catalog.stored(spark, str(tmp_path), m, build).count() == 3
    assert len(calls) == 1
    with pytest.raises(ValueError, match="another manifest"):
        catalog.stored(spark, str(tmp_path), m | {"inputs": {}}, build)
    (tmp_path / m["run_id"] / "data/_SUCCESS").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        catalog.stored(spark, str(tmp_path), m, build)


def test_content_fingerprint(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d / "sub").mkdir(parents=True)
        (tmp_path / d / "sub/x").write_text("1")
        (tmp_path / d / "y").write_text("2")
    first = catalog.content_fingerprint(spark, str(tmp_path / "a"))
    assert first == catalog.content_fingerprint(spark, str(tmp_path / "b"))
    (tmp_path / "b/y").write_text("3")
    assert first != catalog.content_fingerprint(spark, str(tmp_path / "b"))


def test_features(spark):
    posts = spark.createDataFrame([("s", "p1", "hello"), ("s", "p2", " "), ("s", "p3", ""), ("t", "p4", None)], "subject_id string, post_id string, cleaned_text string")
    media = spark.createDataFrame([("s", f"m{i}", "p1", "image", i) for i in range(7)] + [("s", "v", "p2", "live_photo", 1), ("s", "u", None, "image", 1)], "subject_id string, media_id string, post_id string, kind string, ordinal int")
    some = features.media_selection(media, {"image": 3, "live_photo": 1})
    assert sorted(r.media_id for r in some.collect()) == ["m0", "m3", "m6", "v"]
    inputs = features.post_inputs(posts, some)
    assert {r.post_id: (r.has_text, r.has_image, r.has_live_photo) for r in inputs.collect()} == {"p1": (True, True, False), "p2": (False, False, True), "p3": (False, False, False), "p4": (False, False, False)}
    c = features.counters(inputs, media, some).first()
    assert (c.posts, c.posts_has_text, c.available_media, c.selected_media, c.dropped_media) == (4, 1, 8, 4, 4)
    paths = media.select("media_id", F.concat(F.lit("/"), "media_id").alias("path"))
    assert {r.post_id: r.paths for r in features.media_by_post(some, paths).collect()} == {"p1": ["/m0", "/m3", "/m6"], "p2": ["/v"]}
    with pytest.raises(Exception, match="no path"):
        features.media_by_post(some, paths.where("media_id != 'm3'")).collect()
    made = features.build(inputs, stub_encoder(8))
    assert made.count() == 4 and made.where("post_id = 'p1'").first().embedding[0] == 5
    assert features.reuse(inputs.where("subject_id = 's'"), made).count() == 3
    with pytest.raises(Exception, match="lacks a post"):
        features.reuse(inputs, made.where("subject_id = 's'")).collect()
    bad = made.withColumn("representation", F.lit("final"))
    assert features.problems(bad, 8, 3).count() == 0
    assert {(r.subject_id, r.problem) for r in features.problems(bad.unionByName(bad.where("post_id = 'p4'")), 8, 2).collect()} == {("t", "repeated post"), ("s", "too many posts")}
    assert [r.subject_id for r in features.remaining(posts.select("subject_id").distinct(), made.where("subject_id = 's'")).collect()] == ["t"]


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(6)
    rows = []
    for s in range(30):
        for k in range(rng.randint(21, 26)):
            word = "阳性特征" if s % 2 and k % 3 else "阴性特征"
            at = dt.datetime(2026, 1, 1) + dt.timedelta(hours=k)
            rows.append((f"s{s}", f"p{s}-{k}", at, word + rng.choice("甲乙丙丁") + ("OCD" if k == 20 else ""), [float(s % 2) + rng.random(), 0.0, rng.random(), 0.5, 0.1], [float(s % 2) * (-1) ** (k > 10), rng.random(), 1.0]))
    posts = spark.createDataFrame(rows, "subject_id string, post_id string, published_at timestamp_ntz, cleaned_text string, metadata_vector array<double>, embedding array<double>").cache()
    subjects = posts.groupBy("subject_id").agg(F.count("*").alias("post_count")).select("subject_id", (F.substring("subject_id", 2, 9).cast("int") % 2).alias("label_id"), "post_count", F.least("post_count", F.lit(24)).alias("split_post_count"))
    return posts, subjects.cache()


def test_repeated_evaluation(spark, cohort, tmp_path):
    posts, subjects = cohort
    seeds = (58, 59)
    kept = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]  # noqa: E731  as the commands do
    splits = kept(evaluate.make_splits(subjects, seeds, 3, 0.2, 21), "splits")
    assert sum(r.included for r in evaluate.cohort_summary(subjects, 22).collect()) == subjects.where("post_count >= 22").count()
    text = evaluate.text_experiment(posts, splits, config.LinearExperiment(seeds=seeds), ["OCD"], 24)
    sequence = evaluate.sequence_experiment(posts, splits, config.LinearExperiment(seeds=seeds, pooling="temporal_pyramid", dims=2))
    meta = evaluate.metadata_experiment(posts, splits, config.LinearExperiment(solver="logistic", seeds=seeds))
    every = kept(text, "text").unionByName(kept(sequence, "sequence")).unionByName(kept(meta, "meta"))
    assert every.where("role = 'test'").count() == 3 * 2 * 30
    table, pairs = evaluate.ablation_report(every, "text")
    means = {r.experiment: r for r in table.collect()}
    assert means["text"].f1 > 0.9 and means["sequence"].roc_auc > 0.9 and means["metadata"].accuracy > 0.8
    assert pairs.count() == 10
    report = evaluate.markdown(table, pairs)
    assert report.count("\n| ") == 3 + 10 + 4 and "| text |" in report


def test_benchmark_checks_alignment(spark, cohort, tmp_path):
    _, subjects = cohort
    rule = config.Benchmark(reference="a")
    evaluate.make_splits(subjects, rule.seeds, rule.folds, 0.2).write.parquet(str(tmp_path / "splits"))
    splits = spark.read.parquet(str(tmp_path / "splits"))
    rows = splits.withColumn("experiment", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("label", F.col("label_id"))
    noise = (F.abs(F.xxhash64("subject_id", "split_seed", "experiment")) % 100) / 100.0
    rows.withColumn("score", 0.4 * F.col("label") + 0.6 * noise).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    table, pairs = evaluate.benchmark(rows, splits, rule)
    assert table.count() == 2 and {r.n for r in pairs.collect()} == {8}
    with pytest.raises(ValueError, match="aren't the split's"):
        evaluate.benchmark(rows.withColumn("outer_fold", (F.col("outer_fold") + 1) % 5), splits, rule)


def test_benchmark_audit_finds_planted_faults_and_nothing_else(spark, cohort, tmp_path):
    _, subjects = cohort
    rule = config.Benchmark(reference="a")
    kept = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    splits = kept(evaluate.make_splits(subjects, rule.seeds, rule.folds, 0.2, 21), "splits")
    noise = (F.abs(F.xxhash64("subject_id", "split_seed", "experiment")) % 100) / 100.0
    rows = splits.withColumn("experiment", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("label", F.col("label_id")).withColumn("threshold", F.lit(0.5)).withColumn("score", 0.4 * F.col("label") + 0.6 * noise)
    rows = kept(rows.withColumn("prediction", (F.col("score") >= 0.5).cast("int")), "rows")
    table, pairs = (kept(df, f"t{k}") for k, df in enumerate(evaluate.ablation_report(rows, "a")))
    look = lambda a, r, t, p: {(x.part, x.problem): x.cases for x in evaluate.audit_benchmark(subjects, a, r, (t, p), rule, fraction=0.2).collect()}
    assert look(splits, rows, table, pairs) == {}
    one = (F.col("split_seed") == 58) & (F.col("subject_id") == "s3")
    moved = splits.withColumn("role", F.when(one & (F.col("role") == "test"), "train").otherwise(F.col("role")))
    assert look(moved, rows, table, pairs) == {("splits", "other values"): 1}
    turned = rows.withColumn("prediction", F.when(one & (F.col("role") == "train"), 1 - F.col("prediction")).otherwise(F.col("prediction")))
    assert set(look(splits, turned, table, pairs)) == {("predictions", "not the score's")}
    assert look(splits, rows, table.withColumn("f1", F.col("f1") + 0.01), pairs) == {("means", "other f1"): 1}
    worse = pairs.withColumn("p_value", F.col("p_value") / 2) if "p_value" in pairs.columns else pairs.withColumn(pairs.columns[-1], F.lit(-1.0))
    assert {k[0] for k in look(splits, rows, table, worse)} == {"comparisons"}


def test_three_sides_are_aligned_in_one_shuffle(spark):
    base = spark.range(20).select("id", (F.col("id") % 2).alias("v"))
    sides = {"a": base, "b": base.where("id != 3"), "c": base.withColumn("v", F.when(F.col("id") == 4, 9).otherwise(F.col("v"))).unionByName(base.where("id = 5"))}
    found = audits.misaligned_sides(sides, ["id"], ["v"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == {(3, "b", "missing"), (4, "c", "other values"), (5, "c", "repeated")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"p{i % 6}", "text OCD" if i % 2 else "分享图片", "", "2026-01-02 03:04", str(i), "", "x", dt.datetime(2026, 1, 2, 3 + i // 5)) for i in range(10)]
    schema = "subject_id string, post_id string, text string, location string, date string, likes string, comments string, reposts string, arrived timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    batch = stream.typed(spark.read.parquet(str(tmp_path / "in")), ["ocd"])
    query = stream.append_to(stream.typed(source, ["ocd"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0 and batch.count() == 10
    typed = source.withColumn("contains_study_keyword", F.lit(True))
    q = stream.deduplicated(typed.select("subject_id", "post_id", "arrived"), "arrived").writeStream.format("memory").queryName("unique_posts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("unique_posts").count() == 6
    q = stream.hourly_counts(typed, "arrived").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.posts for r in spark.table("hours").collect()) == [5, 5]
