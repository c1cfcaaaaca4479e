"""Commands on a study: `python -m weftline.cli <command> --study study.json ...`

audit, prepare, make-splits; build-features; evaluate (a linear experiment on text, stored vectors or metadata);
train-full (the attention model on stored vectors); fuse, report and compare on stored predictions.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.identity import key_id
from weftline.operators import audits, hierarchical, stats, training
from weftline.plans import build, config, evaluate, ingest, store
from weftline.plans.catalog import content_fingerprint, identity, parse_seeds
from weftline.session import session
from weftline.sources import raw

COMMANDS = ("audit", "prepare", "make-splits", "build-features", "evaluate", "train-full", "fuse", "report", "compare")


def raw_tables(spark: SparkSession, study: config.Study, image_dirs: list[str], live_dir: str) -> ingest.RawTables:
    users, posts, files = [], [], []
    for g in study.groups:
        users.append(raw.read_users(spark, study.raw_root, g.directory))
        posts.append(raw.read_posts(spark, study.raw_root, g.directory))
        files.append(raw.read_files(spark, study.raw_root, g.directory))
    both = lambda x: x[0].unionByName(x[1])
    return ingest.RawTables(both(users), both(posts), both(files), raw.read_media(both(files), image_dirs, live_dir))


def _emit(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))


def _prepare(spark: SparkSession, study: config.Study, tables: ingest.RawTables, key: bytes) -> DataFrame:
    """Publishes the public tables and the private mapping together; gives the counters."""
    made = ingest.prepare(tables, key, study.labels, study.keywords)
    whole = {"study": vars(study) | {"groups": [vars(g) for g in study.groups]}, "files": content_fingerprint(spark, study.raw_root), "key": key_id(key)}
    name = identity("prepared", **whole)
    public = {"subjects": made.subjects, "posts": made.posts, "media": made.media}
    paths = made.identities.select("subject_id", F.explode("media").alias("m")).select("subject_id", "m.media_id", F.col("m.source_relative_path").alias("source_path"))
    private = {"identities": made.identities.drop("media"), "media_paths": paths}
    store.publish(spark, {study.prepared_root: (public, {"kind": "prepared", "id": name, "maximum_posts": study.maximum_posts}), study.private_root: (private, {"kind": "identities", "id": name})})
    return made.counters


def _named(path: str):
    """What `module:name` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _linear(spark: SparkSession, study: config.Study, a: argparse.Namespace, prepared: store.Prepared, splits: DataFrame) -> DataFrame:
    experiment = config.load(config.LinearExperiment, a.experiment)
    if a.inputs == "text":
        return evaluate.text_experiment(prepared.posts(), splits, experiment, study.keywords, study.maximum_posts, a.name)
    if a.inputs == "metadata":
        return evaluate.metadata_experiment(prepared.posts(maximum_posts=study.maximum_posts), splits, experiment, a.name)
    features = store.FeatureSet(spark, a.features).table("features").withColumn("published_at", F.col("pos"))
    return evaluate.sequence_experiment(features, splits, experiment, a.name)


def _full(spark: SparkSession, a: argparse.Namespace, splits: DataFrame) -> DataFrame:
    """Trains, stores and applies the attention model; the stored tables are what is applied."""
    features = store.FeatureSet(spark, a.features)
    settings = config.load(hierarchical.HierarchicalSettings, a.experiment)
    how = config.load(training.TrainingSettings, a.training)
    subjects = splits.select("subject_id").distinct()
    limit = features.shape.maximum_posts
    seqs = training.sequences(features.table("features"), subjects, ["embedding"], limit, metadata="metadata" if settings.metadata_dimension else None)
    models, history = training.fit(seqs, splits, settings, how, limit)
    whole = {"features": features.manifest["id"], "model": vars(settings), "training": vars(how)}
    build.save_models(spark, a.out, {"parameters": models, "history": history}, whole)
    scored = training.score(seqs, splits, build.load_models(spark, a.out, whole)["parameters"], settings, limit)
    return scored.withColumn("experiment", F.lit(a.name)).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--study", required=True)
    parser.add_argument("--experiment", help="settings of a linear experiment, of the attention model, or of a build")
    parser.add_argument("--training", help="settings of the training, for train-full")
    parser.add_argument("--inputs", choices=["text", "metadata", "features"], default="text", help="what evaluate reads")
    parser.add_argument("--features", help="a feature set")
    parser.add_argument("--stored", help="a feature set to take embeddings from, for build-features")
    parser.add_argument("--encoder", help="module:factory, for build-features")
    parser.add_argument("--dimension", type=int, help="of the encoder's vectors")
    parser.add_argument("--out", help="where build-features or train-full puts its set")
    parser.add_argument("--name", default="text", help="of the experiment; of the reference in a report")
    parser.add_argument("--with", dest="other", help="another experiment, to fuse or compare with")
    parser.add_argument("--weight", type=float, default=0.5, help="of the other experiment in a fusion")
    parser.add_argument("--seeds", default="58-65")
    parser.add_argument("--image-dirs", default="img/原始图片,img/original")
    parser.add_argument("--live-dir", default="live_photo")
    parser.add_argument("--key-variable", default="WEFTLINE_KEY", help="environment variable that holds the pseudonym key")
    a = parser.parse_args(argv)
    study = config.load(config.Study, a.study)
    spark = session("weftline")
    root = study.prepared_root
    if a.command in ("audit", "prepare"):
        tables = raw_tables(spark, study, a.image_dirs.split(","), a.live_dir)
        _emit(ingest.audit(tables) if a.command == "audit" else _prepare(spark, study, tables, os.environ[a.key_variable].encode()))
        return 0
    prepared = store.Prepared(spark, root)
    splits_at, kept_at = f"{root}.splits", lambda name: f"{root}.predictions/experiment={name}"
    if a.command == "make-splits":
        splits = evaluate.make_splits(prepared.subjects(), parse_seeds(a.seeds), study.folds, study.validation_fraction, study.minimum_posts)
        raw.write_table(splits, splits_at, overwrite=True)
        _emit(evaluate.cohort_summary(prepared.subjects(), study.minimum_posts))
        return 0
    if a.command == "build-features":
        settings = config.load(build.BuildSettings, a.experiment)
        stored = store.FeatureSet(spark, a.stored) if a.stored else None
        counts = build.build_features(spark, prepared, _named(a.encoder), {"name": a.encoder}, a.out, settings, dimension=a.dimension, metadata_dimension=5, stored=stored)
        print(json.dumps(counts, sort_keys=True))
        return 0
    if a.command in ("evaluate", "train-full"):
        splits = spark.read.parquet(splits_at)
        predictions = _linear(spark, study, a, prepared, splits) if a.command == "evaluate" else _full(spark, a, splits)
        raw.write_table(predictions.drop("experiment"), kept_at(a.name), overwrite=True)
        _emit(stats.repeated_summary(spark.read.parquet(kept_at(a.name)).withColumn("experiment", F.lit(a.name))))
        return 0
    kept = lambda name: spark.read.parquet(kept_at(name)).withColumn("experiment", F.lit(name))
    if a.command == "fuse":
        fused = stats.fuse(*(kept(n).where("role = 'test'") for n in (a.name, a.other)), a.weight).withColumn("experiment", F.lit("")).withColumn("role", F.lit("test"))
        raw.write_table(fused.drop("experiment"), kept_at(f"{a.name}+{a.other}"), overwrite=True)
        _emit(stats.repeated_summary(kept(f"{a.name}+{a.other}")))
    elif a.command == "report":
        everything = spark.read.option("basePath", f"{root}.predictions").parquet(f"{root}.predictions")
        print(evaluate.markdown(*evaluate.ablation_report(everything, a.name)))
    else:
        _emit(audits.differences(kept(a.name), kept(a.other), ["split_seed", "outer_fold", "subject_id", "role"], ["label", "decision_value", "score"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
