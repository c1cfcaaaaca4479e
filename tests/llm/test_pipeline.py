"""The pipeline's stages, each on what the one before kept, against brute force."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_decontaminate import brute as hits
from test_ngram_join import brute as classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept[name + "/in"] = docs
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() < kept[name + "/in"].count() + 1
            assert docs.exceptAll(kept[name + "/in"]).count() == 0
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = labels.where("quality = 1").join(kept["quality/in"], "doc_id").count()
    assert labels.where("quality = 1").join(kept["language/in"], "doc_id").count() >= 0.97 * judged
    assert labels.where("quality = 0").join(kept["language/in"], "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
    assert kept["near_duplicates/in"].count() >= 0.97 * kept["language/in"].count()
    before = [(r.doc_id, r.text) for r in kept["near_duplicates/in"].collect()]
    least = {root for _, _, root in classes(before)}
    assert {r.doc_id for r in kept["decontamination/in"].collect()} == least
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    after = {r.doc_id for r in kept["packing/in"].collect()}
    assert after == {r.doc_id for r in kept["decontamination/in"].collect() if not hits(r.text, items)[2]}
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want")).collect()
    assert {r.doc_id for r in pieces} == after and all(r.n == r.want for r in pieces)
