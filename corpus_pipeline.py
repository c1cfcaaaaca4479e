"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.langid import UNDETERMINED, identify_languages, train_languages
from weftline.llm.ngram_join import keep_one_per_class
from weftline.llm.packing import pack
from weftline.llm.quality import score_quality, train_quality
from weftline.llm.scratch import Scratch

#: Documents with a lower quality score are rejected.
MIN_QUALITY = 0.7
#: Documents whose main language has a smaller share are rejected.
MIN_LANGUAGE_SHARE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, out="__score").where(F.col("__score") >= MIN_QUALITY).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify_languages(docs, train_languages(docs), out="__language")
    kept = found.where((F.col("__language.lang") != UNDETERMINED) & (F.col("__language.score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The first two stages are trained models, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of the documents that all stages keep."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
