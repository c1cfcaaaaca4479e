"""Registered queries of published datasets: everything they read has been written and opened again through the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.neural import stub_encoder
from weftline.plans import build, store
from weftline.plans.queries import query, table

KEYWORDS = ("the and", "worthless")
WINDOW = 4
_MEDIA = "subject_id string, media_id string, post_id string, kind string, ordinal int"
_HIT = "coalesce(regexp_matches(text, '(?i)the and|worthless'), false)"
_POSTS = f"p AS (SELECT CAST(conv_id AS VARCHAR) AS subject_id, printf('%08d-%s', turn, coalesce(role, '')) AS post_id, text, {_HIT} AS hit, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(role, '') DESC, coalesce(text, '') DESC) AS rn FROM conversations)"


def _prepared(spark: SparkSession, sf_dir: str) -> store.Prepared:
    """Conversations as a prepared dataset: a conversation is a subject, a turn a post, and there are no media."""
    rows = table(spark, sf_dir, "conversations")
    post_id = F.format_string("%08d-%s", F.col("turn").cast("long"), F.coalesce("role", F.lit("")))
    posts = rows.select(F.col("conv_id").cast("string").alias("subject_id"), post_id.alias("post_id"), F.timestamp_seconds(F.col("turn").cast("long")).cast("timestamp_ntz").alias("published_at"), F.col("text").alias("cleaned_text"), F.array(F.col("turn").cast("double")).alias("metadata_vector"))
    subjects = posts.groupBy("subject_id").agg(F.count("*").alias("post_count")).select("subject_id", F.pmod(F.crc32(F.col("subject_id").cast("binary")), F.lit(2)).cast("int").alias("label_id"), F.lit(True).alias("eligible"), "post_count")
    at = store.shared_folder(spark, "prepared")
    store.publish(spark, {at: ({"subjects": subjects, "posts": posts, "media": spark.createDataFrame([], _MEDIA)}, {"kind": "prepared", "id": "conversations", "maximum_posts": WINDOW})})
    return store.Prepared(spark, at, identity="conversations")


@query(f"WITH {_POSTS} SELECT subject_id, post_id, sha256(coalesce(text, '')) AS digest FROM p WHERE rn <= {WINDOW} AND NOT hit")
def prepared_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns of every conversation without those that name a keyword, from the published dataset."""
    posts = _prepared(spark, sf_dir).posts(maximum_posts=WINDOW, condition="removed", keywords=KEYWORDS)
    return posts.select("subject_id", "post_id", F.sha2(F.coalesce("cleaned_text", F.lit("")), 256).alias("digest"))


_COUNTS = {
    "subjects": "count(DISTINCT subject_id)",
    "posts": f"count(*) FILTER (rn <= {WINDOW} AND NOT hit)",
    "keyword_posts_removed_from_history": "count(*) FILTER (hit)",
    "keyword_posts_removed_from_window": f"count(*) FILTER (rn <= {WINDOW} AND hit)",
    "subjects_without_posts": f"count(DISTINCT subject_id) - count(DISTINCT CASE WHEN rn <= {WINDOW} AND NOT hit THEN subject_id END)",
    "posts_with_text": rf"count(*) FILTER (rn <= {WINDOW} AND NOT hit AND regexp_replace(text, '[\s\p{{Z}}]', '', 'g') <> '')",
    "truncated_posts": f"count(*) FILTER (rn <= {WINDOW} AND NOT hit AND length(coalesce(text, '')) > 80)",
    "empty_content_token_posts": f"count(*) FILTER (rn <= {WINDOW} AND NOT hit AND coalesce(text, '') = '')",
    "tokens_before_truncation": f"coalesce(sum(length(text)) FILTER (rn <= {WINDOW} AND NOT hit), 0)",
}
#: There are no media, so nothing of theirs is counted.
_NONE = ["posts_with_image", "posts_with_live_photo", "selected_visual_frames", *(n.format(k) for k in ("image", "live_photo") for n in ("available_{}s", "selected_{}s", "dropped_{}s_by_cap", "posts_truncated_by_{}_cap"))]


@query(f"WITH {_POSTS} " + " UNION ALL ".join(f"SELECT '{n}' AS counter, CAST({x} AS BIGINT) AS value FROM p" for n, x in _COUNTS.items()) + "".join(f" UNION ALL SELECT '{n}', 0" for n in _NONE))
def feature_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build in three committed pieces; its counts, as observed while the pieces were written and kept in the manifest."""
    settings = build.BuildSettings(maximum_posts=WINDOW, condition="removed", keywords=KEYWORDS, token_limit=80, parts=3)
    at = store.shared_folder(spark, "features")
    build.build_features(spark, _prepared(spark, sf_dir), stub_encoder(8), {"name": "stub"}, at, settings, dimension=8, metadata_dimension=1)
    counts = store.FeatureSet(spark, at).manifest["counts"]
    return spark.createDataFrame(sorted(counts.items()), "counter string, value long")


@query("""
WITH v AS (SELECT CAST(vec_id % 50 AS VARCHAR) AS subject_id, label, count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS wide,
           count(*) FILTER (embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS odd FROM embeddings GROUP BY 1, 2),
s AS (SELECT subject_id, count(*) FILTER (n > 1) AS "repeated post", greatest(count(*) - 9, 0) AS "too many posts", sum(wide) AS width, sum(odd) AS "not finite" FROM v GROUP BY 1)
SELECT subject_id, rule, CAST(cases AS BIGINT) AS cases FROM s UNPIVOT (cases FOR rule IN ("repeated post", "too many posts", width, "not finite")) WHERE cases > 0
""")
def feature_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a published feature set in which a label stands for a post, so posts repeat, and nine posts are allowed."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("subject_id"), F.col("label").cast("string").alias("post_id"), F.lit(0).alias("pos"), F.lit("final").alias("representation"), F.col("embedding").cast("array<double>").alias("embedding"), F.array().cast("array<double>").alias("metadata"))
    at = store.shared_folder(spark, "features")
    manifest = {"kind": "features", "id": "embeddings", "encoder": {"name": "given"}, "shape": {"representations": ["final"], "embedding_dimension": 64, "metadata_dimension": 0, "maximum_posts": 9}}
    store.publish(spark, {at: ({"features": rows, "subjects": rows.select("subject_id").distinct()}, manifest)})
    return store.FeatureSet(spark, at).problems()
