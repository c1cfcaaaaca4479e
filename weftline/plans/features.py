"""Per-post features: sampled media, presence of modalities, embeddings made once or taken over, and their checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.operators.neural import embed
from weftline.operators.pooling import finite
from weftline.operators.windowing import evenly_sampled

MODALITIES = ("has_text", "has_image", "has_live_photo")


def media_selection(media: DataFrame, limits: dict[str, int]) -> DataFrame:
    """At most limits[kind] media of each post and kind, evenly spread in the order of ordinal and id."""
    out = None
    for kind, k in limits.items():
        part = Window.partitionBy("subject_id", "post_id")
        own = media.where((F.col("kind") == kind) & F.col("post_id").isNotNull())
        rows = own.withColumn("pos", F.row_number().over(part.orderBy("ordinal", "media_id")) - 1).withColumn("n", F.count("*").over(part))
        some = evenly_sampled(rows, k).drop("pos", "n")
        out = some if out is None else out.unionByName(some)
    return out


def media_by_post(selected: DataFrame, paths: DataFrame) -> DataFrame:
    """(subject_id, post_id, kind, paths in order); a medium without a path is an error."""
    both = selected.join(paths.select("media_id", "path"), "media_id", "left")
    path = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.raise_error(F.lit("a selected medium has no path")))
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "media_id", path.alias("path"))))
    return both.groupBy("subject_id", "post_id", "kind").agg(F.transform(rows, lambda r: r["path"]).alias("paths"))


def post_inputs(posts: DataFrame, selected: DataFrame) -> DataFrame:
    """Posts with their presence flags: text that isn't blank, an image, a live photo."""
    has = selected.groupBy("subject_id", "post_id").agg(F.max(F.col("kind") == "image").alias("has_image"), F.max(F.col("kind") == "live_photo").alias("has_live_photo"))
    no = F.lit(False)
    out = posts.withColumn("has_text", F.coalesce(strip(F.col("cleaned_text")) != "", no)).join(has, ["subject_id", "post_id"], "left")
    return out.withColumn("has_image", F.coalesce("has_image", no)).withColumn("has_live_photo", F.coalesce("has_live_photo", no))


def build(inputs: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Posts with an embedding of their text, equal texts encoded once."""
    return embed(inputs, "cleaned_text", encoder)


def reuse(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Embeddings of posts taken over from a stored set that must have all of them."""
    both = inputs.join(stored.select("subject_id", "post_id", F.col("embedding").alias("__e")), ["subject_id", "post_id"], "left")
    found = F.when(F.col("__e").isNotNull(), F.col("__e")).otherwise(F.raise_error(F.lit("the stored set lacks a post")))
    return both.withColumn("embedding", found).drop("__e")


def remaining(subjects: DataFrame, done: DataFrame) -> DataFrame:
    """Subjects that a build that goes on still has to do."""
    return subjects.join(done.select("subject_id").distinct(), "subject_id", "left_anti")


def counters(inputs: DataFrame, media: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of totals: posts by presence, media there were, were selected and were dropped."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    posts = inputs.agg(F.count("*").alias("posts"), *(n(m).alias(f"posts_{m}") for m in MODALITIES))
    own = media.join(inputs.select("subject_id", "post_id"), ["subject_id", "post_id"], "left_semi").agg(F.count("*").alias("available_media"))
    some = selected.join(inputs.select("subject_id", "post_id"), ["subject_id", "post_id"], "left_semi").agg(F.count("*").alias("selected_media"))
    return posts.join(own).join(some).withColumn("dropped_media", F.col("available_media") - F.col("selected_media"))  # three single rows


def text_audit(window: DataFrame, condition: DataFrame, hits: DataFrame) -> DataFrame:
    """Per subject: posts selected and left by the condition, characters of the joined text, whether it is empty, keyword matches.

    `hits` has `matches` per post of the window.
    """
    source = window.groupBy("subject_id").agg(F.count("*").alias("source_posts"))
    left = condition.groupBy("subject_id").agg(F.count("*").alias("condition_posts"), (F.sum(F.length("cleaned_text")) + F.count("*") - 1).alias("characters"))
    found = hits.groupBy("subject_id").agg(F.sum((F.col("matches") > 0).cast("long")).alias("matched_posts"), F.sum("matches").alias("matches"))
    out = source.join(left, "subject_id", "left").join(found, "subject_id", "left").na.fill(0)
    return out.withColumn("empty_text", F.col("characters") == 0)


def problems(features: DataFrame, dims: int, maximum_posts: int) -> DataFrame:
    """(subject_id, problem): vectors of another width or not finite, repeated posts, too many posts; no rows if all is well."""
    wrong = features.where(F.col("embedding").isNull() | (F.size("embedding") != dims)).select("subject_id", F.lit("width").alias("problem"))
    odd = features.where(~F.coalesce(finite(F.col("embedding")), F.lit(True))).select("subject_id", F.lit("not finite").alias("problem"))
    per = features.groupBy("subject_id", "representation").agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("d"))
    twice = per.where("n != d").select("subject_id", F.lit("repeated post").alias("problem"))
    many = per.where(F.col("n") > maximum_posts).select("subject_id", F.lit("too many posts").alias("problem"))
    return wrong.unionByName(odd).unionByName(twice).unionByName(many).distinct()
