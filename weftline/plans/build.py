"""Feature sets built from a prepared dataset, piece by piece, and published with the counts of what went in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.operators.neural import embed
from weftline.operators.windowing import apply_condition, numbered, recent, selection_audit
from weftline.plans import store
from weftline.plans.catalog import identity
from weftline.plans.features import media_selection

Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


@dataclass(frozen=True)
class BuildSettings:
    maximum_posts: int = 64
    condition: str = "original"
    keywords: tuple[str, ...] = ()
    mask: str = "[MASK]"
    maximum_images: int = 4
    maximum_live_photos: int = 1
    frames: int = 8  # of a live photo
    token_limit: int | None = None
    representation: str = "final"
    parts: int = 8


def _posts(prepared: store.Prepared, buckets: list[int], s: BuildSettings) -> DataFrame:
    """Rows of the subjects' windows, and one without a post for a subject of which none is left; sums of a subject stand in its first row."""
    subjects = prepared.table("subjects", buckets=buckets).where("eligible")
    own = prepared.table("posts", buckets=buckets).join(subjects.select("subject_id"), "subject_id", "left_semi")
    window = apply_condition(recent(own, "subject_id", "published_at", "post_id", s.maximum_posts).select(*own.columns), "cleaned_text", s.condition, s.keywords, s.mask)
    window = numbered(window, "subject_id", "published_at", "post_id")
    media = prepared.table("media", buckets=buckets).join(window.select("subject_id", "post_id"), ["subject_id", "post_id"], "left_semi")
    limits = {"image": s.maximum_images, "live_photo": s.maximum_live_photos}
    selected = media_selection(media, limits).select("subject_id", "media_id", F.lit(1).alias("chosen"))
    of_post = media.join(selected, ["subject_id", "media_id"], "left").groupBy("subject_id", "post_id").agg(
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"available_{k}") for k in limits), *(F.sum(((F.col("kind") == k) & F.col("chosen").isNotNull()).cast("long")).alias(f"selected_{k}") for k in limits)
    )
    rows = window.join(of_post, ["subject_id", "post_id"], "left").na.fill(0, [f"{w}_{k}" for w in ("available", "selected") for k in limits])
    audit = selection_audit(own, "subject_id", "published_at", "post_id", "cleaned_text", s.maximum_posts, s.keywords)
    out = subjects.select("subject_id", "label_id").join(audit, "subject_id", "left").join(rows, "subject_id", "left")
    return out.withColumn("first", F.coalesce(F.col("pos") == 0, F.lit(True)))


def measures(s: BuildSettings) -> dict[str, Column]:
    """What a build counts, as sums over its rows."""
    c, on, there = F.col, lambda x: F.coalesce(x.cast("long"), F.lit(0)), F.col("post_id").isNotNull()
    out = {
        "subjects": c("first"),
        "posts": there,
        "keyword_posts_removed_from_history": on(c("first")) * (on(c("history")) - on(c("history_after_removal"))),
        "keyword_posts_removed_from_window": on(c("first")) * on(c("removed_in_window")),
        "subjects_without_posts": ~there,
        "posts_with_text": there & c("has_text"),
        "posts_with_image": there & (c("selected_image") > 0),
        "posts_with_live_photo": there & (c("selected_live_photo") > 0),
        "selected_visual_frames": c("selected_image") + c("selected_live_photo") * s.frames,
        "truncated_posts": there & (c("tokens") > F.lit(s.token_limit)) if s.token_limit else F.lit(0),
        "empty_content_token_posts": there & (c("tokens") == 0),
        "tokens_before_truncation": c("tokens"),
    }
    for kind in ("image", "live_photo"):
        have, took = c(f"available_{kind}"), c(f"selected_{kind}")
        out |= {f"available_{kind}s": have, f"selected_{kind}s": took, f"dropped_{kind}s_by_cap": have - took, f"posts_truncated_by_{kind}_cap": have > took}
    return {n: F.coalesce(x.cast("long"), F.lit(0)) for n, x in out.items()}


def build_features(
    spark: SparkSession, prepared: store.Prepared, encoder: Encoder, encoder_manifest: dict[str, Any], path: str, settings: BuildSettings, *,
    dimension: int, metadata: str = "metadata_vector", metadata_dimension: int = 0, tokens: Callable[[Column], Column] | None = None, stored: store.FeatureSet | None = None, files: store.Files | None = None,
) -> dict[str, int]:
    """Builds the features below `path` and gives their counts; a finished set is left as it is, a stopped build goes on.

    `tokens` counts a text's tokens for the encoder's limit.  With `stored`, embeddings are taken over from that set,
    which must have every post; this is how a removed condition keeps the vectors of the unchanged window.
    """
    files = files or store.Files(spark)
    whole = {"prepared": prepared.manifest.get("id"), "encoder": encoder_manifest, "settings": vars(settings) | {"keywords": list(settings.keywords)}, "dimension": dimension, "metadata": [metadata, metadata_dimension], "stored": stored.manifest.get("id") if stored else None}
    name = identity("features", **whole)
    if files.exists(path):
        return store.FeatureSet(spark, path, identity=name).manifest["counts"]
    work = f"{path.rstrip('/')}.building"

    def make(buckets: list[int]) -> DataFrame:
        rows = _posts(prepared, buckets, settings)
        text = F.coalesce(F.col("cleaned_text"), F.lit(""))
        rows = rows.withColumn("has_text", strip(text) != "").withColumn("tokens", tokens(text) if tokens else F.length(text))
        if stored is None:
            made = embed(rows, "cleaned_text", encoder)
        else:
            kept = stored.table("features").select("subject_id", "post_id", "embedding")
            made = rows.join(kept, ["subject_id", "post_id"], "left").withColumn("embedding", F.when(F.col("post_id").isNull() | F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("the stored set lacks a post"))))
        vector = F.col(metadata) if metadata_dimension else F.array().cast("array<double>")
        return made.withColumn("metadata", vector.cast("array<double>")).withColumn("representation", F.lit(settings.representation))

    counts = store.build_resumably(spark, work, {"id": name}, prepared, make, measures(settings), parts=settings.parts, files=files)
    built = store.pieces(spark, work)
    some = built.where("post_id IS NOT NULL")
    features = some.select("subject_id", "post_id", "pos", "representation", F.col("embedding").cast("array<double>").alias("embedding"), "metadata", "has_text", (F.col("selected_image") > 0).alias("has_image"), (F.col("selected_live_photo") > 0).alias("has_live_photo"))
    who = built.where("first").select("subject_id", "label_id", F.coalesce("history", F.lit(0)).cast("long").alias("available_posts"), F.coalesce("history_after_removal", F.lit(0)).cast("long").alias("posts_after_removal"))
    manifest = {
        "kind": "features", "id": name, "encoder": encoder_manifest, "counts": counts, "identity": whole,
        "shape": {"representations": [settings.representation], "embedding_dimension": dimension, "metadata_dimension": metadata_dimension, "maximum_posts": settings.maximum_posts},
    }
    store.publish(spark, {path: ({"features": features, "subjects": who}, manifest)}, files=files)
    files.delete(work)
    return counts


def save_models(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict[str, Any], keys: Sequence[str] = ("split_seed", "outer_fold")) -> None:
    """Parameter tables of fitted models, such as idf, scaler and coefficients or a network's arrays, each keyed by seed and fold."""
    for name, df in tables.items():
        if lacking := [k for k in keys if k not in df.columns]:
            raise ValueError(f"the table {name} has no {lacking[0]}")
    store.publish(spark, {path: (tables, {"kind": "models", "id": identity("models", settings=settings), "settings": settings, "keys": list(keys)})}, subject="subject_id")


def load_models(spark: SparkSession, path: str, settings: dict[str, Any]) -> dict[str, DataFrame]:
    """The stored tables, if they were fitted under these settings."""
    kept = store.Dataset(spark, path, kind="models", identity=identity("models", settings=settings))
    return {name: kept.table(name) for name in kept.manifest["tables"]}
