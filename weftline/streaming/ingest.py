"""Posts that keep arriving: the same cleaning and features on a stream, an extension beyond the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.metadata import metadata_vector, parse_count, parse_datetime
from weftline.functions.text import clean_text, mentions


def typed(raw: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Raw text columns (subject_id, post_id, text, location, date, likes, comments, reposts) to prepared posts; batch or stream."""
    rows = raw.select(
        "subject_id", "post_id", parse_datetime(F.col("date")).alias("published_at"), clean_text(F.col("text"), F.col("location")).alias("cleaned_text"),
        *(parse_count(F.col(c)).alias(c) for c in ("likes", "comments", "reposts")),
    )
    vector = metadata_vector(F.col("likes"), F.col("comments"), F.col("reposts"), F.col("published_at"))
    return rows.withColumn("contains_study_keyword", mentions(F.col("cleaned_text"), keywords)).withColumn("metadata_vector", vector)


def deduplicated(posts: DataFrame, arrived: str, delay: str = "1 day") -> DataFrame:
    """First arrivals of each post; state is dropped once the watermark has passed, so it stays bounded."""
    return posts.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["subject_id", "post_id"])


def hourly_counts(posts: DataFrame, arrived: str, delay: str = "1 hour") -> DataFrame:
    """Posts and keyword posts an hour, late ones up to `delay`."""
    hours = posts.withWatermark(arrived, delay).groupBy(F.window(arrived, "1 hour"))
    return hours.agg(F.count("*").alias("posts"), F.sum(F.col("contains_study_keyword").cast("long")).alias("keyword_posts"))


def append_to(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Prepared posts to a Parquet table, each exactly once, all that is there now."""
    return posts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
