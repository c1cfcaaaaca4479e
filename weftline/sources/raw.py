"""Readers and writers of the raw tree, JSON lines and prepared tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.identity import media_name

# Column names of the raw exports.
USER_ID, POST_ID, POST_TEXT, POST_LOCATION = "用户id", "id", "正文", "位置"
POST_DATE, POST_DATE_FALLBACK = "完整日期", "日期"
LIKES, COMMENTS, REPOSTS = "点赞数", "评论数", "转发数"
POST_COLUMNS = (POST_ID, POST_TEXT, POST_LOCATION, POST_DATE, POST_DATE_FALLBACK, LIKES, COMMENTS, REPOSTS)


def read_csv(spark: SparkSession, path: str | Sequence[str], wanted: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, with the file's path and an ordinal that grows with the rows of a file.

    A file isn't split, as quoted fields may hold line feeds, so the ordinals of its rows are in order. Columns of
    `wanted` that the files lack are null.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8", mode="PERMISSIVE", enforceSchema=False)
    named = raw.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in raw.columns), F.col("_metadata.file_path").alias("__path"))
    out = named.withColumn("__ordinal", F.monotonically_increasing_id())
    for c in wanted or ():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names only; no row is parsed."""
    first = spark.read.text(path).limit(1).collect()
    return [c.lstrip("﻿").strip() for c in next(csv.reader([first[0][0].lstrip("﻿")]), [])] if first else []


def read_users(spark: SparkSession, root: str, group: str) -> DataFrame:
    """(group, user_id) for each row of a group's user list."""
    users = read_csv(spark, f"{root}/{group}/users.csv", [USER_ID])
    return users.select(F.lit(group).alias("source_group"), F.trim(F.coalesce(F.col(USER_ID), F.lit(""))).alias("user_id")).where("user_id != ''")


def _under(group: str) -> str:
    return rf"/{group}/([^/]+)/"


def read_posts(spark: SparkSession, root: str, group: str) -> DataFrame:
    """Raw posts of a group's `<user>/<user>.csv` files with group, user_id and ordinal."""
    rows = read_csv(spark, f"{root}/{group}/*/*.csv", POST_COLUMNS)
    user = F.regexp_extract("__path", _under(group), 1)
    file = F.regexp_extract("__path", r"([^/]+)\.csv$", 1)
    return rows.withColumn("source_group", F.lit(group)).withColumn("user_id", user).where(file == F.col("user_id")).select("source_group", "user_id", "__ordinal", *(F.col(c) for c in POST_COLUMNS))


def read_files(spark: SparkSession, root: str, group: str) -> DataFrame:
    """Paths of all files of a group, without reading them: (source_group, user_id, path below the root)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{group}").select("path")
    below = F.concat(F.lit(f"{group}/"), F.regexp_extract("path", rf"/{group}/(.+)$", 1))
    return files.select(F.lit(group).alias("source_group"), F.regexp_extract("path", _under(group), 1).alias("user_id"), below.alias("path")).where("user_id != ''")


def read_media(files: DataFrame, image_dirs: Sequence[str], live_dir: str) -> DataFrame:
    """(source_group, user_id, path, kind, raw_post_id, ordinal) of the files in the media directories."""
    kind = F.lit(None).cast("string")
    inside = F.regexp_extract("path", r"^[^/]+/[^/]+/(.+)/[^/]+$", 1)
    kind = F.when(inside.isin(*image_dirs), "image").when(inside == live_dir, "live_photo").otherwise(kind)
    post, ordinal = media_name(F.col("path"))
    return files.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("raw_post_id", post).withColumn("ordinal", ordinal)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped, anything else that isn't an object fails."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """Parquet through Spark's commit protocol: readers see all of a table or none; an existing one is an error unless told."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
