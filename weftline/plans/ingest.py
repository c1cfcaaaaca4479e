"""Raw exports to prepared tables, and the audit of the raw tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.identity import extension, pseudonym
from weftline.functions.metadata import metadata_vector, parse_count, parse_datetime, preferred
from weftline.functions.text import clean_text, mentions
from weftline.operators.windowing import keep_last
from weftline.sources import raw


@dataclass(frozen=True)
class RawTables:
    """users (source_group, user_id), posts (as read_posts), files (as read_files), media (as read_media)."""

    users: DataFrame
    posts: DataFrame
    files: DataFrame
    media: DataFrame


@dataclass(frozen=True)
class Prepared:
    subjects: DataFrame
    posts: DataFrame
    media: DataFrame
    identities: DataFrame
    counters: DataFrame


def _directories(t: RawTables) -> DataFrame:
    """(source_group, user_id, has_posts) of each user with a directory."""
    own = F.element_at(F.split("path", "/"), -1) == F.concat("user_id", F.lit(".csv"))
    return t.files.groupBy("source_group", "user_id").agg(F.max(own).alias("has_posts"))


def exclusions(users: DataFrame, directories: DataFrame) -> DataFrame:
    """Listed or existing users with the first reason that excludes each: a full outer join."""
    listed = users.select("source_group", "user_id").distinct().withColumn("listed", F.lit(True))
    both = listed.join(directories, ["source_group", "user_id"], "full_outer")
    reason = (
        F.when(F.col("listed").isNull(), "missing_user_metadata_row")
        .when(F.col("has_posts").isNull(), "missing_user_directory")
        .when(~F.col("has_posts"), "missing_post_csv")
    )
    return both.select("source_group", "user_id", reason.alias("exclusion_reason"))


def prepare(t: RawTables, key: bytes, labels: dict[str, tuple[str, int]], keywords: Sequence[str]) -> Prepared:
    """Pseudonymous subjects, posts and media. `labels` maps a group to its label's name and id.

    A user listed twice in a group is an error.
    """
    twice = t.users.groupBy("source_group", "user_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a user of group {twice[0][0]} is listed more than once")
    who = exclusions(t.users, _directories(t))
    sid = F.trim(F.coalesce(F.col(raw.POST_ID), F.lit("")))
    rows = t.posts.withColumn("raw_post_id", sid).join(who.where("exclusion_reason IS NULL").select("source_group", "user_id"), ["source_group", "user_id"], "left_semi")
    unique = keep_last(rows.where("raw_post_id != ''"), ["source_group", "user_id", "raw_post_id"], "__ordinal")
    subject = pseudonym(key, "subject", F.col("source_group"), F.col("user_id"))
    post = pseudonym(key, "post", F.col("source_group"), F.col("user_id"), F.col("raw_post_id"))
    when = parse_datetime(preferred(F.col(raw.POST_DATE), F.col(raw.POST_DATE_FALLBACK)))
    counts = [parse_count(F.col(c)).alias(n) for c, n in ((raw.LIKES, "likes"), (raw.COMMENTS, "comments"), (raw.REPOSTS, "reposts"))]
    typed = unique.select(
        "source_group", "user_id", "raw_post_id", subject.alias("subject_id"), post.alias("post_id"), when.alias("published_at"),
        clean_text(F.col(raw.POST_TEXT), F.col(raw.POST_LOCATION)).alias("cleaned_text"), *counts,
    )
    typed = typed.withColumn("contains_study_keyword", mentions(F.col("cleaned_text"), keywords)).withColumn("metadata_vector", metadata_vector(F.col("likes"), F.col("comments"), F.col("reposts"), F.col("published_at")))
    fit = who.where("exclusion_reason IS NULL")
    found = t.media.join(fit.select("source_group", "user_id"), ["source_group", "user_id"], "left_semi")
    known = typed.select("source_group", "user_id", "raw_post_id", "post_id")
    media = found.join(known, ["source_group", "user_id", "raw_post_id"], "left").select(
        "source_group", "user_id", subject.alias("subject_id"), pseudonym(key, "media", F.col("source_group"), F.col("user_id"), F.col("path")).alias("media_id"),
        "post_id", "kind", "ordinal", extension(F.col("path")).alias("extension"), "path", "raw_post_id",
    )
    order = F.struct(F.col("published_at").isNotNull(), "published_at", "post_id")
    per = typed.groupBy("source_group", "user_id").agg(F.count("*").alias("post_count"), F.min_by("published_at", order).alias("first_post_at"), F.max_by("published_at", order).alias("last_post_at"))
    per_media = media.groupBy("source_group", "user_id").agg(F.count("*").alias("media_count"))
    label = F.create_map(*(F.lit(x) for g, (name, i) in labels.items() for x in (g, name)))
    label_id = F.create_map(*(F.lit(x) for g, (name, i) in labels.items() for x in (g, i)))
    subjects = who.join(per, ["source_group", "user_id"], "left").join(per_media, ["source_group", "user_id"], "left")
    reason = F.coalesce("exclusion_reason", F.when(F.coalesce("post_count", F.lit(0)) == 0, "no_valid_posts"))
    subjects = subjects.select(
        subject.alias("subject_id"), "source_group", label[F.col("source_group")].alias("label_name"), label_id[F.col("source_group")].alias("label_id"),
        reason.isNull().alias("eligible"), reason.alias("exclusion_reason"), F.coalesce("post_count", F.lit(0)).alias("post_count"), F.coalesce("media_count", F.lit(0)).alias("media_count"),
        "first_post_at", "last_post_at",
    )
    ids = typed.groupBy("subject_id", "source_group", "user_id").agg(F.sort_array(F.collect_list(F.struct("post_id", "raw_post_id"))).alias("posts"))
    files = media.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("media_id", F.col("path").alias("source_relative_path")))).alias("media"))
    posts = typed.select("subject_id", "post_id", "published_at", "cleaned_text", "contains_study_keyword", "likes", "comments", "reposts", "metadata_vector")
    counters = prepare_counters(subjects).join(_post_counters(rows), "source_group", "left").join(_media_counters(media), "source_group", "left")
    return Prepared(subjects, posts, media.select("subject_id", "media_id", "post_id", "kind", "ordinal", "extension"), ids.join(files, "subject_id", "left"), counters.na.fill(0))


def prepare_counters(subjects: DataFrame) -> DataFrame:
    """Per group: subjects, posts, media and exclusions by reason."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    reasons = ("missing_user_metadata_row", "missing_user_directory", "missing_post_csv", "no_valid_posts")
    return subjects.groupBy("source_group").agg(
        F.count("*").alias("subjects_total"),
        n(F.col("eligible")).alias("subjects_eligible"),
        n(~F.col("eligible")).alias("subjects_excluded"),
        F.sum("post_count").alias("posts"),
        F.sum("media_count").alias("media"),
        *(n(F.coalesce(F.col("exclusion_reason") == r, F.lit(False))).alias(f"excluded_{r}") for r in reasons),
    )


def _post_counters(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_group", "user_id", "raw_post_id").orderBy("__ordinal")
    h = F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in raw.POST_COLUMNS))
    seen = rows.select("source_group", "user_id", "raw_post_id", "__ordinal", h.alias("h")).withColumn("prev", F.lag("h").over(order))
    seen = seen.withColumn("again", (F.col("raw_post_id") != "") & F.col("prev").isNotNull())
    n = lambda c: F.sum(c.cast("long"))
    return seen.groupBy("source_group").agg(
        n(F.col("raw_post_id") == "").alias("posts_missing_sid"),
        n(F.col("again")).alias("posts_duplicate_rows_dropped"),
        n(F.col("again") & (F.col("h") != F.col("prev"))).alias("posts_conflicting_duplicate_rows"),
    )


def _media_counters(media: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return media.groupBy("source_group").agg(
        n(F.col("raw_post_id").isNull()).alias("media_unparseable"),
        n(F.col("raw_post_id").isNotNull() & F.col("post_id").isNull()).alias("media_unmatched"),
    )


def audit(t: RawTables) -> DataFrame:
    """One row per group: counts of users, directories, posts, duplicates, dates and media, a histogram and a digest."""
    n = lambda c: F.sum(c.cast("long"))
    key = ["source_group"]
    users = t.users.groupBy(*key).agg(F.count("*").alias("user_rows"), F.count_distinct("user_id").alias("unique_listed_users"))
    users = users.withColumn("duplicate_user_rows", F.col("user_rows") - F.col("unique_listed_users"))
    dirs = _directories(t)
    d = dirs.groupBy(*key).agg(F.count("*").alias("user_directories"), n(~F.col("has_posts")).alias("missing_post_csv"))
    listed = t.users.select(*key, "user_id").distinct()
    lone = listed.join(dirs, [*key, "user_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("listed_without_directory"))
    extra = dirs.join(listed, [*key, "user_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("directory_without_listing"))
    sid = F.trim(F.coalesce(F.col(raw.POST_ID), F.lit("")))
    date = preferred(F.col(raw.POST_DATE), F.col(raw.POST_DATE_FALLBACK))
    h = F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in raw.POST_COLUMNS))
    rows = t.posts.select(*key, "user_id", "__ordinal", sid.alias("sid"), date.alias("date"), parse_datetime(date).alias("at"), h.alias("h"))
    own = Window.partitionBy(*key, "user_id", "sid").orderBy("__ordinal")
    rows = rows.withColumn("prev", F.lag("h").over(own)).withColumn("again", (F.col("sid") != "") & F.col("prev").isNotNull())
    per_id = rows.groupBy(*key, "user_id", "sid").agg(F.count("*").alias("rows"), n(F.col("again")).alias("again"), F.max((F.col("again") & (F.col("h") != F.col("prev"))).cast("long")).alias("conflict"), n(F.trim(F.coalesce("date", F.lit(""))) != "").alias("dated"), n(F.col("at").isNotNull()).alias("parsed"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    # an id that several users have is shared by all but the first of them
    per_user = per_id.groupBy(*key, "user_id").agg(F.sum("rows").alias("rows"), F.sum("again").alias("again"), F.sum("conflict").alias("conflict"), n(F.col("sid") != "").alias("ids"), F.sum(F.when(F.col("sid") == "", F.col("rows")).otherwise(0)).alias("missing"), F.sum("dated").alias("dated"), F.sum("parsed").alias("parsed"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ids = per_id.where("sid != ''").groupBy(*key).agg(F.count_distinct("sid").alias("unique_post_ids"))
    posts = per_user.groupBy(*key).agg(
        F.sum("rows").alias("post_rows"), F.sum("again").alias("again"), n(F.col("again") > 0).alias("subjects_with_duplicate_post_ids"), F.sum("conflict").alias("conflicting_duplicate_post_ids"),
        F.sum("ids").alias("ids"), F.sum("missing").alias("missing_post_ids"), (F.sum("dated") - F.sum("parsed")).alias("invalid_dates"), F.min("lo").alias("earliest_post_at"), F.max("hi").alias("latest_post_at"),
    )
    posts = posts.join(ids, key, "left").withColumn("post_ids_shared_between_subjects", F.col("ids") - F.col("unique_post_ids"))
    posts = posts.withColumn("duplicate_post_ids", F.col("again") + F.col("post_ids_shared_between_subjects")).drop("again", "ids")
    media = t.media.join(per_id.where("sid != ''").select(*key, "user_id", F.col("sid").alias("raw_post_id"), F.lit(True).alias("known")), [*key, "user_id", "raw_post_id"], "left")
    m = media.groupBy(*key).agg(
        F.count("*").alias("media_files"), n(F.col("kind") == "image").alias("image_files"), n(F.col("kind") == "live_photo").alias("live_photo_files"),
        n(F.col("raw_post_id").isNull()).alias("media_without_parseable_post_id"), n(F.col("raw_post_id").isNotNull() & F.col("known").isNull()).alias("media_without_matching_post"),
    )
    kinds = media.groupBy(*key, extension(F.col("path")).alias("ext")).count().groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "count")))).alias("media_extensions"))
    prints = t.files.groupBy(*key).agg(F.sha2(F.concat_ws("\0", F.count("*").cast("string"), F.sum(F.xxhash64("path").cast("decimal(38,0)")).cast("string")), 256).alias("inventory_sha256"))
    out = users
    for part in (d, lone, extra, posts, m, kinds, prints):
        out = out.join(part, key, "left")
    return out.na.fill(0)
