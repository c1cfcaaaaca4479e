"""Registered queries of the audit and the preparation of raw exports: events as posts and media files of two groups of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import ingest
from weftline.plans.queries import query, table
from weftline.sources import raw

KEY = b"weftline-test-key"
LABELS = {"case": ("case", 1), "control": ("control", 0)}
_GROUP = "CASE WHEN user_id % 2 = 0 THEN 'case' ELSE 'control' END"
_POST = "CASE WHEN event_id % 13 = 0 THEN ' ' ELSE CAST(event_id % 500 AS STRING) END"
#: Two directories of media; some names have no post id, some ids belong to no post.
_FILE = """concat(CASE WHEN event_id % 3 = 0 THEN 'live_photo' ELSE 'img/original' END, '/',
  CASE WHEN event_id % 19 = 0 THEN concat('IMG', event_id, '.PNG') WHEN event_id % 5 = 0 THEN concat('m_', 100000 + event_id, '_2.jpg') ELSE concat('m_', event_id % 500, '.jpg') END)"""


def _raw(spark: SparkSession, sf_dir: str, repeated: bool) -> ingest.RawTables:
    """A user in seven has no table of posts, one in eleven isn't listed, some listed ones have no directory; listings repeat if told."""
    e = table(spark, sf_dir, "events").withColumn("source_group", F.expr(_GROUP)).withColumn("user", F.col("user_id").cast("string"))
    own = e.select("source_group", "user", "user_id").distinct()
    listed = own.where("user_id % 11 != 0").select("source_group", F.col("user").alias("user_id"))
    absent = table(spark, sf_dir, "customer").where("c_custkey % 100 = 7").select(F.lit("case").alias("source_group"), F.concat(F.lit("c"), "c_custkey").alias("user_id"))
    users = listed.unionByName(absent)
    if repeated:
        users = users.unionByName(own.where("user_id % 9 = 0").select("source_group", F.col("user").alias("user_id")))
    date = F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    cells = {raw.POST_ID: F.expr(_POST), raw.POST_TEXT: F.col("event_type"), raw.POST_DATE: date}
    posts = e.where("user_id % 7 != 0").select("source_group", F.col("user").alias("user_id"), F.col("event_id").alias("__ordinal"), *(cells.get(c, F.lit(None).cast("string")).alias(c) for c in raw.POST_COLUMNS))
    at = lambda name: F.concat_ws("/", "source_group", "user", name).alias("path")
    tables = own.select("source_group", F.col("user").alias("user_id"), at(F.when(F.col("user_id") % 7 != 0, F.concat("user", F.lit(".csv"))).otherwise("notes.txt")))
    files = tables.unionByName(e.where("event_type = 'click'").select("source_group", F.col("user").alias("user_id"), at(F.expr(_FILE))))
    return ingest.RawTables(users, posts, files, raw.read_media(files, ["img/original"], "live_photo"))


_ROWS = f"""
e AS (SELECT event_id, user_id, {_GROUP} AS g, trim({_POST.replace("STRING", "VARCHAR")}) AS sid, event_type, CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS day, ts FROM events),
own AS (SELECT DISTINCT g, CAST(user_id AS VARCHAR) AS u, user_id FROM e),
listed AS (SELECT g, u FROM own WHERE user_id % 11 <> 0 UNION ALL SELECT 'case', 'c' || c_custkey FROM customer WHERE c_custkey % 100 = 7),
posts AS (SELECT *, sid <> '' AND row_number() OVER w > 1 AS again, (event_type, day) IS DISTINCT FROM lag((event_type, day)) OVER w AS changed FROM e WHERE user_id % 7 <> 0 WINDOW w AS (PARTITION BY g, user_id, sid ORDER BY event_id)),
ids AS (SELECT DISTINCT g, user_id, sid FROM posts WHERE sid <> ''),
files AS (SELECT g, user_id, event_id % 3 = 0 AS live, event_id % 19 = 0 AS nameless, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(100000 + event_id AS VARCHAR) ELSE CAST(event_id % 500 AS VARCHAR) END AS sid FROM e WHERE event_type = 'click'),
media AS (SELECT f.*, i.sid IS NOT NULL AS known FROM files f LEFT JOIN ids i USING (g, user_id, sid))"""


def _per_group(parts: list[tuple[str, str]], names: list[str]) -> str:
    """Tables of one row a group side by side; what a group lacks is 0."""
    joins = " ".join(f"LEFT JOIN ({sql}) {t} USING (g)" for t, sql in parts)
    return f"SELECT g AS source_group, {', '.join(f'CAST(coalesce({n}, 0) AS BIGINT) AS {n}' for n in names)}" + " FROM (SELECT DISTINCT g FROM e) " + joins


_AUDIT = [
    ("a", "SELECT g, count(*) AS user_rows, count(DISTINCT u) AS unique_listed_users, count(*) - count(DISTINCT u) AS duplicate_user_rows, count(DISTINCT u) FILTER (u LIKE 'c%') AS listed_without_directory FROM (SELECT g, u FROM listed UNION ALL SELECT g, u FROM own WHERE user_id % 9 = 0) GROUP BY 1"),
    ("b", "SELECT g, count(*) AS user_directories, count(*) FILTER (user_id % 7 = 0) AS missing_post_csv, count(*) FILTER (user_id % 11 = 0 AND user_id % 9 <> 0) AS directory_without_listing FROM own GROUP BY 1"),
    ("c", "SELECT g, count(*) AS post_rows, count(*) FILTER (again) AS repeats, count(DISTINCT CASE WHEN again THEN user_id END) AS subjects_with_duplicate_post_ids, count(DISTINCT CASE WHEN again AND changed THEN (user_id, sid) END) AS conflicting_duplicate_post_ids, count(*) FILTER (sid = '') AS missing_post_ids, count(*) FILTER (day = 'bad') AS invalid_dates FROM posts GROUP BY 1"),
    ("d", "SELECT g, count(DISTINCT sid) AS unique_post_ids, count(*) - count(DISTINCT sid) AS post_ids_shared_between_subjects FROM ids GROUP BY 1"),
    ("m", "SELECT g, count(*) AS media_files, count(*) FILTER (NOT live) AS image_files, count(*) FILTER (live) AS live_photo_files, count(*) FILTER (nameless) AS media_without_parseable_post_id, count(*) FILTER (NOT nameless AND NOT known) AS media_without_matching_post, count(*) FILTER (nameless) AS png, count(*) FILTER (NOT nameless) AS jpg FROM media GROUP BY 1"),
]
_AUDITED = ["user_rows", "unique_listed_users", "duplicate_user_rows", "user_directories", "missing_post_csv", "listed_without_directory", "directory_without_listing", "post_rows", "subjects_with_duplicate_post_ids", "conflicting_duplicate_post_ids", "missing_post_ids", "invalid_dates", "unique_post_ids", "post_ids_shared_between_subjects", "media_files", "image_files", "live_photo_files", "media_without_parseable_post_id", "media_without_matching_post", "png", "jpg"]


@query(f"WITH {_ROWS}, audit AS ({_per_group(_AUDIT, [*_AUDITED, 'repeats'])}), days AS (SELECT g AS source_group, min(day) FILTER (day <> 'bad') AS earliest, max(day) FILTER (day <> 'bad') AS latest FROM posts GROUP BY 1) SELECT * EXCLUDE (repeats), repeats + post_ids_shared_between_subjects AS duplicate_post_ids FROM audit LEFT JOIN days USING (source_group)")
def raw_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the raw tree: listings, directories, duplicate and conflicting ids, dates and media of both groups."""
    found = ingest.audit(_raw(spark, sf_dir, True))
    ext = lambda x: F.coalesce(F.try_element_at("media_extensions", F.lit(x)), F.lit(0)).alias(x[1:])
    day = lambda c: F.date_format(f"{c}_post_at", "yyyy-MM-dd").alias(c)
    return found.select("source_group", *(c for c in _AUDITED if c not in ("png", "jpg")), "duplicate_post_ids", ext(".png"), ext(".jpg"), day("earliest"), day("latest"))


_PREPARED = [
    ("a", "SELECT g, count(*) AS subjects_total, count(*) FILTER (reason IS NULL) AS subjects_eligible, count(*) FILTER (reason IS NOT NULL) AS subjects_excluded, sum(posts) AS posts, sum(media) AS media, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS excluded_{r}" for r in ("missing_user_metadata_row", "missing_user_directory", "missing_post_csv", "no_valid_posts")) + " FROM who GROUP BY 1"),
    ("b", "SELECT g, count(*) FILTER (sid = '') AS posts_missing_sid, count(*) FILTER (again) AS posts_duplicate_rows_dropped, count(*) FILTER (again AND changed) AS posts_conflicting_duplicate_rows FROM posts WHERE user_id % 11 <> 0 GROUP BY 1"),
    ("c", "SELECT g, count(*) FILTER (nameless) AS media_unparseable, count(*) FILTER (NOT nameless AND NOT known) AS media_unmatched FROM media WHERE user_id % 11 <> 0 AND user_id % 7 <> 0 GROUP BY 1"),
]
_COUNTED = ["subjects_total", "subjects_eligible", "subjects_excluded", "posts", "media", "excluded_missing_user_metadata_row", "excluded_missing_user_directory", "excluded_missing_post_csv", "excluded_no_valid_posts", "posts_missing_sid", "posts_duplicate_rows_dropped", "posts_conflicting_duplicate_rows", "media_unparseable", "media_unmatched"]
_WHO = """who AS (SELECT coalesce(l.g, o.g) AS g, coalesce(n.posts, 0) AS posts, coalesce(k.media, 0) AS media,
  CASE WHEN l.u IS NULL THEN 'missing_user_metadata_row' WHEN o.u IS NULL THEN 'missing_user_directory' WHEN o.user_id % 7 = 0 THEN 'missing_post_csv' WHEN n.posts IS NULL THEN 'no_valid_posts' END AS reason
  FROM listed l FULL JOIN own o ON l.g = o.g AND l.u = o.u
  LEFT JOIN (SELECT g, user_id, count(*) AS posts FROM ids WHERE user_id % 11 <> 0 GROUP BY ALL) n ON n.g = o.g AND n.user_id = o.user_id
  LEFT JOIN (SELECT g, user_id, count(*) AS media FROM media WHERE user_id % 11 <> 0 AND user_id % 7 <> 0 GROUP BY ALL) k ON k.g = o.g AND k.user_id = o.user_id)"""


@query(f"WITH {_ROWS}, {_WHO} {_per_group(_PREPARED, _COUNTED)}")
def raw_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a whole preparation: reasons of exclusion, posts deduplicated by last row, media joined to posts."""
    return ingest.prepare(_raw(spark, sf_dir, False), KEY, LABELS, ["click"]).counters


_SID = "CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 100000 + event_id ELSE event_id % 500 END"


@query(f"""
WITH {_ROWS}, f AS (SELECT g, user_id, {_SID} AS sid, event_id % 3 = 0 AS live, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS ordinal FROM e WHERE event_type = 'click' AND user_id % 11 <> 0 AND user_id % 7 <> 0)
SELECT CASE WHEN live THEN 'live_photo' ELSE 'image' END AS kind, ordinal, i.sid IS NOT NULL AS matched, count(*) AS files FROM f LEFT JOIN ids i ON i.g = f.g AND i.user_id = f.user_id AND i.sid = CAST(f.sid AS VARCHAR) GROUP BY ALL
""")
def prepared_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of a preparation by kind, place in the post and whether the post is known."""
    media = ingest.prepare(_raw(spark, sf_dir, False), KEY, LABELS, ["click"]).media
    return media.groupBy("kind", "ordinal", F.col("post_id").isNotNull().alias("matched")).agg(F.count("*").alias("files"))
