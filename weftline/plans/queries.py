"""Registered queries of the reference's operators on the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import identity as ident
from weftline.functions import metadata as meta
from weftline.functions import text as txt
from weftline.operators import audits as aud
from weftline.operators import constraints as con
from weftline.operators import folds as fo
from weftline.operators import metrics as met
from weftline.operators import models as mod
from weftline.operators import neural, newton
from weftline.operators import pooling as pool
from weftline.operators import stats as st
from weftline.operators import tfidf
from weftline.operators import windowing as win

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYWORDS = ("worthless", "idiot", "the and", "clown")
SEEDS = (58, 59, 60, 61)
FOLDS = 5
KEY = b"weftline-test-key"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- text, dates, numbers ----------------------------------------------------------------------

_W = r"[\s\p{Z}]"


@query(
    rf"""
WITH a AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS v, source FROM documents),
b AS (SELECT doc_id, source, v, regexp_replace(v, '{_W}*\n[^\n\r]{{1,120}}的微博视频{_W}*\z', '') AS c FROM a),
t AS (SELECT doc_id, v, source, regexp_replace(c, '(\n{_W}*)+\z', '') AS c FROM b),
s AS (SELECT doc_id, v, CASE WHEN regexp_replace(string_split(c, chr(10))[-1], '\A{_W}+|{_W}+\z', '', 'g') = source
      THEN array_to_string(string_split(c, chr(10))[:-2], chr(10)) ELSE c END AS c FROM t),
f AS (SELECT doc_id, v, c, list_filter(list_transform(string_split(c, chr(10)), lambda x: regexp_replace(x, '\A{_W}+|{_W}+\z', '', 'g')), lambda x: x <> '') AS l FROM s),
g AS (SELECT doc_id, CASE WHEN regexp_matches(v, '\A{_W}*分享(图片|视频){_W}*\z') OR (coalesce(l[1] IN ('分享图片', '分享视频'), false) AND len(l) <= 2) THEN '' ELSE regexp_replace(c, '{_W}+\z', '') END AS cleaned FROM f)
SELECT doc_id, CAST(length(cleaned) AS BIGINT) AS n_chars, sha256(cleaned) AS digest FROM g
"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", txt.clean_text(F.col("text"), F.col("source")).alias("c"))
    return docs.select("doc_id", long(F.length("c")).alias("n_chars"), F.sha2("c", 256).alias("digest"))


_RE = "(?i)the and|worthless|clown|idiot"


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_RE}', '[MASK]', 'g')) AS digest FROM documents")
def mask_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(txt.mask_keywords(F.col("text"), KEYWORDS), 256).alias("digest"))


@query(f"SELECT doc_id, regexp_matches(text, '{_RE}') AS found, CAST(len(regexp_extract_all(text, '{_RE}')) AS BIGINT) AS n FROM documents")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", txt.contains_keywords(F.col("text"), KEYWORDS).alias("found"), txt.count_keywords(F.col("text"), KEYWORDS).alias("n"))


@query(
    "SELECT conv_id, turn, contains(lower(text), 'worthless') OR contains(lower(text), 'idiot') OR contains(lower(text), 'the and') OR contains(lower(text), 'clown') AS mentions FROM conversations WHERE text IS NOT NULL"
)
def study_keyword_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", txt.mentions(F.col("text"), KEYWORDS).alias("mentions"))


@query(
    f"""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 4 AND NOT coalesce(regexp_matches(text, '(?i)the|worthless'), false)
"""
)
def condition_removed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    window = win.recent(rows, "conv_id", "turn", "role", 4)
    return win.apply_condition(window, "text", "removed", ["the", "worthless"]).select("conv_id", "turn", "role")


_RAW_COUNT = "CASE event_id % 7 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || ' ' WHEN 1 THEN '-3' WHEN 2 THEN '4.9' WHEN 3 THEN '' WHEN 4 THEN 'abc' WHEN 5 THEN '1e3' ELSE NULL END"


@query(
    f"""
SELECT event_id, CAST(greatest(coalesce(trunc(TRY_CAST(CASE WHEN regexp_matches(trim(s), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN trim(s) END AS DOUBLE)), 0), 0) AS BIGINT) AS n
FROM (SELECT event_id, {_RAW_COUNT} AS s FROM events)
"""
)
def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_RAW_COUNT.replace("VARCHAR", "STRING")).alias("s"))
    return rows.select("event_id", meta.parse_count(F.col("s")).alias("n"))


@query(
    """
WITH s AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
  WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M') WHEN 4 THEN strftime(ts, ' %Y-%m-%d ') WHEN 5 THEN 'no date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS d FROM events)
SELECT event_id, strftime(coalesce(try_strptime(trim(d), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(d), '%Y-%m-%d %H:%M'), try_strptime(trim(d), '%Y/%m/%d %H:%M:%S'),
  try_strptime(trim(d), '%Y/%m/%d %H:%M'), try_strptime(trim(d), '%Y-%m-%d'), TRY_CAST(d AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS parsed FROM s
"""
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda p: F.date_format("ts", p)
    kind = F.col("event_id") % 7
    raw = F.when(kind == 0, f("yyyy-MM-dd HH:mm:ss")).when(kind == 1, f("yyyy-MM-dd HH:mm")).when(kind == 2, f("yyyy/MM/dd HH:mm:ss")).when(kind == 3, f("yyyy/MM/dd HH:mm"))
    raw = raw.when(kind == 4, f(" yyyy-MM-dd ")).when(kind == 5, "no date").otherwise(f("yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, sf_dir, "events").select("event_id", meta.parse_datetime(raw).alias("t"))
    return rows.select("event_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: user, event, time and three counts."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), F.col("event_id").alias("post_id"), F.col("ts").alias("published_at"),
        F.floor("value").cast("long").alias("likes"), F.get_json_object("props", "$.k").try_cast("long").alias("comments"), F.length("event_type").cast("long").alias("reposts"),
    )


_POSTS = """p AS (SELECT user_id AS subject_id, event_id AS post_id, ts AS published_at, CAST(floor(value) AS BIGINT) AS likes,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS comments, CAST(length(event_type) AS BIGINT) AS reposts FROM events)"""
_ANGLE = "2 * pi() * (hour(published_at) * 3600 + minute(published_at) * 60 + second(published_at)) / 86400.0"
_FEATURES = f"ln(1 + greatest(coalesce(likes, 0), 0)) AS f0, ln(1 + greatest(coalesce(comments, 0), 0)) AS f1, ln(1 + greatest(coalesce(reposts, 0), 0)) AS f2, coalesce(sin({_ANGLE}), 0) AS f3, coalesce(cos({_ANGLE}), 0) AS f4"


def _vector(df: DataFrame) -> list[Column]:
    cols = meta.metadata_columns(F.col("likes"), F.col("comments"), F.col("reposts"), F.col("published_at"))
    return [c.alias(f"f{k}") for k, c in enumerate(cols)]


@query(f"WITH {_POSTS}, v AS (SELECT post_id, {_FEATURES} FROM p) SELECT post_id, " + ", ".join(f"round(f{k}, 6) AS f{k}" for k in range(5)) + " FROM v")
def metadata_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return p.select("post_id", *_vector(p)).select("post_id", *(r6(f"f{k}").alias(f"f{k}") for k in range(5)))


_INNER, _OUTER = (x.hex() for x in ident._pads(KEY))


@query(
    f"""
SELECT c_custkey, 'subject-' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('subject') || unhex('00') || encode(c_mktsegment) || unhex('00') || encode(CAST(c_custkey AS VARCHAR))))), 1, 24) AS pseudonym FROM customer
"""
)
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ident.pseudonym(KEY, "subject", F.col("c_mktsegment"), F.col("c_custkey")).alias("pseudonym"))


@query("SELECT c_custkey, sha256(concat_ws(chr(31), '58', 'outer', c_nationkey, c_custkey)) AS digest FROM customer")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ident.stable_digest(58, F.lit("outer"), F.col("c_nationkey"), F.col("c_custkey")).alias("digest"))


@query(
    """
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '_2.JPG' WHEN 1 THEN '.png' ELSE '' END AS f FROM part),
s AS (SELECT p_partkey, f, string_split(regexp_replace(f, '\\.[^.]*$', ''), '_') AS q FROM n)
SELECT p_partkey, CASE WHEN len(q) >= 2 AND regexp_matches(q[2], '^\\d+$') THEN q[2] END AS post, CASE WHEN len(q) >= 2 AND regexp_matches(q[2], '^\\d+$') THEN CAST(CASE WHEN len(q) >= 3 AND regexp_matches(q[-1], '^\\d+$') THEN CAST(q[-1] AS INT) ELSE 1 END AS INT) END AS ordinal,
       CASE WHEN f LIKE '%.%' THEN lower(regexp_extract(f, '\\.[^.]+$')) ELSE '<none>' END AS ext FROM s
"""
)
def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "_2.JPG").when(F.col("p_partkey") % 3 == 1, ".png").otherwise("")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), tail)
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("f"))
    post, ordinal = ident.media_name(F.col("f"))
    return rows.select("p_partkey", post.alias("post"), ordinal.alias("ordinal"), ident.extension(F.col("f")).alias("ext"))


# ---- windows and dedup -------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1")
def keep_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.struct("l_linenumber", "l_extendedprice").alias("at"))
    return win.keep_last(rows, ["l_orderkey", "l_partkey"], "at").withColumn("l_quantity", r6("l_quantity")).drop("at")


@query(
    """
WITH a AS (SELECT l_returnflag, l_orderkey, l_suppkey % 20 AS k, l_quantity, lag(l_quantity) OVER (PARTITION BY l_returnflag, l_orderkey, l_suppkey % 20 ORDER BY l_linenumber, l_extendedprice) AS prev FROM lineitem),
b AS (SELECT l_returnflag, l_orderkey, k, count(*) - 1 AS dropped, sum(CASE WHEN prev <> l_quantity THEN 1 ELSE 0 END) AS conflicts FROM a GROUP BY ALL)
SELECT l_returnflag, CAST(sum(dropped) AS BIGINT) AS duplicate_rows_dropped, CAST(sum(conflicts) AS BIGINT) AS conflicting_rows, CAST(sum(CASE WHEN conflicts > 0 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_keys FROM b GROUP BY 1
"""
)
def duplicate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey") % 20).withColumn("at", F.struct("l_linenumber", "l_extendedprice"))
    return win.duplicate_counts(rows, ["l_returnflag"], ["l_orderkey", "k"], ["l_quantity"], "at")


@query("SELECT user_id AS subject_id, event_id AS post_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn <= 64")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.recent(posts(spark, sf_dir), "subject_id", "published_at", "post_id", 64).select("subject_id", "post_id")


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"WITH {_NUMBERED} SELECT user_id AS subject_id, event_id AS post_id FROM n WHERE n <= 8 OR pos IN (SELECT 1 WHERE false) OR list_contains(list_transform(range(8), lambda i: CAST(round_even(i * (n - 1) / 7.0, 0) AS BIGINT)), pos)")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.evenly_sampled(win.numbered(posts(spark, sf_dir), "subject_id", "published_at", "post_id"), 8).select("subject_id", "post_id")


@query(
    f"""
WITH {_NUMBERED} SELECT user_id AS subject_id, CAST(count(*) FILTER (WHERE pos < greatest(1, n // 2)) AS BIGINT) AS n_early, CAST(count(*) FILTER (WHERE pos >= greatest(1, n // 2) OR n = 1) AS BIGINT) AS n_late,
  round(avg(floor(value)) FILTER (WHERE pos < greatest(1, n // 2)), 6) AS early, round(avg(floor(value)) FILTER (WHERE pos >= greatest(1, n // 2) OR n = 1), 6) AS late FROM n GROUP BY 1
"""
)
def temporal_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.halves(win.numbered(posts(spark, sf_dir), "subject_id", "published_at", "post_id"))
    part = lambda c: F.when(F.col(c), F.col("likes").cast("double"))
    return rows.groupBy("subject_id").agg(F.count(part("early")).alias("n_early"), F.count(part("late")).alias("n_late"), r6(F.avg(part("early"))).alias("early"), r6(F.avg(part("late"))).alias("late"))


@query(
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 4 AS w, coalesce(regexp_matches(text, '(?i)the and|worthless|clown|idiot'), false) AS h FROM conversations)
SELECT conv_id, count(*) AS history, CAST(count(*) FILTER (WHERE NOT h) AS BIGINT) AS history_after_removal, CAST(count(*) FILTER (WHERE w) AS BIGINT) AS "window",
  CAST(count(*) FILTER (WHERE w AND NOT h) AS BIGINT) AS window_after_removal, CAST(count(*) FILTER (WHERE w AND h) AS BIGINT) AS removed_in_window FROM r GROUP BY 1
"""
)
def selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.selection_audit(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 4, KEYWORDS)


@query("SELECT conv_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS digest FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1)")
def subject_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tfidf.document(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), "conv_id", ["turn", "role"], "text")
    return docs.select("conv_id", long(F.length("text")).alias("n_chars"), F.sha2("text", 256).alias("digest"))


# ---- joins and counters ------------------------------------------------------------------------


@query(
    """
WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer), d AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(l.k, d.k) AS user_id, CASE WHEN l.k IS NULL THEN 'missing_user_metadata_row' WHEN d.k IS NULL THEN 'missing_user_directory' WHEN n < 10 THEN 'missing_post_csv' END AS exclusion_reason FROM l FULL JOIN d ON l.k = d.k
"""
)
def full_outer_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.plans.ingest import exclusions

    users = table(spark, sf_dir, "customer").select(F.lit("g").alias("source_group"), F.col("c_custkey").alias("user_id"))
    orders = table(spark, sf_dir, "orders").groupBy(F.lit("g").alias("source_group"), F.col("o_custkey").alias("user_id")).agg((F.count("*") >= 10).alias("has_posts"))
    return exclusions(users, orders).select("user_id", "exclusion_reason")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return con.set_difference(table(spark, sf_dir, "customer"), orders, ["c_custkey"])


@query(
    """
SELECT event_type, count(*) AS rows, CAST(count(DISTINCT user_id) AS BIGINT) AS users, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest,
  CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM events GROUP BY 1
"""
)
def group_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), day(F.min("ts")).alias("earliest"), day(F.max("ts")).alias("latest"), F.sum(F.col("value").isNull().cast("long")).alias("missing"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the events as subjects with a label, whole and windowed post counts."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject_id")).agg(F.count("*").alias("post_count"))
    return rows.select("subject_id", (F.col("subject_id") % 2).cast("int").alias("label_id"), "post_count", F.least("post_count", F.lit(64)).alias("split_post_count"))


_SUBJECTS = "s AS (SELECT user_id AS subject_id, CAST(user_id % 2 AS INT) AS label_id, count(*) AS post_count, least(count(*), 64) AS split_post_count FROM events GROUP BY user_id)"


@query(
    f"""
WITH {_SUBJECTS}, g AS (SELECT *, CASE WHEN post_count < 60 THEN 'no_valid_posts' END AS reason FROM s)
SELECT CAST(label_id AS VARCHAR) AS source_group, count(*) AS subjects_total, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS subjects_eligible, CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS subjects_excluded,
  CAST(sum(post_count) AS BIGINT) AS posts, CAST(0 AS BIGINT) AS media, CAST(0 AS BIGINT) AS excluded_missing_user_metadata_row, CAST(0 AS BIGINT) AS excluded_missing_user_directory, CAST(0 AS BIGINT) AS excluded_missing_post_csv,
  CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS excluded_no_valid_posts FROM g GROUP BY 1
"""
)
def prepare_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.plans.ingest import prepare_counters as counters

    s = subjects(spark, sf_dir).withColumn("exclusion_reason", F.when(F.col("post_count") < 60, "no_valid_posts"))
    return counters(s.select(F.col("label_id").cast("string").alias("source_group"), F.col("exclusion_reason").isNull().alias("eligible"), "exclusion_reason", "post_count", F.lit(0).cast("long").alias("media_count")))


# ---- folds -------------------------------------------------------------------------------------


def _outer_sql() -> str:
    ties = ", ".join(f"({s}, {lab}, {f}, {r})" for s in SEEDS for lab in (0, 1) for f, r in enumerate(fo.tie_order(s, lab, FOLDS)))
    zero = f"[{', '.join(['CAST(0 AS BIGINT)'] * FOLDS)}]"
    order = f"list_transform(list_sort(list_transform(range({FOLDS}), lambda f: [totals[f + 1], k[f + 1], f])), lambda x: x[3])"
    return f"""
ties(s, l, f, r) AS (VALUES {ties}),
o AS (SELECT split_seed, subject_id, label_id, split_post_count, row_number() OVER (PARTITION BY split_seed, label_id ORDER BY split_post_count DESC, sha256(concat_ws(chr(31), split_seed, 'outer', label_id, subject_id)), CAST(subject_id AS VARCHAR)) - 1 AS i
  FROM s, (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS split_seed)),
q AS (SELECT split_seed, label_id, i // {FOLDS} AS rnd, list(split_post_count ORDER BY i) AS sizes FROM o GROUP BY ALL),
tk AS (SELECT s AS split_seed, l AS label_id, list(r ORDER BY f) AS k FROM ties GROUP BY 1, 2),
t AS (SELECT n.split_seed, n.label_id, n.rnd, n.sizes, n.totals, n.k, {order.replace('totals', 'n.totals').replace('k[', 'n.k[')} AS ord FROM (
    SELECT q.split_seed, q.label_id, q.rnd, q.sizes, {zero} AS totals, tk.k FROM q JOIN tk ON q.split_seed = tk.split_seed AND q.label_id = tk.label_id WHERE rnd = 0) n
  UNION ALL SELECT n.split_seed, n.label_id, n.rnd, n.sizes, n.totals, n.k, {order.replace('totals', 'n.totals').replace('k[', 'n.k[')} AS ord FROM (
    SELECT q.split_seed, q.label_id, q.rnd, q.sizes, t.k, list_transform(range({FOLDS}), lambda f: t.totals[f + 1] + coalesce(t.sizes[list_position(t.ord, f)], 0)) AS totals
    FROM t JOIN q ON q.split_seed = t.split_seed AND q.label_id = t.label_id AND q.rnd = t.rnd + 1) n),
outer_folds AS (SELECT CAST(o.split_seed AS INT) AS split_seed, o.subject_id, CAST(t.ord[o.i % {FOLDS} + 1] AS INT) AS outer_fold, o.label_id, o.split_post_count FROM o JOIN t ON o.split_seed = t.split_seed AND o.label_id = t.label_id AND t.rnd = o.i // {FOLDS})
"""


_OUTER_SQL = _outer_sql()


@query(f"WITH RECURSIVE {_SUBJECTS}, {_OUTER_SQL} SELECT split_seed, subject_id, outer_fold FROM outer_folds")
def outer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.outer_folds(subjects(spark, sf_dir), SEEDS, FOLDS)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subjects(spark, sf_dir)
    return fo.nested_assignments(s, fo.outer_folds(s, SEEDS, FOLDS), FOLDS, 0.125)


_NESTED_SQL = f"""{_OUTER_SQL},
cells AS (SELECT f.split_seed, x.outer_fold, f.subject_id, f.label_id, f.split_post_count, f.outer_fold AS test_fold FROM outer_folds f, (SELECT unnest(range({FOLDS})) AS outer_fold) x),
rest AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY split_seed, outer_fold, label_id ORDER BY split_post_count, subject_id) - 1 AS pos FROM cells WHERE outer_fold <> test_fold WINDOW w AS (PARTITION BY split_seed, outer_fold, label_id)),
binned AS (SELECT *, CAST(least(pos * least(5, n) // n, least(5, n) - 1) AS INT) AS bin FROM rest),
sized AS (SELECT split_seed, outer_fold, label_id, bin, count(*) AS size, greatest(1, least(CAST(round_even(any_value(n) * 0.125, 0) AS BIGINT), any_value(n) - 1)) AS target FROM binned GROUP BY ALL),
shares AS (SELECT *, target * size / CAST(sum(size) OVER w AS DOUBLE) AS raw, floor(target * size / CAST(sum(size) OVER w AS DOUBLE)) AS low FROM sized WINDOW w AS (PARTITION BY split_seed, outer_fold, label_id)),
take AS (SELECT *, low + CASE WHEN row_number() OVER (PARTITION BY split_seed, outer_fold, label_id ORDER BY raw - low DESC, bin) <= target - sum(low) OVER (PARTITION BY split_seed, outer_fold, label_id) THEN 1 ELSE 0 END AS k FROM shares),
placed AS (SELECT b.*, row_number() OVER (PARTITION BY b.split_seed, b.outer_fold, b.label_id, b.bin ORDER BY sha256(concat_ws(chr(31), b.split_seed, 'validation', b.outer_fold, b.label_id, b.bin, b.subject_id)), b.subject_id) AS place FROM binned b),
chosen AS (SELECT p.split_seed, p.outer_fold, p.subject_id FROM placed p JOIN take t ON p.split_seed = t.split_seed AND p.outer_fold = t.outer_fold AND p.label_id = t.label_id AND p.bin = t.bin WHERE place <= k),
roles AS (SELECT c.split_seed, CAST(c.outer_fold AS INT) AS outer_fold, c.subject_id, c.label_id, c.split_post_count, CASE WHEN c.test_fold = c.outer_fold THEN 'test' WHEN h.subject_id IS NOT NULL THEN 'validation' ELSE 'train' END AS role
  FROM cells c LEFT JOIN chosen h ON c.split_seed = h.split_seed AND c.outer_fold = h.outer_fold AND c.subject_id = h.subject_id)"""


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL} SELECT split_seed, outer_fold, subject_id, role FROM roles")
def nested_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(spark, sf_dir).select("split_seed", "outer_fold", "subject_id", "role")


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL} SELECT split_seed, outer_fold, role, count(*) AS subjects, CAST(sum(post_count) AS BIGINT) AS posts, CAST(sum(s.split_post_count) AS BIGINT) AS selected_posts,
  CAST(sum(s.label_id) AS BIGINT) AS positives FROM roles r JOIN s USING (subject_id) GROUP BY 1, 2, 3
"""
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.split_summary(assignments(spark, sf_dir)).drop("labels")


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL} SELECT split_seed, outer_fold, role, label_id, count(*) AS n FROM roles GROUP BY ALL")
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label maps of the split summary, a row per entry."""
    return fo.split_summary(assignments(spark, sf_dir)).select("split_seed", "outer_fold", "role", F.explode("labels").alias("label_id", "n"))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL} SELECT split_seed, outer_fold, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}' AND label_id = {v}) AS {r}_{v}" for r in fo.ROLES for v in (0, 1)) + " FROM roles GROUP BY ALL")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.role_counts(assignments(spark, sf_dir))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL} SELECT split_seed, outer_fold, role, CAST(min(split_post_count) AS BIGINT) AS fewest, CAST(max(split_post_count) AS BIGINT) AS most, CAST(sum(split_post_count) AS BIGINT) AS total FROM roles GROUP BY ALL")
def post_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.post_extent(assignments(spark, sf_dir))


_BROKEN = "br AS (SELECT split_seed, subject_id, outer_fold, CASE WHEN split_seed = 58 AND role = 'test' AND subject_id % 7 = 0 THEN 'train' ELSE role END AS role FROM roles)"


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_BROKEN}, tt AS (SELECT split_seed, subject_id, sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END) AS k FROM br GROUP BY 1, 2) SELECT split_seed, 'not tested once' AS rule, count(*) AS cases FROM tt WHERE k <> 1 GROUP BY 1 UNION ALL SELECT split_seed, 'empty role', count(*) FROM (SELECT split_seed, outer_fold FROM br GROUP BY 1, 2 HAVING count(DISTINCT role) < 3) GROUP BY 1")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that folds break in which every seventh subject of one seed is made a training subject instead of a test subject."""
    moved = (F.col("split_seed") == 58) & (F.col("role") == "test") & (F.col("subject_id") % 7 == 0)
    broken = assignments(spark, sf_dir).withColumn("role", F.when(moved, "train").otherwise(F.col("role")))
    return fo.violations(broken, subjects(spark, sf_dir), FOLDS)


@query(f"WITH {_SUBJECTS} SELECT label_id, count(*) AS subjects, CAST(sum(CASE WHEN post_count >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS included, CAST(sum(CASE WHEN post_count < 100 THEN 1 ELSE 0 END) AS BIGINT) AS excluded FROM s GROUP BY 1")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.plans.evaluate import cohort_summary as summary

    return summary(subjects(spark, sf_dir), 100)


@query(
    """
WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, CAST(least(pos * least(5, n) // n, least(5, n) - 1) AS INT) AS bin FROM r
"""
)
def validation_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = Window.partitionBy("c_mktsegment")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", (F.row_number().over(part.orderBy("c_acctbal", "c_custkey")) - 1).alias("pos"), F.count("*").over(part).alias("n"))
    return rows.select("c_custkey", fo.equal_bins(F.col("pos"), F.col("n"), 5).alias("bin"))


@query(
    """
WITH w AS (SELECT n_regionkey, n_nationkey, count(*) AS size, 1000 AS total FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2),
r AS (SELECT *, total * size / CAST(sum(size) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS raw FROM w)
SELECT n_regionkey, n_nationkey, CAST(floor(raw) + CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY raw - floor(raw) DESC, n_nationkey) <= total - sum(floor(raw)) OVER (PARTITION BY n_regionkey) THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM r
"""
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    sizes = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("size"))
    rows = nation.join(sizes, "n_nationkey").select("n_regionkey", "n_nationkey", "size", F.lit(1000).alias("total"))
    return fo.largest_remainder(rows, ["n_regionkey"], "n_nationkey", "size", "total").select("n_regionkey", "n_nationkey", "allocated")


# ---- metrics and statistics --------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as predictions: quality, and a score with ties from the id."""
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL").select((F.col("doc_id") % 3).alias("run"), F.col("quality").alias("label"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("score"))


_SCORED = "p AS (SELECT doc_id % 3 AS run, quality AS label, (doc_id * 37 % 101) / 100.0 AS score FROM labels WHERE quality IS NOT NULL)"
_CONF = "c AS (SELECT run, count(*) AS n, CAST(sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score < 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM p GROUP BY 1)"
_RATES = "m AS (SELECT *, (tp + tn) / n AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c), r AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"


@query(f"WITH {_SCORED}, {_CONF} SELECT run, n, tp, tn, fp, fn FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met.confusion(_scored(spark, sf_dir).withColumn("p", (F.col("score") >= 0.5).cast("int")), ["run"], "label", "p")


@query(f"WITH {_SCORED}, {_CONF}, {_RATES} SELECT run, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = met.binary_metrics(_scored(spark, sf_dir), ["run"])
    return m.select("run", *(r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(
    f"""
WITH {_SCORED} SELECT a.run, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc FROM p a JOIN p b ON a.run = b.run AND a.label = 1 AND b.label = 0 GROUP BY 1
"""
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met.roc_auc(_scored(spark, sf_dir), ["run"], "label", "score").select("run", r6("roc_auc").alias("roc_auc"))


_T = "CASE " + " ".join(f"WHEN n = {k + 2} THEN {t}" for k, t in enumerate(met.T_975)) + " WHEN n > 31 THEN 1.96 END"


@query(
    f"""
WITH g AS (SELECT n_regionkey, count(s) AS n, avg(s) AS mean, stddev_samp(s) AS sample_sd FROM (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1)
SELECT n_regionkey, n, round(mean, 6) AS mean, round(sample_sd, 6) AS sample_sd, round(mean - {_T} * sample_sd / sqrt(n), 6) AS ci95_low, round(mean + {_T} * sample_sd / sqrt(n), 6) AS ci95_high FROM g
"""
)
def ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("s"))
    out = met.intervals(table(spark, sf_dir, "nation").join(per, "n_nationkey"), ["n_regionkey"], "s")
    return out.select("n_regionkey", "n", *(r6(c).alias(c) for c in ("mean", "sample_sd", "ci95_low", "ci95_high")))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight paired differences per event type: means of values by hour block, shifted."""
    e = table(spark, sf_dir, "events").withColumn("rep", F.col("event_id") % 8)
    return e.groupBy("event_type", "rep").agg(r6(F.avg("value") - F.lit(50.0)).alias("d"))


_DIFFS = "d AS (SELECT event_type, event_id % 8 AS rep, round(avg(value) - 50.0, 6) AS d FROM events GROUP BY 1, 2)"


@query(
    f"""
WITH {_DIFFS}, m AS (SELECT unnest(range(256)) AS bits), s AS (SELECT event_type, bits, abs(avg(CASE WHEN (bits >> rep) & 1 = 1 THEN d ELSE -d END)) AS v, abs(avg(d)) AS o FROM d, m GROUP BY 1, 2)
SELECT event_type, round(avg(CASE WHEN v >= o - 1e-12 THEN 1.0 ELSE 0 END), 6) AS p FROM s GROUP BY 1
"""
)
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sign_flip_p(_differences(spark, sf_dir), ["event_type"], "d").select("event_type", r6("p").alias("p"))


@query(
    """
WITH p AS (SELECT n_regionkey AS fam, n_nationkey AS item, ((n_nationkey * 7919 % 97) + 1) / 500.0 AS p FROM nation),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p) + 1) * p) AS x FROM p)
SELECT fam, item, round(max(x) OVER (PARTITION BY fam ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s
"""
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("fam"), F.col("n_nationkey").alias("item"), ((F.col("n_nationkey") * 7919 % 97 + 1) / 500.0).alias("p"))
    return st.holm(rows, ["fam"], "p").select("fam", "item", r6("p_holm").alias("p_holm"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of several experiments over every seed: scores from hashes, shifted toward the label."""
    a = assignments(spark, sf_dir).where("role = 'test'").withColumn("experiment", F.explode(F.array(F.lit("full"), F.lit("text"), F.lit("meta"))))
    push = F.when(F.col("experiment") == "full", 0.3).when(F.col("experiment") == "text", 0.2).otherwise(0.1)
    noise = (F.col("subject_id") * 31 + F.col("split_seed") * 17 + F.length("experiment") * 7) % 100 / F.lit(100.0)
    score = F.round(noise * (1 - push) + push * F.col("label_id"), 6)
    return a.select("experiment", "split_seed", "outer_fold", "subject_id", "role", F.col("label_id").alias("label"), score.alias("score"))


_PRED = f"""{_OUTER_SQL}, x(experiment, push) AS (VALUES ('full', 0.3), ('text', 0.2), ('meta', 0.1)),
pr AS (SELECT experiment, split_seed, outer_fold, subject_id, label_id AS label, round(((subject_id * 31 + split_seed * 17 + length(experiment) * 7) % 100) / 100.0 * (1 - push) + push * label_id, 6) AS score FROM outer_folds, x)"""
_RUNS = """cf AS (SELECT experiment, split_seed, count(*) AS n, sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score < 0.5 AND label = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn FROM pr GROUP BY 1, 2),
au AS (SELECT a.experiment, a.split_seed, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS roc_auc FROM pr a JOIN pr b ON a.experiment = b.experiment AND a.split_seed = b.split_seed AND a.label = 1 AND b.label = 0 GROUP BY 1, 2),
pq AS (SELECT *, (tp + tn) / n AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM cf),
mr AS (SELECT experiment, split_seed, accuracy, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, roc_auc FROM pq JOIN au USING (experiment, split_seed)),
lm AS (UNPIVOT mr ON accuracy, precision, recall, f1, roc_auc INTO NAME metric VALUE value)"""


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_PRED}, {_RUNS}, g AS (SELECT experiment, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sample_sd FROM lm GROUP BY 1, 2)
SELECT experiment, metric, n, round(mean, 6) AS mean, round(sample_sd, 6) AS sample_sd, round(mean - {_T} * sample_sd / sqrt(n), 6) AS ci95_low, round(mean + {_T} * sample_sd / sqrt(n), 6) AS ci95_high FROM g
"""
)
def repeated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.repeated_summary(_predictions(spark, sf_dir))
    return out.select("experiment", "metric", "n", *(r6(c).alias(c) for c in ("mean", "sample_sd", "ci95_low", "ci95_high")))


def _metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["experiment", "split_seed"]
    return met.melt(met.binary_metrics(_predictions(spark, sf_dir), keys), keys)


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_PRED}, {_RUNS},
df AS (SELECT a.experiment, a.metric, a.split_seed, a.value - b.value AS d, row_number() OVER (PARTITION BY a.experiment, a.metric ORDER BY a.split_seed) - 1 AS i FROM lm a JOIN lm b ON b.experiment = 'full' AND a.experiment <> 'full' AND a.metric = b.metric AND a.split_seed = b.split_seed),
bt AS (SELECT unnest(range({1 << len(SEEDS)})) AS bits),
sf AS (SELECT experiment, metric, bits, abs(avg(CASE WHEN (bits >> i) & 1 = 1 THEN d ELSE -d END)) AS v FROM df, bt GROUP BY 1, 2, 3),
g AS (SELECT experiment, metric, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, sum(CASE WHEN d > 1e-12 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN abs(d) <= 1e-12 THEN 1 ELSE 0 END) AS ties, sum(CASE WHEN d < -1e-12 THEN 1 ELSE 0 END) AS losses FROM df GROUP BY 1, 2),
pv AS (SELECT g.*, (SELECT avg(CASE WHEN v >= abs(g.mean) - 1e-12 THEN 1.0 ELSE 0 END) FROM sf WHERE sf.experiment = g.experiment AND sf.metric = g.metric) AS p FROM g),
hs AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p, experiment) + 1) * p) AS x FROM pv)
SELECT experiment, metric, n, round(mean, 6) AS mean, CAST(wins AS BIGINT) AS wins, CAST(ties AS BIGINT) AS ties, CAST(losses AS BIGINT) AS losses, round(p, 6) AS p,
  round(max(x) OVER (PARTITION BY metric ORDER BY p, experiment ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM hs
"""
)
def paired_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.paired_family(_metric_values(spark, sf_dir), "experiment", "full")
    return out.select("experiment", "metric", "n", r6("mean").alias("mean"), "wins", "ties", "losses", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_PRED}, {_RUNS} PIVOT (SELECT experiment, metric, round(avg(value), 6) AS v FROM lm GROUP BY 1, 2) ON metric IN ('accuracy', 'precision', 'recall', 'f1', 'roc_auc') USING first(v) GROUP BY experiment")
def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.condition_table(st.repeated_summary(_predictions(spark, sf_dir)))
    return out.select("experiment", *(r6(c).alias(c) for c in met.METRICS))


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_OUTER_SQL}, g AS (SELECT split_seed, outer_fold, string_agg(CAST(subject_id AS VARCHAR), ',' ORDER BY CAST(subject_id AS VARCHAR)) AS ids FROM outer_folds GROUP BY 1, 2)
SELECT split_seed, sha256(string_agg(ids, ';' ORDER BY ids)) AS fingerprint FROM g GROUP BY 1
"""
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.partition_fingerprint(fo.outer_folds(subjects(spark, sf_dir), SEEDS, FOLDS), ["split_seed"])


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_PRED} SELECT a.split_seed, a.subject_id, a.outer_fold, a.label, round(0.9 * a.score + 0.1 * b.score, 6) AS score, CAST(0.9 * a.score + 0.1 * b.score >= 0.5 AS INT) AS prediction
FROM pr a JOIN pr b ON a.split_seed = b.split_seed AND a.subject_id = b.subject_id AND a.experiment = 'full' AND b.experiment = 'meta'
"""
)
def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    fused = st.fuse(p.where("experiment = 'full'"), p.where("experiment = 'meta'"), 0.1)
    return fused.select("split_seed", "subject_id", "outer_fold", "label", r6("score").alias("score"), "prediction")


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_PRED} SELECT 'meta' AS experiment, 'repeated partition' AS problem, CAST(1 AS BIGINT) AS cases
UNION ALL SELECT 'text', 'uneven coverage', count(DISTINCT subject_id) FROM pr WHERE subject_id % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'meta', 'fold numbering', CAST(1 AS BIGINT)
UNION ALL SELECT 'full', 'label changed', count(DISTINCT subject_id) FROM pr WHERE subject_id % 9 = 0 HAVING count(*) > 0
UNION ALL SELECT 'full', 'repeated subject', count(DISTINCT subject_id) FROM pr WHERE subject_id % 13 = 0 HAVING count(*) > 0
UNION ALL SELECT 'one', 'single repetition', CAST(1 AS BIGINT)
UNION ALL SELECT 'one', 'undefined metric', CAST(1 AS BIGINT)
"""
)
def repetition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with runs in which partitions, subjects, labels, folds or seeds were tampered with."""
    p = _predictions(spark, sf_dir)
    twice = p.where("experiment = 'meta' AND split_seed != 61").unionByName(p.where("experiment = 'meta' AND split_seed = 60").withColumn("split_seed", F.lit(61)))
    twice = twice.withColumn("outer_fold", F.when((F.col("split_seed") == 59) & (F.col("outer_fold") == 4), 7).otherwise(F.col("outer_fold")))
    short = p.where("experiment = 'text' AND NOT (split_seed = 58 AND subject_id % 5 = 0)")
    turned = (F.col("split_seed") == 60) & (F.col("subject_id") % 9 == 0)
    full = p.where("experiment = 'full'").withColumn("label", F.when(turned, 1 - F.col("label")).otherwise(F.col("label")))
    full = full.withColumn("times", F.explode(F.when((F.col("split_seed") == 58) & (F.col("subject_id") % 13 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("times")
    one = p.where("experiment = 'full' AND split_seed = 61").withColumn("experiment", F.lit("one")).withColumn("label", F.lit(1))
    return st.repetition_problems(full.unionByName(twice).unionByName(short).unionByName(one))


_DIGEST = " || '|' || ".join(f"CAST(sum(CAST('0x' || substr(d, {k}, 15) AS BIGINT)) AS VARCHAR)" for k in (1, 16, 31, 46))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_PRED}, h AS (SELECT experiment, split_seed, sha256(concat_ws('|', subject_id, label, outer_fold)) AS d FROM pr) SELECT experiment, split_seed, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '|' || {_DIGEST}) AS fingerprint FROM h GROUP BY 1, 2")
def oof_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.oof_fingerprint(_predictions(spark, sf_dir), ["experiment", "split_seed"])


@query(f"WITH RECURSIVE {_SUBJECTS}, {_PRED} SELECT split_seed, count(*) AS cases FROM pr WHERE experiment = 'full' AND split_seed = 59 AND subject_id % 5 = 0 GROUP BY 1")
def alignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold rows that differ from the split where every fifth label of one seed is turned round."""
    wrong = (F.col("split_seed") == 59) & (F.col("subject_id") % 5 == 0)
    p = _predictions(spark, sf_dir).where("experiment = 'full'").withColumn("label", F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")))
    return con.misaligned(p, assignments(spark, sf_dir), ["split_seed"]).groupBy("split_seed").agg(F.count("*").alias("cases"))


# ---- constraints -------------------------------------------------------------------------------


@query("SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL")
def unequal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.unequal_sets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT DISTINCT user_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events) WHERE x <> y")
def unequal_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events are in another order by time than by id."""
    e = table(spark, sf_dir, "events")
    sides = [e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("pos")) for order in (["event_id"], ["ts", "event_id"])]
    return con.unequal_sequences(*sides, "user_id", "pos", "event_id")


@query("SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def inconsistent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.inconsistent(table(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment"])


@query(
    """
WITH a AS (SELECT o_orderkey AS k, sum(l_extendedprice) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders)
SELECT b.k FROM b LEFT JOIN a ON a.k = b.k WHERE a.v IS NULL OR abs(a.v - b.v) > 1000
"""
)
def not_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return con.not_close(sums.join(orders, "k", "left_semi"), orders, ["k"], "v", 1000.0).select("k")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%http%'")
def modality_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention a link where a condition says that none may."""
    docs = table(spark, sf_dir, "documents").withColumn("has_link", F.contains(F.lower("text"), F.lit("http")))
    return con.leaks(docs, ["has_link"]).select("doc_id")


@query(
    """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events), f AS (SELECT user_id FROM events GROUP BY 1 ORDER BY 1 LIMIT 7),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM w WHERE rn <= 20 AND event_type <> 'click' AND user_id IN (SELECT user_id FROM f))
SELECT user_id, event_id FROM c WHERE k <= 5
"""
)
def limited_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 20, a condition, then the last 5 events of the first 7 users."""
    e = table(spark, sf_dir, "events")
    kept = win.recent(e, "user_id", "ts", "event_id", 20).where("event_type != 'click'")
    first = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return win.limited(first.join(kept, "user_id", "left"), "user_id", "ts", "event_id", post_limit=5, subject_limit=7).where("event_id IS NOT NULL").select("user_id", "event_id")


@query("SELECT e.event_id, o.o_orderkey AS post_id FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderkey = e.event_id")
def media_to_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left lookup on subject and raw id; null where nothing matches."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("post_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id").join(o, ["user_id", "event_id"], "left").select("event_id", "post_id")


# ---- vectors and sequences ---------------------------------------------------------------------


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("subject_id"), "vec_id", "embedding")
    return win.halves(win.numbered(rows, "subject_id", "vec_id", "vec_id"))


_LONG = """z AS (SELECT vec_id % 50 AS subject_id, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY vec_id % 50) AS n FROM embeddings),
l AS (SELECT subject_id, pos < greatest(1, n // 2) AS early, pos >= greatest(1, n // 2) OR n = 1 AS late, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM z)"""
_PICK = {"all": "", "early": " FILTER (WHERE early)", "late": " FILTER (WHERE late)"}


def _pool_sql(method: str) -> str:
    parts = " UNION ALL ".join(f"SELECT subject_id, {k} AS block, dim, {'avg' if s == 'mean' else 'stddev_pop'}(x){_PICK[o]} AS v FROM l GROUP BY 1, 3" for k, (s, o) in enumerate(pool.METHODS[method]))
    return f"WITH {_LONG}, b AS ({parts}) SELECT subject_id, CAST(block AS INT) AS block, CAST(dim AS INT) AS dim, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY subject_id, block)), 1e-12), 6) AS value FROM b"


def _pool(name: str, method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pool.pooled_long(_sequence(spark, sf_dir), "subject_id", "embedding", method).withColumn("value", r6("value"))

    run.__name__ = name
    query(_pool_sql(method))(run)


for _name, _method in (("mean_pool", "mean"), ("temporal_pyramid", "temporal_pyramid"), ("mean_std_halves", "mean_std_halves"), ("segment_moments", "segment_moments")):
    _pool(_name, _method)


@query("SELECT vec_id, CAST(i AS INT) AS dim, round(CAST(embedding[i + 1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * x))), 1e-12), 6) AS value FROM embeddings, (SELECT unnest(range(16)) AS i)")
def prefix_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pool.l2_normalized(pool.prefix(F.col("embedding"), 16))).alias("dim", "value"))
    return rows.withColumn("value", r6("value"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.document(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), "conv_id", ["turn", "role"], "text")


_GRAMS = r"""t AS (SELECT conv_id, regexp_replace(lower(string_agg(text, chr(10) ORDER BY turn, role)), '[\s\p{Z}]{2,}', ' ', 'g') AS x FROM conversations WHERE text IS NOT NULL GROUP BY 1),
c AS (SELECT conv_id, string_split(x, '') AS a FROM t), u AS (SELECT conv_id, unnest(a) AS gram FROM c UNION ALL SELECT conv_id, unnest(list_transform(range(1, len(a)), lambda i: a[i] || a[i + 1])) FROM c),
k AS (SELECT conv_id, gram, count(*) AS n FROM u WHERE gram <> '' GROUP BY 1, 2),
tr AS (SELECT DISTINCT conv_id FROM conversations WHERE text IS NOT NULL AND conv_id % 4 <> 0), nd AS (SELECT count(*) AS docs FROM tr),
i AS (SELECT gram, ln((1 + any_value(docs)) / (1.0 + count(*))) + 1 AS idf FROM k JOIN tr USING (conv_id), nd GROUP BY 1 HAVING count(*) >= 2)"""


def _train(spark: SparkSession, sf_dir: str, docs: DataFrame, train: bool) -> DataFrame:
    some = docs.where("conv_id % 4 != 0") if train else docs
    return some.select(F.lit(0).alias("fold"), "conv_id")


@query(f"WITH {_GRAMS} SELECT gram, round(idf, 6) AS idf FROM i")
def tfidf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    counts = tfidf.grams(docs, ["conv_id"], "text")
    return tfidf.fit_idf(counts, _train(spark, sf_dir, docs, True), ["fold"], "conv_id").select("gram", r6("idf").alias("idf"))


@query(f"WITH {_GRAMS}, w AS (SELECT conv_id, gram, (1 + ln(n)) * idf AS w FROM k JOIN i USING (gram)) SELECT conv_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id)), 6) AS weight FROM w")
def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    counts = tfidf.grams(docs, ["conv_id"], "text")
    idf = tfidf.fit_idf(counts, _train(spark, sf_dir, docs, True), ["fold"], "conv_id")
    return tfidf.transform(counts, _train(spark, sf_dir, docs, False), idf, ["fold"], "conv_id").select("conv_id", "gram", r6("weight").alias("weight"))


# ---- models ------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, feature, value) of each post of each subject's window."""
    window = win.recent(posts(spark, sf_dir), "subject_id", "published_at", "post_id", 64)
    columns = meta.metadata_columns(F.col("likes"), F.col("comments"), F.col("reposts"), F.col("published_at"))
    return window.select("subject_id", F.inline(F.array(*(F.struct(F.lit(f"f{k}").alias("feature"), c.alias("value")) for k, c in enumerate(columns)))))


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assignments, and standardised metadata means of each subject's window for each fold, fitted on training posts."""
    a = assignments(spark, sf_dir).select("split_seed", "outer_fold", "subject_id", "label_id", "role")
    rows = _cells(spark, sf_dir)
    keys = ["split_seed", "outer_fold"]
    folded = a.join(mod.feature_moments(rows, ["subject_id"]), "subject_id")
    fit = mod.pooled_standardizer(folded.where("role = 'train'"), keys)
    means = folded.select(*keys, "subject_id", "label_id", "role", "feature", "value")
    return a, fit, mod.standardize(means, fit, keys)


_WINDOW = f"{_POSTS}, wp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY published_at DESC NULLS LAST, post_id DESC) AS rn FROM p) WHERE rn <= 64), v AS (SELECT subject_id, {_FEATURES} FROM wp), fl AS (UNPIVOT v ON f0, f1, f2, f3, f4 INTO NAME feature VALUE value)"
_FIT = "ft AS (SELECT split_seed, outer_fold, feature, avg(value) AS mean, CASE WHEN min(value) = max(value) THEN 1.0 ELSE stddev_pop(value) END AS scale FROM roles JOIN fl USING (subject_id) WHERE role = 'train' GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_WINDOW}, {_FIT} SELECT split_seed, outer_fold, feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM ft")
def standardize_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fit, _ = _features(spark, sf_dir)
    return fit.select("split_seed", "outer_fold", "feature", r6("mean").alias("mean"), r6("scale").alias("scale"))


_WEIGHTS = [("f0", 0.8), ("f1", -0.4), ("f2", 0.3), ("f3", 0.2), ("f4", -0.1), (mod.BIAS, 0.05)]
_SCORE = f"""sm AS (SELECT subject_id, feature, avg(value) AS value FROM fl GROUP BY 1, 2), cw(feature, w) AS (VALUES {', '.join(f"('{f}', {w})" for f, w in _WEIGHTS[:-1])}),
sc AS (SELECT r.split_seed, r.outer_fold, r.subject_id, r.role, any_value(r.label_id) AS label, sum((value - mean) / scale * w) + 0.05 AS decision_value FROM roles r JOIN sm USING (subject_id) JOIN ft ON ft.split_seed = r.split_seed AND ft.outer_fold = r.outer_fold AND ft.feature = sm.feature JOIN cw ON cw.feature = sm.feature GROUP BY 1, 2, 3, 4)"""


def _weights(a: DataFrame) -> DataFrame:
    fixed = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(w).alias("coefficient")) for f, w in _WEIGHTS))
    return a.select("split_seed", "outer_fold").distinct().select("split_seed", "outer_fold", F.inline(fixed))


def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, means = _features(spark, sf_dir)
    weights = _weights(a)
    scored = mod.linear_score(means, a, weights)
    return scored.join(a, ["split_seed", "outer_fold", "subject_id"]).withColumnRenamed("label_id", "label").withColumn("experiment", F.lit("linear"))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_WINDOW}, {_FIT}, {_SCORE} SELECT split_seed, outer_fold, subject_id, role, round(decision_value, 6) AS decision_value, round(1 / (1 + exp(-decision_value)), 6) AS score FROM sc")
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear(spark, sf_dir).select("split_seed", "outer_fold", "subject_id", "role", r6("decision_value").alias("decision_value"), r6("score").alias("score"))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_WINDOW}, {_FIT} SELECT split_seed, outer_fold, feature, 'mean' AS \"column\", CAST(1 AS DOUBLE) AS gap FROM ft WHERE split_seed = 58 AND feature = 'f2'")
def scaler_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalers fitted again from all training posts, against stored ones of which one feature's mean was moved in a seed."""
    a, fit, _ = _features(spark, sf_dir)
    keys = ["split_seed", "outer_fold"]
    moved = fit.withColumn("mean", F.col("mean") + F.when((F.col("split_seed") == 58) & (F.col("feature") == "f2"), 1.0).otherwise(0.0))
    training = a.where("role = 'train'").select(*keys, "subject_id").join(_cells(spark, sf_dir), "subject_id")
    return aud.scaler_audit(training, moved, keys).select(*keys, "feature", "column", r6(F.col("stored") - F.col("again")).alias("gap"))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_WINDOW}, {_FIT}, {_SCORE} SELECT split_seed, outer_fold, subject_id, 'decision_value' AS \"column\", CAST(0.5 AS DOUBLE) AS gap FROM sc WHERE subject_id % 11 = 0")
def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions computed again, against stored ones of which every eleventh subject's was moved."""
    a, _, means = _features(spark, sf_dir)
    moved = F.col("decision_value") + F.when(F.col("subject_id") % 11 == 0, 0.5).otherwise(0.0)
    wrong = aud.decision_audit(means, _weights(a), _linear(spark, sf_dir).withColumn("decision_value", moved))
    return wrong.select("split_seed", "outer_fold", "subject_id", "column", r6(F.col("stored") - F.col("again")).alias("gap"))


@query("SELECT 'text' AS experiment, 'f1' AS metric, 'mean' AS \"column\", CAST(0.01 AS DOUBLE) AS gap")
def summary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all repetitions computed again, against a stored one with one cell moved."""
    p = _predictions(spark, sf_dir)
    cell = (F.col("experiment") == "text") & (F.col("metric") == "f1")
    stored = st.repeated_summary(p).withColumn("mean", F.col("mean") + F.when(cell, 0.01).otherwise(0.0))
    return aud.summary_audit(p, stored).select("experiment", "metric", "column", r6(F.col("stored") - F.col("again")).alias("gap"))


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_WINDOW}, {_FIT}, {_SCORE}, pr AS (SELECT 'linear' AS experiment, split_seed, subject_id, label, round(1 / (1 + exp(-decision_value)), 9) AS score FROM sc WHERE role = 'test'), {_RUNS}
SELECT split_seed, metric, round(value, 6) AS value FROM lm
"""
)
def cohort_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: window, features, folds, train-only scaling, scoring and out-of-fold metrics in one plan."""
    rows = st.oof(_linear(spark, sf_dir), ["split_seed"]).withColumn("score", F.round("score", 9))
    return met.melt(met.binary_metrics(rows, ["split_seed"]), ["split_seed"]).withColumn("value", r6("value"))


def _fit_predict(spark: SparkSession, sf_dir: str, solver: str) -> DataFrame:
    a, _, means = _features(spark, sf_dir)
    train = means.where("role = 'train'").withColumnRenamed("label_id", "label")
    coefficients = newton.fit_distributed(train, solver, 1.0)
    scored = mod.linear_score(means, a, coefficients)
    return scored.select("split_seed", "outer_fold", "subject_id", r6("decision_value").alias("decision_value"), r6("score").alias("score"))


@query()
def svm_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_predict(spark, sf_dir, "svm")


@query()
def lr_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_predict(spark, sf_dir, "logistic")


@query()
def tfidf_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character TF-IDF and a squared-hinge SVM per fold on the conversations, labelled by the parity of their id."""
    docs = _texts(spark, sf_dir)
    counts = tfidf.grams(docs, ["conv_id"], "text")
    base = docs.select(F.lit(58).alias("split_seed"), F.explode(F.array(*map(F.lit, range(2)))).alias("outer_fold"), "conv_id")
    train = base.where("floor(conv_id / 2) % 2 != outer_fold")
    keys = ["split_seed", "outer_fold"]
    idf = tfidf.fit_idf(counts, train, keys, "conv_id")
    weights = tfidf.transform(counts, base, idf, keys, "conv_id").select(*keys, F.col("conv_id").alias("subject_id"), F.col("gram").alias("feature"), F.col("weight").alias("value"))
    own = weights.join(train.select(*keys, F.col("conv_id").alias("subject_id")), [*keys, "subject_id"], "left_semi").withColumn("label", (F.col("subject_id") % 2).cast("int"))
    scored = mod.linear_score(weights, base.select(*keys, F.col("conv_id").alias("subject_id")), newton.fit_distributed(own, "svm"))
    return scored.select(*keys, "subject_id", r6("decision_value").alias("decision_value"), r6("score").alias("score"))


@query("SELECT conv_id, turn, CAST(8 AS INT) AS width, round(CAST(length(coalesce(text, '')) AS DOUBLE), 6) AS first FROM conversations")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = neural.embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", neural.stub_encoder(8))
    return made.select("conv_id", "turn", F.size("embedding").alias("width"), r6(F.get("embedding", F.lit(0)).cast("double")).alias("first"))


@query(f"WITH RECURSIVE {_SUBJECTS}, {_OUTER_SQL} SELECT split_seed, o.only_in, count(*) AS cases FROM outer_folds, (VALUES ('left'), ('right')) o(only_in) WHERE subject_id % 5 = 0 GROUP BY 1, 2")
def rerun_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluations of the folds, of one and of many partitions, differ only where the second is changed: at every fifth subject."""
    a = fo.outer_folds(subjects(spark, sf_dir), SEEDS, FOLDS)
    b = fo.outer_folds(subjects(spark, sf_dir).repartition(16, "subject_id"), SEEDS, FOLDS)
    moved = F.when(F.col("subject_id") % 5 == 0, F.col("outer_fold") + 100).otherwise(F.col("outer_fold")).cast(b.schema["outer_fold"].dataType)
    return con.rerun_differences(a, b.withColumn("outer_fold", moved)).groupBy("split_seed", "only_in").agg(F.count("*").alias("cases"))


@query(
    f"""
WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_WINDOW}, {_FIT}
SELECT r.split_seed, r.outer_fold, r.subject_id, fl.feature, round(avg((value - mean) / scale), 6) AS value
FROM roles r JOIN fl USING (subject_id) JOIN ft ON ft.split_seed = r.split_seed AND ft.outer_fold = r.outer_fold AND ft.feature = fl.feature GROUP BY 1, 2, 3, 4
"""
)
def metadata_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train-only standardizer, its application to posts and their means per subject, by the operators of `models`."""
    keys = ["split_seed", "outer_fold"]
    window = win.recent(posts(spark, sf_dir), "subject_id", "published_at", "post_id", 64)
    cells = F.array(*(F.struct(F.lit(f"f{k}").alias("feature"), c.alias("value")) for k, c in enumerate(meta.metadata_columns(F.col("likes"), F.col("comments"), F.col("reposts"), F.col("published_at")))))
    a = assignments(spark, sf_dir).select(*keys, "subject_id", "role")
    folded = a.join(window.select("subject_id", F.inline(cells)), "subject_id")
    fitted = mod.standardizer(folded.where("role = 'train'"), keys)
    means = mod.subject_means(mod.standardize(folded, fitted, keys), a, keys, [f"f{k}" for k in range(5)])
    return means.select(*keys, "subject_id", "feature", r6("value").alias("value"))



_SIDES = "s1 AS (SELECT split_seed, subject_id, outer_fold FROM roles WHERE role = 'test')"


@query(
    f"""WITH RECURSIVE {_SUBJECTS}, {_NESTED_SQL}, {_SIDES}
SELECT split_seed, 'second' AS side, 'missing' AS problem, count(*) AS cases FROM s1 WHERE subject_id < 7 GROUP BY 1
UNION ALL SELECT split_seed, 'third', 'other values', count(*) FROM s1 WHERE subject_id BETWEEN 10 AND 14 GROUP BY 1
UNION ALL SELECT split_seed, 'third', 'repeated', count(*) FROM s1 WHERE subject_id BETWEEN 20 AND 22 GROUP BY 1"""
)
def aligned_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of all subjects against two copies with faults: some rows gone, some in another fold, some twice."""
    rows = assignments(spark, sf_dir).where("role = 'test'").select("split_seed", "subject_id", "outer_fold")
    third = rows.withColumn("outer_fold", F.when(F.col("subject_id").between(10, 14), F.col("outer_fold") + 1).otherwise(F.col("outer_fold"))).unionByName(rows.where("subject_id BETWEEN 20 AND 22"))
    found = aud.misaligned_sides({"first": rows, "second": rows.where("subject_id >= 7"), "third": third}, ["split_seed", "subject_id"], ["outer_fold"])
    return found.groupBy("split_seed", "side", "problem").agg(F.count("*").alias("cases"))



@query("WITH p AS (SELECT l_returnflag AS run, l_extendedprice AS score, CAST(l_discount >= 0.05 AS INT) AS label FROM lineitem), g AS (SELECT run, score, sum(label) AS p, count(*) - sum(label) AS q FROM p GROUP BY ALL), w AS (SELECT *, p * (sum(q) OVER (PARTITION BY run ORDER BY score) - q / 2) AS w FROM g) SELECT run, round(sum(w) / (sum(p) * sum(q)), 6) AS roc_auc FROM w GROUP BY run")
def roc_auc_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a line's price tell its discount? A run is a return flag with up to half of all lines, so it is cut into ranges."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") >= 0.05).cast("int").alias("label"))
    return met.roc_auc(rows, ["run"], "label", "score", parts=64).select("run", r6("roc_auc").alias("roc_auc"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def without_pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return con.set_difference(table(spark, sf_dir, "customer"), orders, ["c_custkey"])


@query("SELECT coalesce(a, b) AS k, CASE WHEN b IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderstatus = 'P') ON a = b WHERE a IS NULL OR b IS NULL")
def unequal_status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of only one of two statuses."""
    orders = table(spark, sf_dir, "orders")
    return con.unequal_sets(*(orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP"), ["k"])


@query("SELECT DISTINCT user_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS FIRST, event_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events) WHERE x <> y")
def sequences_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events are in another order by time than by value."""
    e = table(spark, sf_dir, "events")
    sides = [e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("pos")) for order in (["value", "event_id"], ["ts", "event_id"])]
    return con.unequal_sequences(*sides, "user_id", "pos", "event_id")


@query("SELECT doc_id FROM documents WHERE contains(text, '@')")
def address_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an address sign where a condition says that none may."""
    docs = table(spark, sf_dir, "documents").withColumn("has_address", F.contains("text", F.lit("@")))
    return con.leaks(docs, ["has_address"]).select("doc_id")


from weftline.plans import model_queries, raw_queries, store_queries  # noqa: E402,F401  they register their queries on top of what is defined above
