"""Ordered records of a subject: dedup, windows, keyword conditions, sampling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import contains_keywords, mask_keywords


def chronological(time: str, key: str, *, latest_first: bool = False) -> list[Column]:
    """Order of a subject's records: those without a time first, then by time and key."""
    if latest_first:
        return [F.col(time).desc_nulls_last(), F.col(key).desc()]
    return [F.col(time).asc_nulls_first(), F.col(key).asc()]


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """For each key the row with the greatest ordinal, as later source rows replace earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__row"))
    return last.select(*keys, *(F.col("__row")[c].alias(c) for c in rest)).select(*df.columns)


def duplicate_counts(df: DataFrame, group: Sequence[str], keys: Sequence[str], values: Sequence[str], ordinal: str) -> DataFrame:
    """Per group: rows dropped by keep_last, rows that conflict with the one before, keys that conflict at all."""
    order = Window.partitionBy(*group, *keys).orderBy(ordinal)
    row = F.xxhash64(*values)
    before = df.select(*group, *keys, row.alias("h"), F.lag(row).over(order).alias("prev"))
    differs = (F.col("h") != F.col("prev")).cast("long")
    per_key = before.groupBy(*group, *keys).agg((F.count("*") - 1).alias("dropped"), F.coalesce(F.sum(differs), F.lit(0)).alias("conflicts"))
    return per_key.groupBy(*group).agg(
        F.sum("dropped").alias("duplicate_rows_dropped"),
        F.sum("conflicts").alias("conflicting_rows"),
        F.sum((F.col("conflicts") > 0).cast("long")).alias("conflicting_keys"),
    )


def recent(df: DataFrame, subject: str, time: str, key: str, n: int) -> DataFrame:
    """The last n records of each subject; Spark keeps n rows a task and subject before shuffling."""
    w = Window.partitionBy(subject).orderBy(*chronological(time, key, latest_first=True))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def limited(df: DataFrame, subject: str, time: str, key: str, *, post_limit: int | None = None, subject_limit: int | None = None, subject_order: str | None = None) -> DataFrame:
    """After window and condition: the first subjects, by id or by `subject_order`, and the last records of each.

    A subject's place is its least `subject_order`; ties go by id.  Limits of 0 or less are errors.
    """
    for limit in (post_limit, subject_limit):
        if limit is not None and limit <= 0:
            raise ValueError("a limit is positive")
    out = df
    if subject_limit is not None:
        place = df.groupBy(subject).agg(F.min(subject_order or subject).alias("__place"))
        first = place.orderBy("__place", subject).limit(subject_limit).select(subject)
        out = out.join(F.broadcast(first) if subject_limit <= 100_000 else first, subject, "left_semi")
    return out if post_limit is None else recent(out, subject, time, key, post_limit)


def apply_condition(df: DataFrame, text: str, condition: str, keywords: Iterable[str], replacement: str = "[MASK]") -> DataFrame:
    """`original`, `masked` or `removed`: applied to a window's records, which are never refilled."""
    if condition == "original":
        return df
    if condition == "masked":
        return df.withColumn(text, mask_keywords(F.col(text), keywords, replacement))
    if condition == "removed":
        return df.where(~contains_keywords(F.col(text), keywords))
    raise ValueError(f"unknown keyword condition {condition!r}")


def numbered(df: DataFrame, subject: str, time: str, key: str) -> DataFrame:
    """With `pos`, from 0 in a subject's order, and `n`, its number of records."""
    part = Window.partitionBy(subject)
    return df.withColumn("pos", F.row_number().over(part.orderBy(*chronological(time, key))) - 1).withColumn("n", F.count("*").over(part))


def halves(numbered_rows: DataFrame) -> DataFrame:
    """With `early` and `late`: the first max(1, n // 2) records and the others; a lone record is both."""
    middle = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    return numbered_rows.withColumn("early", F.col("pos") < middle).withColumn("late", (F.col("pos") >= middle) | (F.col("n") == 1))


def evenly_sampled(numbered_rows: DataFrame, k: int) -> DataFrame:
    """At most k records of each subject at even distances, both ends among them; halves round to even."""
    if k <= 0:
        return numbered_rows.where(F.lit(False))
    if k == 1:
        return numbered_rows.where(F.col("pos") == 0)
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    places = F.transform(steps, lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(k - 1)), 0).cast("long"))
    return numbered_rows.where((F.col("n") <= k) | F.array_contains(places, F.col("pos").cast("long")))


def selection_audit(df: DataFrame, subject: str, time: str, key: str, text: str, n: int, keywords: Iterable[str]) -> DataFrame:
    """Records of each subject in the whole history and in its window, before and after removal."""
    w = Window.partitionBy(subject).orderBy(*chronological(time, key, latest_first=True))
    rows = df.select(subject, (F.row_number().over(w) <= n).alias("__in"), contains_keywords(F.col(text), keywords).alias("__hit"))
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(subject).agg(
        F.count("*").alias("history"),
        count(~F.col("__hit")).alias("history_after_removal"),
        count(F.col("__in")).alias("window"),
        count(F.col("__in") & ~F.col("__hit")).alias("window_after_removal"),
        count(F.col("__in") & F.col("__hit")).alias("removed_in_window"),
    )
