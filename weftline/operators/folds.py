"""Deterministic stratified nested folds over subjects, for any number of seeds at once."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.identity import stable_digest

ROLES = ("train", "validation", "test")


def tie_order(seed: int, label: int, folds: int) -> list[int]:
    """The rank of each fold in a tie, shuffled for seed and label by Python's generator."""
    order = list(range(folds))
    random.Random(seed + label).shuffle(order)
    return [order.index(f) for f in range(folds)]


#: Hex digits of the digest by which subjects of one label and post count are dealt to groups.
PREFIX = 2


def _orders(folds: int):
    """One label of one seed, a row per post count: the folds of a round's places, in the round where the count begins and in later ones.

    Each round of `folds` subjects fills the folds, emptiest first. A round of equal counts adds the same to every fold,
    so the order stays until the count changes: subjects needn't be met one by one.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if rows["split_post_count"].isna().any():
            raise ValueError("a subject has no post count")
        seed, label = int(key[0]), int(key[1])
        rows = rows.sort_values("split_post_count", ascending=False)
        rank, total, at, out = tie_order(seed, label, folds), [0] * folds, 0, []
        order: list[int] = []
        for count, n in zip(rows["split_post_count"].tolist(), rows["n"].tolist(), strict=True):
            start, left, used = at, n, []
            while left and len(used) < 2:
                place = at % folds
                if place == 0:
                    order = sorted(range(folds), key=lambda f: (total[f], rank[f]))
                used.append(order)
                take = min(left, folds - place) if len(used) == 1 else left
                for k in range(folds):
                    total[order[k]] += count * len(range(at + (k - at) % folds, at + take, folds))
                at, left = at + take, left - take
            out.append((start, used[0], used[-1]))
        return pd.DataFrame({"split_seed": seed, "label_id": rows["label_id"], "split_post_count": rows["split_post_count"], **dict(zip(("start", "first", "later"), zip(*out, strict=True), strict=True))})

    return run


def outer_folds(subjects: DataFrame, seeds: Sequence[int], folds: int) -> DataFrame:
    """(split_seed, subject_id, outer_fold) from (subject_id, label_id, split_post_count).

    Within a label subjects go, from the most posts on, to the fold with fewest subjects, then fewest posts, then the
    tie order. A task meets the numbers of subjects by post count, which are no more than the root of twice all posts,
    and a subject's place comes from counts of digests that begin alike: no label of a seed is gathered.
    """
    if folds < 2:
        raise ValueError("at least two folds")
    few = subjects.groupBy("label_id").count().where(F.col("count") < folds).limit(1).collect()
    if few:
        raise ValueError(f"label {few[0][0]} has fewer subjects than folds")
    kinds = {c: subjects.schema[c].dataType.simpleString() for c in ("label_id", "split_post_count")}
    each = subjects.select("subject_id", "label_id", "split_post_count", F.explode(F.array(*map(F.lit, seeds))).alias("split_seed"))
    hashed = each.withColumn("digest", stable_digest(F.col("split_seed"), F.lit("outer"), F.col("label_id"), F.col("subject_id"))).withColumn("head", F.substring("digest", 1, PREFIX))
    alike = ["split_seed", "label_id", "split_post_count"]
    sizes = hashed.groupBy(*alike, "head").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*alike).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    schema = f"split_seed int, label_id {kinds['label_id']}, split_post_count {kinds['split_post_count']}, start long, first array<int>, later array<int>"
    orders = sizes.groupBy(*alike).agg(F.sum("n").alias("n")).groupBy("split_seed", "label_id").applyInPandas(_orders(folds), schema)
    known = sizes.select(*alike, "head", ahead.alias("ahead")).join(orders, alike)
    place = F.row_number().over(Window.partitionBy(*alike, "head").orderBy("digest", "subject_id")) - 1
    rows = hashed.withColumn("place", place).join(known, [*alike, "head"]).withColumn("at", F.col("start") + F.col("ahead") + F.col("place"))
    begun = F.floor(F.col("at") / folds) == F.floor(F.col("start") / folds)
    fold = F.get(F.when(begun, F.col("first")).otherwise(F.col("later")), (F.col("at") % folds).cast("int"))
    return rows.select("split_seed", "subject_id", fold.alias("outer_fold"))


def equal_bins(position: Column, n: Column, bins: int) -> Column:
    """Bin of a 0-based position among n: floor(position * b / n) with b = min(bins, n); not ntile."""
    b = F.least(F.lit(bins), n)
    return F.least(F.floor(position * b / n), b - 1).cast("int")


def largest_remainder(df: DataFrame, group: Sequence[str], item: str, weight: str, total: str, out: str = "allocated") -> DataFrame:
    """Whole shares of `total` in proportion to weights; what flooring leaves goes to the largest fractions, ties to the lower item."""
    part = Window.partitionBy(*group)
    raw = F.col(total) * F.col(weight) / F.sum(weight).over(part)
    df = df.withColumn("__raw", raw).withColumn("__low", F.floor("__raw"))
    df = df.withColumn("__left", F.col(total) - F.sum("__low").over(part))
    place = F.row_number().over(part.orderBy((F.col("__raw") - F.col("__low")).desc(), F.col(item)))
    return df.withColumn(out, (F.col("__low") + (place <= F.col("__left")).cast("long")).cast("long")).drop("__raw", "__low", "__left")


def nested_assignments(subjects: DataFrame, outer: DataFrame, folds: int, fraction: float) -> DataFrame:
    """A row per seed, fold and subject with its role: the fold's own subjects test, a stratified part of the others validates."""
    if not 0 < fraction < 1:
        raise ValueError("the validation fraction is between 0 and 1")
    own = outer.withColumnRenamed("outer_fold", "test_fold").join(subjects, "subject_id")
    # a fixed number of folds: an explode, no join
    rows = own.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = rows.where("test_fold != outer_fold")
    group = ["split_seed", "outer_fold", "label_id"]
    part = Window.partitionBy(*group)
    ranked = rest.withColumn("n", F.count("*").over(part)).withColumn("pos", F.row_number().over(part.orderBy("split_post_count", "subject_id")) - 1)
    ranked = ranked.withColumn("bin", equal_bins(F.col("pos"), F.col("n"), 5))
    target = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * F.lit(fraction), 0), F.col("n") - 1)).cast("long")
    bins = ranked.groupBy(*group, "bin").agg(F.count("*").alias("size"), F.first(target).alias("target"))
    shares = largest_remainder(bins, group, "bin", "size", "target", "take").select(*group, "bin", "take")
    digest = stable_digest(F.col("split_seed"), F.lit("validation"), F.col("outer_fold"), F.col("label_id"), F.col("bin"), F.col("subject_id"))
    order = F.row_number().over(Window.partitionBy(*group, "bin").orderBy(digest, "subject_id"))
    chosen = ranked.withColumn("place", order).join(shares, [*group, "bin"]).where("place <= take").select("split_seed", "outer_fold", "subject_id", F.lit(True).alias("picked"))
    role = F.when(F.col("test_fold") == F.col("outer_fold"), "test").when(F.col("picked"), "validation").otherwise("train")
    return rows.join(chosen, ["split_seed", "outer_fold", "subject_id"], "left").withColumn("role", role).drop("picked", "test_fold")


def cohort(subjects: DataFrame, minimum_posts: int) -> DataFrame:
    """Subjects with that many posts in their whole history, before any window or removal."""
    return subjects.where(F.col("post_count") >= minimum_posts)


def split_summary(assignments: DataFrame) -> DataFrame:
    """Per fold and role: subjects, posts, posts in the window, positives, and a map of labels to subjects."""
    group = ["split_seed", "outer_fold", "role"]
    each = assignments.groupBy(*group, "label_id").agg(F.count("*").alias("n"), F.sum("post_count").alias("posts"), F.sum("split_post_count").alias("selected_posts"))
    return each.groupBy(*group).agg(
        F.sum("n").alias("subjects"),
        F.sum("posts").alias("posts"),
        F.sum("selected_posts").alias("selected_posts"),
        F.sum(F.when(F.col("label_id") == 1, F.col("n")).otherwise(0)).alias("positives"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label_id", "n")))).alias("labels"),
    )


def role_counts(assignments: DataFrame) -> DataFrame:
    """Per fold, a column for the subjects of each role and label, such as `train_1`."""
    return assignments.groupBy("split_seed", "outer_fold").agg(
        *(F.sum(((F.col("role") == r) & (F.col("label_id") == v)).cast("long")).alias(f"{r}_{v}") for r in ROLES for v in (0, 1))
    )


def post_extent(assignments: DataFrame) -> DataFrame:
    """Per fold and role: fewest, most and all posts of a subject's window."""
    c = "split_post_count"
    return assignments.groupBy("split_seed", "outer_fold", "role").agg(F.min(c).alias("fewest"), F.max(c).alias("most"), F.sum(c).alias("total"))


def violations(assignments: DataFrame, subjects: DataFrame, folds: int) -> DataFrame:
    """(split_seed, rule, cases): every way in which assignments aren't nested folds; no rows if they are.

    The assignments are read twice, once by subject and once by fold.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    is_ = lambda r: F.col("role") == r
    cells = assignments.groupBy("split_seed", "subject_id", "outer_fold").agg(F.count("*").alias("rows"), n(~F.col("role").isin(*ROLES)).alias("unknown"), n(is_("test")).alias("tested"))
    outside = (F.col("outer_fold") < 0) | (F.col("outer_fold") >= folds)
    each = cells.groupBy("split_seed", "subject_id").agg(
        F.sum("unknown").alias("unknown"), n(F.col("rows") > 1).alias("repeated"), F.sum(F.when(outside, F.col("rows")).otherwise(0)).alias("outside"), F.sum("tested").alias("tested")
    )
    known = subjects.select("subject_id").distinct()
    each = each.join(known.withColumn("known", F.lit(True)), "subject_id", "left")
    by_subject = each.groupBy("split_seed").agg(
        F.sum("unknown").alias("unknown role"), F.sum("repeated").alias("repeated subject"), F.sum("outside").alias("fold out of range"), n(F.col("tested") != 1).alias("not tested once"), n(F.col("known")).alias("covered")
    )
    per_fold = assignments.groupBy("split_seed", "outer_fold").agg(*(n(is_(r)).alias(r) for r in ROLES))
    by_fold = per_fold.groupBy("split_seed").agg(n(F.least(*ROLES) == 0).alias("empty role"), (F.count("*") != folds).cast("long").alias("missing fold"))
    all_ = by_subject.join(by_fold, "split_seed").join(known.agg(F.count("*").alias("all")))  # the last is a single row
    all_ = all_.withColumn("uncovered subject", F.col("all") - F.col("covered"))
    rules = ("unknown role", "repeated subject", "fold out of range", "empty role", "not tested once", "missing fold", "uncovered subject")
    return all_.select("split_seed", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("cases")) for r in rules)))).where("cases > 0")
