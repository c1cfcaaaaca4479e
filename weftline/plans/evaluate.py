"""Repeated evaluations: every seed and fold of every model as keys of one plan, and their report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import audits
from weftline.operators import folds as fo
from weftline.operators import metrics as met
from weftline.operators import models as mod
from weftline.operators import newton
from weftline.operators import pooling, stats, tfidf, windowing
from weftline.plans.config import Benchmark, LinearExperiment

KEYS = ("split_seed", "outer_fold")


def make_splits(subjects: DataFrame, seeds: Sequence[int], folds: int, fraction: float, minimum_posts: int = 1) -> DataFrame:
    """Nested assignments of the cohort for all seeds; an assignment that breaks a rule is an error."""
    cohort = fo.cohort(subjects, minimum_posts)
    out = fo.nested_assignments(cohort, fo.outer_folds(cohort, seeds, folds), folds, fraction)
    bad = fo.violations(out, cohort, folds).limit(1).collect()
    if bad:
        raise ValueError(f"the split breaks a rule: {bad[0]['rule']}")
    return out


def cohort_summary(subjects: DataFrame, minimum_posts: int) -> DataFrame:
    """Per label: subjects before the cohort rule, in the cohort and excluded."""
    fit = (F.col("post_count") >= minimum_posts).cast("long")
    return subjects.groupBy("label_id").agg(F.count("*").alias("subjects"), F.sum(fit).alias("included"), F.sum(1 - fit).alias("excluded"))


def _fit_and_score(features: DataFrame, assignments: DataFrame, config: LinearExperiment, name: str) -> DataFrame:
    """Predictions from (keys, subject_id, feature, value) for every role."""
    who = assignments.select(*KEYS, "subject_id", F.col("label_id").alias("label"), "role")
    train = features.join(who.where("role = 'train'"), [*KEYS, "subject_id"])
    fit = newton.fit_distributed if config.distributed else mod.fit_linear
    scored = mod.linear_score(features, who, fit(train, config.solver, config.c, KEYS), KEYS)
    return scored.join(who, [*KEYS, "subject_id"]).withColumn("experiment", F.lit(name)).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def text_experiment(posts: DataFrame, assignments: DataFrame, config: LinearExperiment, keywords: Sequence[str], maximum_posts: int = 64, name: str = "text") -> DataFrame:
    """Character TF-IDF of each subject's windowed posts, its vocabulary and weights fitted on training subjects."""
    window = windowing.recent(posts, "subject_id", "published_at", "post_id", maximum_posts)
    rows = windowing.apply_condition(window, "cleaned_text", config.condition, keywords)
    counts = tfidf.grams(tfidf.document(rows, "subject_id", ["published_at", "post_id"], "cleaned_text"), ["subject_id"], "text", config.largest_gram)
    train = assignments.where("role = 'train'").select(*KEYS, "subject_id")
    idf = tfidf.fit_idf(counts, train, KEYS, "subject_id", config.minimum_df)
    weights = tfidf.transform(counts, assignments.select(*KEYS, "subject_id"), idf, KEYS, "subject_id")
    return _fit_and_score(weights.select(*KEYS, "subject_id", F.col("gram").alias("feature"), F.col("weight").alias("value")), assignments, config, name)


def sequence_experiment(features: DataFrame, assignments: DataFrame, config: LinearExperiment, name: str = "sequence") -> DataFrame:
    """Pooled vectors of each subject's posts (subject_id, published_at, post_id, embedding), scaled to unit length as a whole."""
    rows = features.withColumn("embedding", pooling.prefix(F.col("embedding"), config.dims)) if config.dims else features
    ordered = windowing.halves(windowing.numbered(rows, "subject_id", "published_at", "post_id"))
    long = pooling.pooled_long(ordered, "subject_id", "embedding", config.pooling or "mean")
    norms = long.groupBy("subject_id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    unit = long.join(norms, "subject_id").select("subject_id", F.concat_ws(":", "block", "dim").alias("feature"), (F.col("value") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("value"))
    return _fit_and_score(assignments.select(*KEYS, "subject_id").join(unit, "subject_id"), assignments, config, name)


def metadata_experiment(posts: DataFrame, assignments: DataFrame, config: LinearExperiment, name: str = "metadata") -> DataFrame:
    """Means of the five metadata features, scaled by the training posts of each fold; zeros for a subject without posts."""
    names = [f"m{k}" for k in range(5)]
    cells = posts.select("subject_id", F.posexplode("metadata_vector").alias("k", "value")).select("subject_id", F.concat(F.lit("m"), F.col("k")).alias("feature"), "value")
    folded = assignments.select(*KEYS, "subject_id", "role").join(cells, "subject_id")
    fitted = mod.standardizer(folded.where("role = 'train'"), KEYS)
    means = mod.subject_means(mod.standardize(folded, fitted, KEYS), assignments.select(*KEYS, "subject_id"), KEYS, names)
    return _fit_and_score(means, assignments, config, name)


def ablation_report(predictions: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """(condition by metric table, paired comparisons with the reference) over repeated out-of-fold predictions."""
    keys = ["experiment", "split_seed"]
    values = met.melt(met.binary_metrics(stats.oof(predictions, keys), keys), keys)
    return stats.condition_table(met.intervals(values, ["experiment", "metric"], "value")), stats.paired_family(values, "experiment", reference)


def benchmark(predictions: DataFrame, assignments: DataFrame, config: Benchmark) -> tuple[DataFrame, DataFrame]:
    """The report of a controlled benchmark, after checking that every model's rows are the split's."""
    from weftline.operators.constraints import misaligned

    names = predictions.select("experiment").distinct()
    want = assignments.join(F.broadcast(names))  # a handful of models
    bad = misaligned(predictions, want, ["experiment", "split_seed"]).limit(1).collect()
    if bad:
        raise ValueError(f"out-of-fold rows of {bad[0]['experiment']} aren't the split's")
    return ablation_report(predictions, config.reference)


def markdown(table: DataFrame, comparisons: DataFrame, most: int = 1000) -> str:
    """The report's two tables as text; they have a row per condition and metric, and more than `most` are an error."""
    out = []
    for title, df in (("Conditions", table), ("Comparisons", comparisons)):
        rows = df.orderBy(*df.columns[:2]).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title.lower()} of more than {most} rows aren't a report")
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def audit_benchmark(subjects: DataFrame, assignments: DataFrame, predictions: DataFrame, stored: tuple[DataFrame, DataFrame], config: Benchmark, *, fraction: float, tolerance: float = 1e-9) -> DataFrame:
    """(part, item, problem, cases): everything of a controlled benchmark that a second computation doesn't find again.

    Folds are dealt anew from the subjects; every experiment's out-of-fold rows must be the test rows of these folds;
    predictions follow from scores and thresholds; the table of means and the paired comparisons follow from the rows.
    """
    dealt = make_splits(subjects, config.seeds, config.folds, fraction, config.strictly_more_posts_than + 1)
    keys = ["split_seed", "outer_fold", "subject_id"]
    count = lambda df, part, item: df.groupBy(item.alias("item"), F.col("problem")).agg(F.count("*").alias("cases")).select(F.lit(part).alias("part"), "item", "problem", "cases")
    split = audits.misaligned_sides({"dealt": dealt, "stored": assignments}, keys, ["role", "label_id"])
    out = count(split, "splits", F.concat_ws(" ", F.lit("seed"), F.col("split_seed").cast("string")))
    names = predictions.select("experiment").distinct()
    want = dealt.where("role = 'test'").select(*keys, F.col("label_id").alias("label")).join(F.broadcast(names))  # a handful of models
    rows = audits.misaligned_sides({"folds": want, "rows": predictions.where("role = 'test'")}, ["experiment", *keys], ["label"])
    out = out.unionByName(count(rows, "rows", F.col("experiment")))
    wrong = predictions.where(~F.coalesce((F.col("score") >= F.col("threshold")).cast("int") == F.col("prediction"), F.lit(False))).withColumn("problem", F.lit("not the score's"))
    out = out.unionByName(count(wrong, "predictions", F.col("experiment")))
    for part, kept, again, on in zip(("means", "comparisons"), stored, ablation_report(predictions, config.reference), (["experiment"], None), strict=True):
        on = on or [c for c in again.columns if again.schema[c].dataType.typeName() == "string"]
        numbers = [c for c in again.columns if c not in on]
        moved = audits.differences(kept, again, on, numbers, tolerance)
        out = out.unionByName(count(moved.withColumn("problem", F.concat(F.lit("other "), F.col("column"))), part, F.concat_ws(" ", *on)))
    return out
