"""Repeated-evaluation statistics: exact paired tests, adjustment, fingerprints, fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.metrics import METRICS, binary_metrics, intervals, melt, moments, with_interval

_TIE = 1e-12


def sign_flip_p(differences: DataFrame, group: Sequence[str], value: str, limit: int = 20) -> DataFrame:
    """(group, p): the exact two-sided share of sign assignments with a mean as extreme as observed.

    Each group's values are an array of at most `limit`, checked, whose 2**n sums are enumerated by doubling in an expression.
    """
    rows = differences.groupBy(*group).agg(F.collect_list(F.col(value).cast("double")).alias("d"))
    return _flipped(rows, limit).select(*group, "p")


def _flipped(rows: DataFrame, limit: int = 20) -> DataFrame:
    """`rows` with `p` of their arrays `d`."""
    rows = rows.withColumn("d", F.when(F.size("d") <= limit, F.col("d")).otherwise(F.raise_error(F.lit(f"more than {limit} paired values"))))
    none = F.array(F.lit(0.0))
    sums = F.aggregate("d", none, lambda acc, x: F.concat(F.transform(acc, lambda s: s + x), F.transform(acc, lambda s: s - x)))
    n = F.size("d").cast("double")
    seen = F.abs(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / n)
    extreme = F.aggregate(sums, F.lit(0).cast("long"), lambda k, s: k + (F.abs(s / n) >= seen - F.lit(1e-15)).cast("long"))
    return rows.withColumn("p", extreme / F.pow(F.lit(2.0), n))


def holm(df: DataFrame, family: Sequence[str], p: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family."""
    order = Window.partitionBy(*family).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("__step", step).withColumn(out, F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__step")


def paired_family(values: DataFrame, condition: str, reference: str, pair: Sequence[str] = ("split_seed",)) -> DataFrame:
    """Each condition less the reference, by metric, over matched repetitions: (condition, metric, value, pair) in.

    A repetition that only one side has is an error.
    """
    cell = F.struct(F.col(condition).alias("c"), F.col("metric").alias("m"), F.col("value").cast("double").alias("v"))
    runs = values.groupBy(*pair).agg(F.collect_list(cell).alias("x"))  # conditions times metrics of one repetition
    different = lambda f: F.size(F.array_distinct(F.transform("x", f)))
    conditions = different(lambda r: r["c"])
    whole = (conditions > 1) & (conditions * different(lambda r: r["m"]) == F.size("x")) & (different(lambda r: F.struct(r["c"], r["m"])) == F.size("x"))
    whole &= F.exists("x", lambda r: r["c"] == reference) & F.forall("x", lambda r: r["v"].isNotNull())
    base = F.map_from_entries(F.transform(F.filter("x", lambda r: r["c"] == reference), lambda r: F.struct(r["m"], r["v"])))
    gaps = F.transform(F.filter("x", lambda r: r["c"] != reference), lambda r: F.struct(r["c"].alias(condition), r["m"].alias("metric"), (r["v"] - F.element_at(base, r["m"])).alias("d")))
    unmatched = F.raise_error(F.lit("unmatched repetition"))
    diff = runs.select(F.inline(F.when(whole, gaps).otherwise(unmatched)))
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    signs = [count(F.col("d") > _TIE, "wins"), count(F.abs("d") <= _TIE, "ties"), count(F.col("d") < -_TIE, "losses")]
    out = diff.groupBy(condition, "metric").agg(*moments("d"), *signs, F.collect_list("d").alias("__d")).withColumnRenamed("__d", "d")
    most = F.max("n").over(Window.partitionBy("metric"))
    out = out.withColumn("n", F.when(F.col("n") == most, F.col("n")).otherwise(unmatched.cast("long")))
    out = _flipped(with_interval(out)).drop("d")
    out = out.withColumn("standardized", F.when(F.col("sample_sd") > 0, F.col("mean") / F.col("sample_sd")))
    return holm(out, ["metric"], "p")


def partition_fingerprint(assignments: DataFrame, group: Sequence[str], subject: str = "subject_id", fold: str = "outer_fold") -> DataFrame:
    """(group, fingerprint) of the test folds as sets, whatever the folds' numbers."""
    ids = F.array_join(F.sort_array(F.collect_list(F.col(subject).cast("string"))), ",")
    sets = assignments.groupBy(*group, fold).agg(ids.alias("ids"))
    return sets.groupBy(*group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("ids")), ";"), 256).alias("fingerprint"))


def oof(predictions: DataFrame, run: Sequence[str], subjects: DataFrame | None = None) -> DataFrame:
    """Test rows of a run; a subject with none or several is an error.

    Subjects are those with a row of any role and those of `subjects` (run columns, subject_id), if given.
    """
    keys = [*run, "subject_id"]
    rows = predictions
    if subjects is not None:
        rows = predictions.join(subjects.select(*keys).distinct(), keys, "full_outer")
    tested = F.sum(F.coalesce((F.col("role") == "test").cast("int"), F.lit(0))).over(Window.partitionBy(*keys))
    known = F.when(F.col("__n") == 1, F.col("role") == "test").otherwise(F.raise_error(F.when(F.col("__n") > 1, "a subject has several test rows, not one test row").otherwise("a subject has not one test row")).cast("boolean"))
    return rows.withColumn("__n", tested).where(known).drop("__n")


def repeated_summary(predictions: DataFrame, experiment: Sequence[str] = ("experiment",), threshold: float = 0.5) -> DataFrame:
    """(experiment, metric, n, mean, sample_sd, ci95_low, ci95_high) over the out-of-fold metrics of each repetition."""
    runs = binary_metrics(oof(predictions, [*experiment, "split_seed"]), [*experiment, "split_seed"], threshold=threshold)
    return intervals(melt(runs, [*experiment, "split_seed"]), [*experiment, "metric"], "value")


def oof_fingerprint(predictions: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, rows, fingerprint) of the out-of-fold rows (subject, label, fold) in any order.

    Sums of the digests' parts, so that no group is gathered; equal fingerprints mean equal rows.
    """
    one = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("subject_id", "label", "outer_fold"))), 256)
    parts = [F.sum(F.conv(F.substring(one, k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in (1, 16, 31, 46)]
    return predictions.where("role = 'test'").groupBy(*group).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("fingerprint"))


def repetition_problems(predictions: DataFrame, experiment: Sequence[str] = ("experiment",)) -> DataFrame:
    """(experiment, problem, cases): every way in which runs of several split seeds aren't repetitions of one experiment.

    Repeated partition: seeds whose test folds are those of another.  Uneven coverage: subjects that some seed lacks.
    Label changed: subjects of several labels.  Repeated subject: those tested twice in a seed.  Fold numbering: seeds
    whose folds aren't 0 to n - 1.  Fold count: seeds that have not as many folds as the first.  Undefined metric: seeds
    with one label only.  Single repetition: experiments of one seed.
    """
    key = list(experiment)
    test = predictions.where("role = 'test'")
    if "label" not in test.columns:
        test = test.withColumn("label", F.lit(None).cast("int"))  # the rules about labels then find nothing
    n = lambda c: F.sum(c.cast("long"))
    prints = partition_fingerprint(test, [*key, "split_seed"]).groupBy(*key).agg((F.count("*") - F.count_distinct("fingerprint")).alias("repeated partition"))
    folds = test.groupBy(*key, "split_seed").agg(F.count_distinct("outer_fold").alias("folds"), F.min("outer_fold").alias("low"), F.max("outer_fold").alias("high"), (F.min("label") == F.max("label")).alias("flat"))
    numbered = (F.col("low") == 0) & (F.col("high") == F.col("folds") - 1)
    seeds = folds.groupBy(*key).agg(
        F.count("*").alias("seeds"),
        n(~numbered).alias("fold numbering"),
        F.sort_array(F.collect_list(F.struct("split_seed", "folds"))).alias("each"),
        n(F.col("flat")).alias("undefined metric"),
        (F.count("*") == 1).cast("long").alias("single repetition"),
    )
    unlike = F.size(F.filter("each", lambda r: r["folds"] != F.element_at("each", 1)["folds"])).cast("long")
    per = test.groupBy(*key, "subject_id").agg(F.count_distinct("split_seed").alias("k"), F.count("*").alias("rows"), (F.min("label") != F.max("label")).alias("changed"))
    per = per.join(seeds.select(*key, "seeds"), key)
    subjects = per.groupBy(*key).agg(n(F.col("k") != F.col("seeds")).alias("uneven coverage"), n(F.col("changed")).alias("label changed"), n(F.col("rows") > F.col("k")).alias("repeated subject"))
    all_ = seeds.withColumn("fold count", unlike).join(prints, key).join(subjects, key)
    names = ("repeated partition", "uneven coverage", "label changed", "repeated subject", "fold numbering", "fold count", "undefined metric", "single repetition")
    return all_.select(*key, F.inline(F.array(*(F.struct(F.lit(x).alias("problem"), F.col(x).alias("cases")) for x in names)))).where("cases > 0")


def fuse(primary: DataFrame, secondary: DataFrame, weight: float, threshold: float = 0.5, keys: Sequence[str] = ("split_seed", "subject_id")) -> DataFrame:
    """(1 - weight) * primary + weight * secondary on equal sets of rows; labels and folds must agree, else it is an error."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight is between 0 and 1")
    a = primary.select(*keys, "outer_fold", "label", F.col("score").alias("primary_score"))
    b = secondary.select(*keys, F.col("outer_fold").alias("__fold"), F.col("label").alias("__label"), F.col("score").alias("secondary_score"))
    both = a.join(b, list(keys), "full_outer")
    fine = F.coalesce((F.col("outer_fold") == F.col("__fold")) & (F.col("label") == F.col("__label")), F.lit(False))
    score = F.when(fine, (1 - weight) * F.col("primary_score") + weight * F.col("secondary_score")).otherwise(F.raise_error(F.lit("rows of the two sides differ")).cast("double"))
    out = both.withColumn("score", score).withColumn("threshold", F.lit(threshold)).withColumn("prediction", (F.col("score") >= threshold).cast("int"))
    return out.select(*keys, "outer_fold", "label", "primary_score", "secondary_score", "score", "threshold", "prediction")


def condition_table(summary: DataFrame, condition: str = "experiment") -> DataFrame:
    """One row per condition with the mean of each metric."""
    return summary.groupBy(condition).pivot("metric", list(METRICS)).agg(F.first("mean"))
