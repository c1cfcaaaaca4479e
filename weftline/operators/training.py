"""Scoring and training of the hierarchical classifier, Spark dealing the subjects.

One step of all seeds and folds is one job: tasks add up the derivatives of their subjects for every model that trains
on them, Spark sums them by model and parameter, and the driver, which holds nothing but parameters, moves these.  So
a fold is never one group, and its size is bounded by nothing.  What is broadcast and collected is models times
parameters, at most `MODEL_BYTES`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import hierarchical as hi
from weftline.operators.stats import repeated_summary

KEYS = ("split_seed", "outer_fold")
#: All models' parameters together; more are an error: train fewer seeds at once.
MODEL_BYTES = 1 << 28
#: Subjects of a padded batch.
BATCH = 64


@dataclass(frozen=True)
class TrainingSettings:
    epochs: int
    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    gradient_clip_norm: float = 1.0
    early_stopping_patience: int = 5
    seed: int = 0
    steps: int = 1  # an epoch's subjects are dealt to so many steps by a hash

    def __post_init__(self) -> None:
        if min(self.epochs, self.early_stopping_patience, self.steps) < 1 or min(self.learning_rate, self.gradient_clip_norm) <= 0 or self.weight_decay < 0:
            raise ValueError("epochs, patience, steps, rate and clip are positive")


def sequences(posts: DataFrame, subjects: DataFrame, content: Sequence[str], limit: int, *, subject: str = "subject_id", position: str = "pos", metadata: str | None = None) -> DataFrame:
    """`subjects` with `posts`: array of (pos, content vectors, metadata) in order; empty for a subject without posts.

    More than `limit` posts of a subject are an error, found without gathering them: take windows first.
    """
    fields = [F.col(position).alias("pos"), *(F.col(c).cast("array<double>").alias(f"c{k}") for k, c in enumerate(content)), (F.col(metadata) if metadata else F.array()).cast("array<double>").alias("m")]
    place = F.row_number().over(Window.partitionBy(subject).orderBy(position))
    some = posts.select(subject, F.struct(*fields).alias("post"), place.alias("__k")).where(F.col("__k") <= limit + 1)
    many = F.when(F.count("*") > limit, F.raise_error(F.lit(f"a subject has more than {limit} posts"))).otherwise(F.sort_array(F.collect_list("post")))
    gathered = some.groupBy(subject).agg(many.alias("posts"))
    return subjects.join(gathered, subject, "left").withColumn("posts", F.coalesce("posts", F.array().cast(gathered.schema["posts"].dataType)))


def padded(posts: pa.Array, s: hi.HierarchicalSettings, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content (subjects, limit, representations, width), metadata (subjects, limit, m) and mask of a column of posts."""
    if isinstance(posts, pa.ChunkedArray):
        posts = posts.combine_chunks()
    n, size = len(posts), np.diff(posts.offsets.to_numpy())
    row, at = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    content, metadata, mask = np.zeros((n, limit, s.representations, s.embedding_dimension)), np.zeros((n, limit, s.metadata_dimension)), np.zeros((n, limit), bool)
    flat = posts.flatten()

    def put(out: np.ndarray, name: str, width: int) -> None:
        column = flat.field(name) if not flat.null_count else None
        if column is None or column.null_count or (np.diff(column.offsets.to_numpy()) != width).any():
            raise ValueError(f"every post has {width} numbers in {name}")
        values = column.flatten().to_numpy(zero_copy_only=False)
        if not np.isfinite(values).all():
            raise ValueError(f"{name} holds numbers that aren't finite")
        out[row, at] = values.reshape(-1, width)

    if len(row):
        for k in range(s.representations):
            put(content[:, :, k], f"c{k}", s.embedding_dimension)
        if s.metadata_dimension:
            put(metadata, "m", s.metadata_dimension)
    mask[row, at] = True
    return content, metadata, mask


def to_table(spark: SparkSession, models: dict[tuple[int, int], dict[str, np.ndarray]]) -> DataFrame:
    """(split_seed, outer_fold, name, shape, weights): a row per parameter array, to be stored."""
    rows = [(*key, name, list(map(int, v.shape)), v.ravel().tolist()) for key, m in models.items() for name, v in sorted(m.items())]
    return spark.createDataFrame(rows, "split_seed int, outer_fold int, name string, shape array<int>, weights array<double>")


def from_table(table: DataFrame) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    size = table.agg(F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()[0]
    _check_size(size)
    out: dict[tuple[int, int], dict[str, np.ndarray]] = {}
    for r in table.collect():
        out.setdefault((r["split_seed"], r["outer_fold"]), {})[r["name"]] = np.array(r["weights"]).reshape(r["shape"])
    return out


def _check_size(numbers: int) -> None:
    if numbers * 8 > MODEL_BYTES:
        raise ValueError(f"models of {numbers} parameters together: train or score fewer seeds at once")


def _uses(assignments: DataFrame, subject: str) -> DataFrame:
    """A subject's folds and roles in one row; their number is that of seeds and folds."""
    return assignments.groupBy(F.col(subject)).agg(F.first("label_id").alias("label"), F.sort_array(F.collect_list(F.struct(*KEYS, "role"))).alias("uses"))


def _batches(batch: pa.RecordBatch, s: hi.HierarchicalSettings, limit: int) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, BATCH):
        part = batch.slice(at, BATCH)
        yield (part, *padded(part.column("posts"), s, limit), part.column("uses").to_pylist())


def score(seqs: DataFrame, assignments: DataFrame, models: DataFrame, settings: hi.HierarchicalSettings, limit: int, *, subject: str = "subject_id") -> DataFrame:
    """(split_seed, outer_fold, subject, role, label, decision_value, score): each subject by every model of its assignments."""
    known = from_table(models)
    if any(set(m) != set(settings.shapes()) for m in known.values()):
        raise ValueError("the stored models are of other settings")
    held = seqs.sparkSession.sparkContext.broadcast(known)
    rows = seqs.select(subject, "posts").join(_uses(assignments, subject), subject)
    kind = rows.schema[subject].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content, metadata, mask, uses in _batches(batch, settings, limit):
                role_of: dict[tuple, list] = {}
                for i, own in enumerate(uses):
                    for u in own:
                        role_of.setdefault((u["split_seed"], u["outer_fold"]), []).append((i, u["role"]))
                for key, who in role_of.items():
                    at = np.array([i for i, _ in who])
                    logits = hi.forward(settings, hi.Layers(held.value[key]), content[at], metadata[at], mask[at])[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * len(at), pa.int32()), pa.array([key[1]] * len(at), pa.int32()), part.column(subject).take(pa.array(at)), pa.array([r for _, r in who]), part.column("label").take(pa.array(at)).cast(pa.int32()), pa.array(logits), pa.array(1 / (1 + np.exp(-logits)))],
                        [*KEYS, subject, "role", "label", "decision_value", "score"],
                    )

    schema = T.StructType([*(T.StructField(k, T.IntegerType()) for k in KEYS), T.StructField(subject, kind), T.StructField("role", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("decision_value", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def _summing(held, epoch: int, step: int, settings: hi.HierarchicalSettings, training: TrainingSettings, limit: int, subject: str):
    """Per model: derivatives by all parameters, then loss and number of the training and of the validation subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {key: hi.unpack(settings, flat) for key, flat in held.value.items()}
        total = {key: np.zeros(sum(v.size for v in m.values()) + 4) for key, m in models.items()}
        for batch in batches:
            for part, content, metadata, mask, uses in _batches(batch, settings, limit):
                label = part.column("label").to_numpy().astype(float)
                turn = part.column("turn").to_numpy()
                names = [str(v) for v in part.column(subject).to_pylist()] if settings.dropout else []
                for key, m in models.items():
                    role = np.array([next((u["role"] for u in own if (u["split_seed"], u["outer_fold"]) == key), "") for own in uses])
                    at = np.flatnonzero((role == "train") & (turn == step))
                    if len(at):
                        draws = [np.random.default_rng([training.seed & 0xFFFFFFFF, *key, epoch, zlib.crc32(names[i].encode())]) for i in at] if names else None
                        loss, slopes = hi.loss_and_slopes(settings, m, content[at], metadata[at], mask[at], label[at], draws)
                        total[key] += np.concatenate([hi.pack(slopes), [loss, len(at), 0, 0]])
                    at = np.flatnonzero(role == "validation") if step == 0 else []
                    if len(at):
                        logits = hi.forward(settings, hi.Layers(m), content[at], metadata[at], mask[at])[0]
                        total[key][-2:] += hi.logistic_loss(logits, label[at]), len(at)
        for key, v in total.items():
            if v[-3] or v[-1]:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([v], pa.list_(pa.float64()))], [*KEYS, "v"])

    return run


def fit(seqs: DataFrame, assignments: DataFrame, settings: hi.HierarchicalSettings, training: TrainingSettings, limit: int, *, subject: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """(models, history): for every seed and fold the parameters of the epoch with the least validation loss.

    History is (split_seed, outer_fold, epoch, train_loss, validation_loss, best) per epoch; epoch 0 is the start.
    Steps follow the derivatives by decoupled weight decay and bounded moments; a model stops `early_stopping_patience`
    epochs after its best. Sums don't depend on how subjects lie in partitions, but for rounding.
    """
    spark = seqs.sparkSession
    keys = [(r[0], r[1]) for r in assignments.select(*KEYS).distinct().orderBy(*KEYS).collect()]
    start = hi.pack(hi.initial(settings, training.seed))
    _check_size(len(keys) * 4 * len(start))
    turn = F.pmod(F.xxhash64(F.lit(training.seed), F.col(subject)), F.lit(training.steps)).cast("int").alias("turn")
    data = seqs.select(subject, "posts").join(_uses(assignments, subject), subject).select(subject, "posts", F.col("label").cast("int").alias("label"), "uses", turn).persist(StorageLevel.MEMORY_AND_DISK)
    now = {k: hi.pack(hi.initial(settings, training.seed + k[1])) for k in keys}
    first, second, moves = {k: 0.0 for k in keys}, {k: 0.0 for k in keys}, dict.fromkeys(keys, 0)
    best: dict[tuple, tuple[float, int, np.ndarray]] = {}
    history = []
    try:
        for epoch in range(training.epochs + 1):
            losses: dict[tuple, list[float]] = {k: [0.0, 0.0] for k in now}
            for step in range(training.steps if epoch < training.epochs else 1):
                held = spark.sparkContext.broadcast(now)
                sent = data.mapInArrow(_summing(held, epoch, step, settings, training, limit, subject), "split_seed int, outer_fold int, v array<double>")
                summed = sent.select(*KEYS, F.posexplode("v").alias("at", "x")).groupBy(*KEYS, "at").agg(F.sum("x").alias("x")).toArrow()
                held.destroy()
                found = {k: np.zeros(len(start) + 4) for k in now}
                for a, b, at, x in zip(*(c.to_pylist() for c in summed.columns), strict=True):
                    found[a, b][at] = x
                for key in list(now):
                    slope, (loss, n, held_loss, held_n) = found[key][:-4], found[key][-4:]
                    if step == 0:
                        if not held_n:
                            raise ValueError(f"fold {key} has no validation subjects")
                        value = float(held_loss / held_n)
                        better = key not in best or value < best[key][0]
                        history.append((*key, epoch, None, value, better))
                        if better:
                            best[key] = (value, epoch, now[key].copy())
                        elif epoch - best[key][1] >= training.early_stopping_patience:
                            del now[key]
                            continue
                    if epoch == training.epochs or not n:
                        continue
                    losses[key][0] += loss
                    losses[key][1] += n
                    slope = slope / n
                    slope *= min(1.0, training.gradient_clip_norm / (np.sqrt(slope @ slope) + 1e-6))
                    moves[key] += 1
                    first[key] = 0.9 * first[key] + 0.1 * slope
                    second[key] = 0.999 * second[key] + 0.001 * slope * slope
                    ahead = first[key] / (1 - 0.9 ** moves[key]) / (np.sqrt(second[key] / (1 - 0.999 ** moves[key])) + 1e-8)
                    now[key] = now[key] * (1 - training.learning_rate * training.weight_decay) - training.learning_rate * ahead
                if not now:
                    break
            # an epoch's training loss belongs to the row that its steps started from
            history = [(*h[:3], float(losses[h[:2]][0] / losses[h[:2]][1]), *h[4:]) if h[2] == epoch and h[:2] in losses and losses[h[:2]][1] else h for h in history]
            if not now:
                break
    finally:
        data.unpersist()
    rows = [(*h[:5], h[2] == best[h[:2]][1]) for h in history]
    models = to_table(spark, {k: hi.unpack(settings, v[2]) for k, v in best.items()})
    return models, spark.createDataFrame(rows, "split_seed int, outer_fold int, epoch int, train_loss double, validation_loss double, best boolean")


def mean_mlp_settings(dimension: int, hidden: int = 512, dropout: float = 0.0) -> hi.HierarchicalSettings:
    """The mean-pool classifier, norm, hidden layer, GELU and output over the mean of a subject's vectors, as a case of the model."""
    return hi.HierarchicalSettings(d_model=dimension, embedding_dimension=dimension, classifier_hidden_dim=hidden, dropout=dropout, architecture_variant="mean_pooling_at_both_levels")


def sweep(seqs: DataFrame, assignments: DataFrame, settings: hi.HierarchicalSettings, training: TrainingSettings, limit: int, seeds: Sequence[int], *, subject: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """(predictions, summary) of models that differ in their training seed alone, on the same folds.

    Predictions carry `training_seed`; the summary is of each split seed's metrics over the training seeds.
    """
    if len(set(seeds)) != len(seeds) or len(seeds) < 2:
        raise ValueError("a sweep has two distinct training seeds at least")
    out = None
    for seed in seeds:
        models, _ = fit(seqs, assignments, settings, replace(training, seed=seed), limit, subject=subject)
        scored = score(seqs, assignments, models, settings, limit, subject=subject).withColumn("training_seed", F.lit(seed))
        out = scored if out is None else out.unionByName(scored)
    runs = out.select(F.col("split_seed").alias("of_split"), F.col("training_seed").alias("split_seed"), F.col(subject).alias("subject_id"), "outer_fold", "role", "label", "score")
    return out, repeated_summary(runs, ["of_split"]).withColumnRenamed("of_split", "split_seed")
