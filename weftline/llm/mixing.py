"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated (each pass shuffled anew) as far as its target
needs.  A document's virtual finish time is the words of its source up to its end, divided by the source's target, so
all sources reach their targets at time 1.  All queues are sorted by finish time into one stream, which is truncated
at the total budget; the document in which a source reaches its target is served in two pieces, one before and one
after that time.  So every prefix of the stream holds the sources nearly in proportion, up to a document each.

Only documents' ids and sizes are sorted, never their texts.  Orders are range partitions with carried sums (see
ordered), so a source with a third of all documents is spread over partitions.  Sources are a table, not a list on
the driver; of it only sums are collected.

Defined results: null or empty texts have size 0 and are taken 0 times; null sources are one source, the last; rows
that repeat count each for itself; ties in the shuffled order are between rows of equal id and size only, so reruns
agree; an empty table gives no rows; other columns aren't carried, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.ordered import ranged, running
from weftline.llm.scratch import Scratch


def count_words(text: Column) -> Column:
    """The number of runs of other characters than space and U+0009 to U+000D; null has none."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, source: str, weights: Sequence[float], scratch: Scratch) -> DataFrame:
    """`sources` with `place` (from 0, by code point, null last) and `weight`, the weights repeating in that order."""
    order = [F.col(source).asc_nulls_last()]
    placed = running(ranged(sources, order, scratch, "places", sources.count()).withColumn("__one", F.lit(1).cast("long")), "__one", order, "place").drop("__one", "part")
    placed = placed.withColumn("place", F.col("place") - 1)
    return placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))


def fill_targets(sources: DataFrame, total: int, most: float, *, size: str = "source_size", weight: str = "weight") -> DataFrame:
    """`sources` with `target`: shares of `total` by weight, none above `most` times its size; the excess is shared anew by weight until none is.

    Each round is one aggregation of the sources' table, of which three sums reach the driver; give it a written table.
    """
    cap = F.lit(float(most)) * F.col(size)
    if sources.where(~(F.col(weight) > 0)).limit(1).count():
        raise ValueError("weights are positive")
    level, stopped = 0.0, -1
    while True:
        over = (F.lit(level) * F.col(weight) > cap) if stopped >= 0 else F.lit(False)
        n, caught, rest = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.sum(F.when(~over, F.col(weight)))).first()
        if n == stopped:
            break
        stopped = n
        if not rest:  # all are full, or there are none
            break
        level = (total - caught) / rest
    return sources.withColumn("target", F.when(F.lit(level) * F.col(weight) > cap, cap).otherwise(F.lit(level) * F.col(weight)))


def shuffled(seed: int, epoch: Column, doc_id: Column, size: Column) -> Column:
    """A place in the shuffled order: 60 bits of a digest, the same on every engine."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[float], *, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, total: int | None = None, seed: int = 0) -> DataFrame:
    """The mixed stream, a row per piece: row_id, doc_id, size, source, source_size, target, epoch, first (word of the source's queue), words, finish, at, taken.

    `at` is the number of words of the stream before the piece and `taken` how many of its words the budget lets in:
    all or none but at the cut.  `total` is the budget, by default all words; `row_id` tells repeated rows apart.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size")), "sizes")
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = words if total is None else total
    sources = scratch.save(cyclic_weights(scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), "source", weights, scratch), "weights")
    sources = scratch.save(fill_targets(sources, budget, most), "targets").withColumnRenamed("source", "__source")

    passes = F.greatest(F.lit(1), F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(1)).cast("int")
    copies = sized.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    copies = copies.withColumn("draw", shuffled(seed, F.col("epoch"), F.col("doc_id"), F.col("size")))
    order = [F.col(c) for c in ("place", "epoch", "draw", "doc_id", "size", "row_id")]
    queues = running(ranged(copies, order, scratch, "queues", rows * most), "size", order, "end", ["place"])

    goal = F.floor("target")
    start = F.col("end") - F.col("size")
    piece = lambda a, b: F.struct(a.alias("first"), (b - a).alias("words"), b.alias("last"))
    cut = (start < goal) & (goal < F.col("end"))
    pieces = queues.drop("part").select("*", F.inline(F.when(cut, F.array(piece(start, goal), piece(goal, F.col("end")))).otherwise(F.array(piece(start, F.col("end"))))))
    pieces = pieces.withColumn("finish", F.when(F.col("target") > 0, F.col("last") / F.col("target")).otherwise(0.0)).drop("end")
    order = [F.col(c) for c in ("finish", "place", "last", "epoch", "draw", "doc_id", "size", "row_id")]
    stream = running(ranged(pieces, order, scratch, "stream", rows * most), "words", order, "past")
    at = F.col("past") - F.col("words")
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - at)).cast("long")
    scratch.keep("stream")
    return stream.select("row_id", "doc_id", "size", "source", "source_size", "target", "epoch", "first", "words", "finish", at.alias("at"), taken.alias("taken"))


def taken_words(stream: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row that was mixed."""
    own = ["doc_id", "size", "source_size", "target"]
    return stream.groupBy("row_id", *own).agg(F.sum("taken").alias("taken")).select(*own, "taken")
