"""Compression of vectors to short codes, with the nearest entries found by a vector-approximation file.

A vector's components become integers and the vector is cut into equal consecutive parts; each position of a part
has a codebook of integer entries, fitted by rounds of assignment and floored means.  Entries' coordinates are
quantised to a few bits: per dimension, sorted coordinates are cut into cells, each with its least and greatest
member.  For each part to be coded, tables per dimension hold the least and greatest squared distance to each cell;
an entry's cells look up a lower and an upper bound of its distance.  Only entries whose lower bound doesn't exceed
the least upper bound are refined by exact integer distances, so codes are those of a full comparison.

Codebooks (entries x dimensions integers) are all that reaches the driver or is broadcast; tasks send sums and counts
of each entry, which Spark adds up.

Defined results: vectors that are null, or hold null or non-finite components, are dropped; ties go to the lower
index; entries that nothing is assigned to stay; fewer vectors than entries give a smaller codebook; equal vec_ids are
taken in the order of their vectors; null vec_ids come last and are coded like others; an empty table gives no rows.
Columns other than those named aren't carried, so none can clash.  Vectors of several lengths, of a length that the
parts don't divide (the empty vector too), or so large that distances pass 64 bits are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.scratch import Scratch, batch_rows
from weftline.llm.textbytes import lean

PARTS, ENTRIES, ROUNDS, BITS, SCALE = 16, 64, 2, 3, 256
#: Vectors that are compared with all entries at once.
BLOCK = 2048
#: A label with a larger share of the rows is looked up in a broadcast table, which so has at most this many rows.
HOT_SHARE = 1000


@dataclass
class Codebooks:
    entries: np.ndarray  # int64: parts x entries x width

    @property
    def digest(self) -> str:
        """SHA-256 of all components in order, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(vector: Column) -> Column:
    """Not null, and neither are its components, which are finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of floor(SCALE * x)."""
    if (np.diff(column.offsets.to_numpy()) != dims).any():
        raise ValueError(f"all vectors must have {dims} components, as the first one has")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= np.sqrt(2.0**62 / max(1, dims)) / 2:
        raise OverflowError("a component is so large that squared distances pass 64 bits")
    return x.astype(np.int64).reshape(-1, dims)


class ApproximationFile:
    """The entries of one part position and their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = min(n, 1 << bits)
        order = np.argsort(entries, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        self.cell = place * cells // n  # equally full cells
        self.low, self.high = np.empty((cells, width), np.int64), np.empty((cells, width), np.int64)
        for c in range(cells):
            inside = self.cell == c
            self.low[c] = np.where(inside, entries, np.iinfo(np.int64).max).min(axis=0)
            self.high[c] = np.where(inside, entries, np.iinfo(np.int64).min).max(axis=0)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(rows, entries) booleans: which entries the bounds don't rule out."""
        lower = np.zeros((len(self.entries), len(x)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(x.shape[1]):
            below, above = self.low[:, j, None] - x[None, :, j], x[None, :, j] - self.high[:, j, None]
            near = np.maximum(np.maximum(below, above), 0) ** 2
            far = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += near[self.cell[:, j]]
            upper += far[self.cell[:, j]]
        return (lower <= upper.min(axis=0)).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the index of the nearest entry, the lower one in a tie, and the squared distance."""
        row, entry = np.nonzero(self.candidates(x))  # by row, then by entry; every row has one at least
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        best = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[best], least


def assign(x: np.ndarray, books: list[ApproximationFile]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of indexes and of squared distances."""
    width = x.shape[1] // len(books)
    code, error = np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books)), np.int64)
    for at in range(0, len(x), BLOCK):
        for p, book in enumerate(books):
            code[at : at + BLOCK, p], error[at : at + BLOCK, p] = book.nearest(x[at : at + BLOCK, p * width : (p + 1) * width])
    return code, error


def _summing(held):
    """Sums and counts of the vectors assigned to each entry, once a task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = held.value
        parts, n, width = entries.shape
        books = [ApproximationFile(e) for e in entries]
        sums, counts = np.zeros((parts, n, width)).astype(object), np.zeros((parts, n), np.int64)
        for batch in batches:
            x = _integers(batch.column(0), parts * width)
            code, _ = assign(x, books)
            for p in range(parts):
                part = np.zeros((n, width), np.int64)
                np.add.at(part, code[:, p], x[:, p * width : (p + 1) * width])
                sums[p] += part.astype(object)
                counts[p] += np.bincount(code[:, p], minlength=n)
        used = np.argwhere(counts > 0)
        if len(used):
            kind = pa.list_(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array([counts[p, e] for p, e in used], pa.int64()), pa.array([[int(v) for v in sums[p, e]] for p, e in used], kind)],
                ["part", "entry", "n", "sums"],
            )

    return run


def fit_codebooks(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that start as the vectors of the smallest ids; None without vectors."""
    kept = rows.where(whole(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    start = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not start:
        return None
    dims = len(start[0])
    if not dims or dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    flat = _integers(pa.array([list(map(float, v)) for v in start], pa.list_(pa.float64())), dims)
    books = flat.reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(books)
        sent = kept.select("v").mapInArrow(_summing(held), "part int, entry int, n bigint, sums array<decimal(38,0)>")
        flat_sums = sent.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        for r in flat_sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
        held.destroy()
    return Codebooks(books)


def _coding(held):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = held.value.shape
        books = [ApproximationFile(e) for e in held.value]
        for batch in batches:
            code, error = assign(_integers(batch.column(2), parts * width), books)
            hexed = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexed, pa.string()), pa.array(error.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def encode(rows: DataFrame, books: Codebooks, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every whole vector, under the names given."""
    if books.entries.shape[1] > 256:
        raise ValueError("a code has two hex digits for each part, so at most 256 entries")
    held = rows.sparkSession.sparkContext.broadcast(books.entries)
    kept = rows.where(whole(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.mapInArrow(_coding(held), schema).withColumnsRenamed({"vec_id": vec_id, "label": label})


def sum_by_label(coded: DataFrame, *, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """`coded` with the errors of its label summed, nulls together; give it a written table, which is read three times.

    A label may hold a third of the rows: sums are partial before they are shuffled, and labels of over a thousandth
    of the rows, of which there can't be more than a thousand, come back by broadcast, the others by a join.
    """
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum(error).alias(out), F.count("*").alias("__n"))
    total = coded.agg(F.count("*").alias("__all"))
    judged = sums.join(F.broadcast(total)).withColumn("__hot", F.col("__n") * HOT_SHARE > F.col("__all"))  # a single row
    same = F.col(label).eqNullSafe(F.col("__label"))
    hot, rest = (judged.where(c).select("__label", out, F.lit(True).alias("__found")) for c in (F.col("__hot"), ~F.col("__hot")))
    first = coded.join(F.broadcast(hot), same, "left")
    second = first.where("__found IS NULL").select(*coded.columns).join(rest, same)
    return first.where("__found").select(*coded.columns, out).unionByName(second.select(*coded.columns, out))


def compress(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every whole vector."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "codes")
    with batch_rows(spark, 8192):
        books = fit_codebooks(rows, vec_id=vec_id, vector=vector, parts=parts, entries=entries, rounds=rounds)
        books = books or Codebooks(np.empty((parts, 0, 0), np.int64))
        if books.entries.size:
            coded = scratch.save(encode(rows, books, vec_id=vec_id, vector=vector, label=label), "coded")
        else:
            coded = rows.where("false").select(vec_id, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return sum_by_label(coded, label=label).withColumn("codebooks_sha256", F.lit(books.digest))
