"""Language identification as inference of a mixture of languages.

A document is a bag of byte trigrams, each drawn from one of its languages.
Trigram distributions of the languages come from all labelled documents, in
tables of 2**bits hashed trigrams.  For each document expectation-maximisation
estimates the proportions of all languages; then the sets of its k largest ones
are compared by likelihood less a penalty of `penalty * ln(trigrams)` for each
language beyond the first.  Whole slices of documents are fitted at once.

Defined results: null texts and texts without a letter are `und` with score 0, as
is everything where nothing could be learned; ties go to the language that sorts
first; repeated rows are judged alike; columns in the way of the operator's own
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import textbytes as tb
from weftline.llm.packed import pack_counts, sum_counts, unpack_counts
from weftline.llm.quality import held_out
from weftline.llm.scratch import bound_batches

UNDETERMINED = "und"
BITS = 16
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = _IS_LETTER[128:] = True


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # float32, slots x languages
    penalty: float
    prior: list[float]  # shares of all trigrams, for texts too short for one


def trigrams(part: tb.TextSlice, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of the trigrams of lower-cased texts; everything but letters is a space, and only one in a row."""
    tb.lower_ascii(part.data)
    data = np.where(_IS_LETTER[part.data], part.data, 32)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[part.offsets[:-1][part.offsets[:-1] < len(data)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    data, bounds = data[keep].astype(np.uint32), at[part.offsets]
    if len(data) < 3:
        none = np.empty(0, np.int64)
        return none, none, none
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    row = np.repeat(np.arange(part.rows, dtype=np.uint64), np.diff(bounds))
    same = row[:-2] == row[2:]
    key = np.sort(row[:-2][same] << np.uint64(bits) | slot[same].astype(np.uint64))
    if not len(key):
        none = np.empty(0, np.int64)
        return none, none, none
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    n = np.diff(np.append(first, len(key)))
    key = key[first].astype(np.int64)
    return key >> bits, key & ((1 << bits) - 1), n


def _counting(languages: list[str], bits: int):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {v: k for k, v in enumerate(languages)}
        total = np.zeros((len(languages), 1 << bits), np.int64)
        for batch in batches:
            lang = np.array([index[v] for v in batch.column(1).to_pylist()], np.int64)
            for part in tb.slices(batch.column(0)):
                row, slot, n = trigrams(part, bits)
                np.add.at(total, (lang[part.first + row], slot), n)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pack_counts(total[k]) for k in used], pa.binary())], ["key", "counts"])

    return run


def train_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = BITS, penalty: float = 6.0) -> LanguageModel:
    """Trigram tables from every text with a language that isn't held out."""
    bound_batches(docs.sparkSession)
    learn = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.lower(text).alias("t"), F.col(lang).alias("g"))
    languages = sorted(r["g"] for r in learn.select("g").distinct().collect())
    if not languages:
        return LanguageModel([], np.empty((1 << bits, 0), np.float32), penalty, [])
    counts = np.zeros((1 << bits, len(languages)))
    for r in sum_counts(learn.mapInArrow(_counting(languages, bits), "key int, counts binary")).collect():
        counts[:, r["key"]] = unpack_counts(r["counts"])
    smooth = 0.05
    p = (counts + smooth) / (counts.sum(axis=0) + smooth * (1 << bits))
    return LanguageModel(languages, np.log(p).astype(np.float32), penalty, (counts.sum(axis=0) / max(1.0, counts.sum())).tolist())


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps and the log-likelihood before the last; segments begin at `starts`."""
    length = np.diff(np.append(starts, len(n)))
    total = np.add.reduceat(n, starts)[:, None]
    mix = np.empty(len(n))
    for _ in range(steps):
        joint = p * np.repeat(share, length, axis=0)
        mix = joint.sum(axis=1)
        joint *= (n / mix)[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    return share, np.add.reduceat(n * np.log(mix), starts)


def _reach(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A bound of the log-likelihood that any proportions can have: it is concave, so its tangent at `share` lies above it."""
    mix = (p * np.repeat(share, np.diff(np.append(starts, len(n))), axis=0)).sum(axis=1)
    slope = np.add.reduceat(p * (n / mix)[:, None], starts, axis=0)
    return np.add.reduceat(n * np.log(mix), starts) + slope.max(axis=1) - np.add.reduceat(n, starts)


def infer(row: np.ndarray, slot: np.ndarray, n: np.ndarray, model: LanguageModel, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have trigrams and the proportions of their chosen languages (zero for the others)."""
    if not len(row):
        return np.empty(0, np.int64), np.empty((0, len(model.languages)))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    n = n.astype(np.float64)
    log_p = model.log_p[slot].astype(np.float64)
    # each trigram's likelihoods relative to its likeliest language: no underflow, and the differences are the same
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])
    single = np.add.reduceat((log_p - top[:, None]) * n[:, None], starts, axis=0)
    k = p.shape[1]
    share, _ = _em(p, n, starts, np.full((len(starts), k), 1.0 / k), steps)
    full = _reach(p, n, starts, share)
    order = np.argsort(-share, axis=1, kind="stable")
    price = model.penalty * np.log(np.maximum(np.add.reduceat(n, starts), 2))
    best_one = np.argmax(single, axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(starts)), best_one] = 1
    value = single.max(axis=1)
    length = np.diff(np.append(starts, len(n)))
    open_ = np.flatnonzero(full - price > value)
    for size in range(2, k + 1):
        if not len(open_):
            break
        mask = np.zeros((len(open_), k))
        np.put_along_axis(mask, order[open_, :size], 1.0, axis=1)
        pick = np.repeat(starts[open_] - np.concatenate([[0], np.cumsum(length[open_])[:-1]]), length[open_]) + np.arange(length[open_].sum())
        own = np.concatenate([[0], np.cumsum(length[open_])[:-1]])
        first = mask * np.maximum(share[open_], 1e-6)
        fitted, ll = _em(p[pick], n[pick], own, first / first.sum(axis=1, keepdims=True), steps)
        ll = ll - price[open_] * (size - 1)
        better = ll > value[open_]
        chosen[open_[better]] = fitted[better]
        value[open_[better]] = ll[better]
        open_ = open_[full[open_] - price[open_] * size > value[open_]]
    return row[starts], chosen


def _judging(text: str, has_letter: str, out: str, shared):
    fields = [pa.field("lang", pa.string()), pa.field("score", pa.float64()), pa.field("mixture", pa.map_(pa.string(), pa.float64()))]

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        size = max(1 << 16, tb.SLICE_BYTES * 4 // max(4, len(model.languages)))
        common = int(np.argmax(model.prior)) if model.languages else 0
        for batch in batches:
            letters = np.asarray(batch.column(has_letter).fill_null(False))
            lang, score, mixture = [UNDETERMINED] * len(letters), np.zeros(len(letters)), [[]] * len(letters)
            for part in tb.slices(batch.column(text), size) if model.languages else ():
                rows, chosen = infer(*trigrams(part), model)
                best = np.argmax(chosen, axis=1) if len(rows) else rows
                for r, b, share in zip(rows.tolist(), best.tolist(), chosen, strict=True):
                    if letters[part.first + r]:
                        lang[part.first + r] = model.languages[b]
                        score[part.first + r] = min(1.0, share[b])
                        mixture[part.first + r] = [(model.languages[k], float(share[k])) for k in np.flatnonzero(share)]
                for r in np.setdiff1d(np.flatnonzero(letters[part.first : part.first + part.rows]), rows).tolist():
                    lang[part.first + r], score[part.first + r] = model.languages[common], model.prior[common]
            made = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(mixture, fields[2].type)], fields=fields)
            names = [n for n in batch.schema.names if n not in (text, has_letter, out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, out])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, *, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with a struct: lang, its proportion as score, and the whole mixture."""
    spark = docs.sparkSession
    bound_batches(spark)
    lower, letter = "__lower", "__letter"
    rows = docs.withColumn(lower, F.lower(text)).withColumn(letter, F.col(text).rlike(r"\p{L}"))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, kind)])
    return rows.mapInArrow(_judging(lower, letter, out, spark.sparkContext.broadcast(model)), schema)
