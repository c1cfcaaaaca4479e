"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item is a set of windows: every run of `window` consecutive words,
or all its words where it has fewer.  A document holds a window when the same
words stand next to each other in it.  The join

1. counts, over all documents, how often each short shingle of the items occurs
   (only the items' shingles are counted, so the table has their size);
2. orders the shingles of each window by rarity.  Exact containment needs all of
   a window's shingles, so a prefix of one, the rarest, is necessary;
3. looks up every document shingle among these prefix tokens;
4. bounds each match by position and length: the window must start at the
   matched place less the token's offset and end inside the document;
5. verifies the survivors word for word (each word by its 64-bit hash).

Items are taken in blocks of about `block_words` words (an item stays whole), each
block broadcast for one pass over the documents.  A word is a window at most, so
what the driver builds and broadcasts has a bound.  With several blocks, documents
are numbered and written once; each block's hits are written and its broadcast
destroyed before the next one, so a task never holds more than one index, and the
hits of all blocks are joined to the documents by their numbers at the end.

Defined results: a null or empty text has no words, no spans, no items; items
without words or without an id are left out; repeated document rows are judged
row by row; repeated items count once per id; an existing column with the output
column's name is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import textbytes as tb
from weftline.llm.scratch import Scratch, bound_batches

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FILTER_BITS = 20
#: For counting; the words themselves are found by bytes.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _word_hashes(part: tb.TextSlice) -> tuple[np.ndarray, np.ndarray]:
    tb.lower_ascii(part.data)
    found = tb.find_words(part, tb.WORD_CHARS)
    return tb.span_hashes(part.data, found.starts, found.ends), found.row_offsets


class _Lookup:
    """Positions of given hashes in an array of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted, distinct
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `hashes` a key stands, and which key."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == hashes[at]
        return at[same], k[same]


class _Windows:
    """The distinct windows of a block of items, with the ids of the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.shingle = shingle
        order: dict[bytes, int] = {}
        self.hashes: list[np.ndarray] = []
        holders: dict[int, set[str]] = defaultdict(set)
        texts = pa.array([t for _, t in items], pa.string())
        for part in tb.slices(texts):
            words, bounds = _word_hashes(part)
            for r in range(part.rows):
                own = words[bounds[r] : bounds[r + 1]]
                size = min(window, len(own))
                for i in range(len(own) - size + 1) if size else ():
                    one = own[i : i + size]
                    k = order.setdefault(one.tobytes(), len(order))
                    if k == len(self.hashes):
                        self.hashes.append(one.copy())
                    holders[k].add(items[part.first + r][0])
        self.items = [sorted(holders[k]) for k in range(len(self.hashes))]

    def shingles(self, k: int) -> np.ndarray:
        own = self.hashes[k]
        return tb.window_hashes(own, min(self.shingle, len(own)))

    def sizes(self) -> list[int]:
        return sorted({min(self.shingle, len(h)) for h in self.hashes})

    def tokens(self) -> np.ndarray:
        """All shingles of all windows, sorted."""
        each = [self.shingles(k) for k in range(len(self.hashes))]
        return np.unique(np.concatenate(each)) if each else np.empty(0, np.uint64)

    def prefix_index(self, tokens: np.ndarray, counts: np.ndarray) -> dict:
        """The rarest shingle of each window: token -> (window, offset in it)."""
        entries = defaultdict(list)
        for k in range(len(self.hashes)):
            own = self.shingles(k)
            n = counts[np.searchsorted(tokens, own)]
            j = int(np.lexsort((own, n))[0])
            entries[int(own[j])].append((k, j))
        keys = np.array(sorted(entries), np.uint64)
        flat = [e for key in keys.tolist() for e in entries[key]]
        starts = np.concatenate([[0], np.cumsum([len(h) for h in self.hashes])]).astype(np.int64)
        return {
            "keys": keys,
            "ends": np.cumsum([len(entries[key]) for key in keys.tolist()]).astype(np.int64),
            "window": np.array([k for k, _ in flat], np.int64),
            "offset": np.array([j for _, j in flat], np.int64),
            "words": np.concatenate(self.hashes) if self.hashes else np.empty(0, np.uint64),
            "starts": starts,
            "items": self.items,
            "sizes": self.sizes(),
        }


def _counting(column: str, tokens: np.ndarray, sizes: list[int]):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = _Lookup(tokens), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in tb.slices(batch.column(column)):
                words, bounds = _word_hashes(part)
                for size in sizes:
                    at, k = look.find(tb.window_hashes(words, size))
                    row = np.searchsorted(bounds, at, "right")
                    total += np.bincount(k[at + size <= bounds[np.minimum(row, len(bounds) - 1)]], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["token", "n"])

    return run


def _matches(words: np.ndarray, bounds: np.ndarray, look: _Lookup, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: first word (in the slice) and window."""
    begins, wins = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends, starts = index["ends"], index["starts"]
    for size in index["sizes"]:
        at, k = look.find(tb.window_hashes(words, size))
        if not len(at):
            continue
        lo = np.where(k > 0, ends[k - 1], 0)
        n = ends[k] - lo
        each = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(each))
        win = index["window"][entry]
        begin = at[each] - index["offset"][entry]
        length = starts[win + 1] - starts[win]
        row = np.searchsorted(bounds, at[each], "right") - 1
        fits = (begin >= bounds[row]) & (begin + length <= bounds[row + 1]) & (np.minimum(length, size) == size)
        begin, win, length = begin[fits], win[fits], length[fits]
        same = np.ones(len(begin), bool)
        for j in range(int(length.max()) if len(length) else 0):
            live = np.flatnonzero(same & (length > j))
            same[live] = words[begin[live] + j] == index["words"][starts[win[live]] + j]
        begins.append(begin[same])
        wins.append(win[same])
    return np.concatenate(begins), np.concatenate(wins)


def _judge(part: tb.TextSlice, look: _Lookup, index: dict) -> pa.Array:
    words, bounds = _word_hashes(part)
    begin, win = _matches(words, bounds, look, index)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + index["starts"][win + 1] - index["starts"][win], -1)
    row_of = np.searchsorted(bounds, begin, "right") - 1
    found: dict[int, set[str]] = defaultdict(set)
    for r, w in set(zip(row_of.tolist(), win.tolist(), strict=True)):
        found[r].update(index["items"][w])
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(hit)
    if len(edge):
        row = np.searchsorted(bounds, edge, "right") - 1
        new = np.ones(len(edge), bool)
        new[1:] = (np.diff(edge) > 1) | (np.diff(row) > 0)
        first, past = edge[new], edge[np.append(np.flatnonzero(new)[1:] - 1, len(edge) - 1)] + 1
        span_row = row[new]
    else:
        first = past = span_row = np.empty(0, np.int64)
    base = bounds[span_row]
    spans = pa.StructArray.from_arrays([pa.array(first - base), pa.array(past - base)], ["first", "past"])
    per_row = np.concatenate([[0], np.cumsum(np.bincount(span_row, minlength=part.rows))]).astype(np.int32)
    items = pa.array([sorted(found[r]) if r in found else [] for r in range(part.rows)], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), pa.ListArray.from_arrays(per_row, spans), items], fields=list(_ARROW))


def _judging(column: str, out: str, shared):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        look = _Lookup(index["keys"])
        for batch in batches:
            parts = [_judge(p, look, index) for p in tb.slices(batch.column(column))]
            names = [n for n in batch.schema.names if n != out]
            result = pa.concat_arrays(parts) if parts else pa.array([], _ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), result], [*names, out])

    return run


def add_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "contamination",
    window: int = 10,
    shingle: int = 3,
    block_words: int = 400_000,
) -> DataFrame:
    """`docs` with a column `out`: words, hit spans (in words) and the items whose windows occur.

    See the module's docstring for the method and for nulls, empty texts and ties.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = kept.agg(F.sum(F.regexp_count(F.lower("t"), F.lit(_WORD)) + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    df = docs.drop(out) if out in docs.columns else docs
    only = docs.select(F.col(text).alias("t"))

    def index(b: int):
        rows = kept.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        windows = _Windows([(r["i"], r["t"]) for r in rows], window, shingle)
        tokens = windows.tokens()
        counts = np.zeros(len(tokens), np.int64)
        if len(tokens):
            seen = only.mapInArrow(_counting("t", tokens, windows.sizes()), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
            for r in seen:
                counts[r["token"]] = r["n"]
        return spark.sparkContext.broadcast(windows.prefix_index(tokens, counts))

    def judged(rows: DataFrame, shared) -> DataFrame:
        schema = T.StructType([f for f in rows.schema.fields if f.name != out] + [T.StructField(out, RESULT)])
        return rows.mapInArrow(_judging(text, out, shared), schema)

    if blocks == 1:
        return judged(df, index(0))
    # one index at a time on driver and executors: each block's hits are written before the next block is built
    scratch = Scratch(spark, "windows")
    row = "__row" + "_" * max(map(len, df.columns))  # longer than any name there is
    shared = index(0)
    first = scratch.save(judged(df.withColumn(row, F.monotonically_increasing_id()), shared), "hits-0")
    found = [first.select(row, out)]
    only = first.select(F.col(text).alias("t"))
    for b in range(1, blocks):
        shared.destroy()
        shared = index(b)
        hits = judged(first.select(row, text), shared).where(F.size(f"{out}.items") > 0)
        found.append(scratch.save(hits.select(row, out), f"hits-{b}"))
    shared.destroy()
    return _with_all_hits(first, reduce(DataFrame.union, found).where(F.size(f"{out}.items") > 0), row, out)


def _with_all_hits(docs: DataFrame, hits: DataFrame, row: str, out: str) -> DataFrame:
    """`docs` with the hits of all blocks in `out`: spans that overlap or touch are one, items are distinct."""
    spans = hits.select(row, F.explode(f"{out}.spans").alias("s")).select(row, "s.first", "s.past")
    order = Window.partitionBy(row).orderBy("first", "past")
    spans = spans.withColumn("reached", F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum((F.col("first") > F.coalesce("reached", F.lit(-1))).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy(row, "run").agg(F.min("first").alias("first"), F.max("past").alias("past"))
    runs = runs.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("spans"))
    items = hits.select(row, F.explode(f"{out}.items").alias("i")).groupBy(row).agg(F.sort_array(F.collect_set("i")).alias("items"))
    every = runs.join(items, row).select(row, F.struct("spans", "items").alias(f"{row}_"))
    made = F.struct(F.col(f"{out}.n_words"), F.coalesce(F.col(f"{row}_.spans"), F.array().cast(RESULT["spans"].dataType)).alias("spans"), F.coalesce(F.col(f"{row}_.items"), F.array().cast(RESULT["items"].dataType)).alias("items"))
    return docs.join(every, row, "left").withColumn(out, made.cast(RESULT)).drop(row, f"{row}_")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any item occurs, with the columns of `docs`."""
    out = "__contamination"
    return add_contamination(docs, items, out=out, **options).where(F.size(f"{out}.items") == 0).drop(out)
