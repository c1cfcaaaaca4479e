"""Collocations: frequent phrases per language by growing contiguous patterns from frequent prefixes.

1. Words are counted per language; every occurrence counts.  A word of a language is known by a 64-bit key; that no
   frequent word shares its key with another word is checked, and otherwise all is done anew with other keys.
2. Pairs of frequent words are counted by a key of the pair, which decides only where a phrase can't go on.
3. Every place where a frequent pair starts becomes an occurrence pointer: the keys of its words as far as all pairs
   are frequent, `longest` words at most.  Equal pointers of a task are one row with a count.
4. Pointers are dealt to tasks by ranges of their words, so a prefix's pointers lie together.  A task grows its
   prefixes to the right, depth first: the pointers of a prefix, sorted, are the runs of its extensions.  A prefix at
   the end of a range may go on in the next task: its counts are sent even when small and added up.  So a hot prefix
   is split over as many tasks as its pointers need, and no group is gathered.
5. Frequent phrases are joined with the two parts of each cut, scored in decimals of 38 digits, and dropped where a
   phrase one word longer is as frequent.

The bit tables that prune (which words, which pairs) are broadcast with 2**27 bits at most; they let false ones
through, never hold true ones back, and counts decide in the end.

Defined results: null and empty texts have no words; a null language is `und`; texts of any length are read whole;
repeated rows count each; ties in rank go to the phrase's byte order; an empty table gives no rows; other columns of
the table aren't read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import textbytes as tb
from weftline.llm.scratch import Scratch

LONGEST, LEAST, TOP = 5, 100, 2000
#: Distinct words, pairs or pointers that a task holds before it sends what it has counted.
HELD = 400_000
#: Pointers of a task that grows phrases.
POINTERS = 1 << 19
_MAX_BITS = 27
_U64 = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """For each slice of (text, lang): bytes, words, their keys (int64), the row of each, and whether the next word is in the same piece."""
    langs = batch.column(1).dictionary_encode()
    salts = np.array([hash_name(v.as_py(), seed) for v in langs.dictionary], _U64)
    salt = salts[langs.indices.to_numpy()] if len(langs) else np.empty(0, _U64)
    for part in tb.slices(batch.column(0)):
        tb.lower_ascii(part.data)
        found = tb.find_words(part, _WORD)
        row = np.repeat(np.arange(part.rows), np.diff(found.row_offsets))
        key = tb.mix64(tb.span_hashes(part.data, found.starts, found.ends) ^ salt[part.first + row]).view(np.int64)
        breaks = np.cumsum(_BREAK[part.data], dtype=np.int64)
        joined = np.zeros(len(key), bool)
        if len(key) > 1:
            joined[:-1] = (breaks[found.starts[1:]] == breaks[found.starts[:-1]]) & (row[1:] == row[:-1])
        yield part, found, key, part.first + row, joined


def hash_name(name: str, seed: int) -> int:
    """A 64-bit salt of a language's name; the same in every process."""
    data = np.frombuffer(f"{seed}:{name}".encode(), np.uint8)
    return int(tb.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _grouped(tables: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(by, use_threads=False).aggregate([("n", "sum")]).rename_columns([*by, "n"])


class _Counter:
    """Rows with counts, merged now and then; what doesn't merge is sent."""

    def __init__(self, by: list[str]):
        self.by, self.held, self.rows = by, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(table)
        self.rows += len(table)
        if self.rows > 2 * HELD:
            self.held = [_grouped(self.held, self.by)]
            self.rows = len(self.held[0])
            if self.rows > HELD:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from _grouped(self.held, self.by).to_batches(1 << 16)
        self.held, self.rows = [], 0


def _count_words(seed: int):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(["key", "lang", "word"])
        for batch in batches:
            for part, found, key, row, _ in _words(batch, seed):
                if not len(key):
                    continue
                own, first, n = np.unique(key, return_index=True, return_counts=True)
                size = found.ends[first] - found.starts[first]
                ends = np.cumsum(size)
                at = np.repeat(found.starts[first] - (ends - size), size) + np.arange(ends[-1])
                surface = pa.StringArray.from_buffers(len(own), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(part.data[at].tobytes()))
                lang = batch.column(1).take(pa.array(row[first]))
                yield from counter.add(pa.table([pa.array(own), lang, surface, pa.array(n.astype(np.int64))], ["key", "lang", "word", "n"]))
        yield from counter.send()

    return run


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (tb.mix64(key.view(_U64)) >> _U64(64 - bits)).astype(np.int64)


def _holds(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = _slot(key, int(table.nbytes * 8).bit_length() - 1)
    return (table[slot >> 6] >> (slot & 63).astype(_U64)) & _U64(1) != 0


def _setting(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) >> 6, _U64)
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(table, slot >> 6, _U64(1) << (slot & 63).astype(_U64))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["at", "bits"])

    return run


def bit_table(keys: DataFrame) -> np.ndarray:
    """A table of one bit a key (a single long column), 16 times as many as there are keys, 2**27 at most: 16 MB."""
    bits = min(_MAX_BITS, max(16, int(16 * keys.count()).bit_length()))
    found = keys.mapInArrow(_setting(bits), "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros((1 << bits) >> 6, _U64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(_U64)
    return table


def _pairs(key: np.ndarray, joined: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of words that both may be frequent, and a key of each."""
    known = _holds(words, key)
    at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:]) if len(key) else np.empty(0, np.int64)
    return at, tb.mix64(key[at].view(_U64) * _U64(0xD1342543DE82EF95) + key[at + 1].view(_U64)).view(np.int64) if len(at) else np.empty(0, np.int64)


def _count_pairs(seed: int, words):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(["key"])
        for batch in batches:
            for _, _, key, _, joined in _words(batch, seed):
                own, n = np.unique(_pairs(key, joined, words.value)[1], return_counts=True)
                yield from counter.add(pa.table([pa.array(own), pa.array(n.astype(np.int64))], ["key", "n"]))
        yield from counter.send()

    return run


def _point(seed: int, words, pairs, longest: int):
    names = [f"w{k}" for k in range(longest)]

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(names)
        for batch in batches:
            for _, _, key, _, joined in _words(batch, seed):
                at, pair = _pairs(key, joined, words.value)
                go = np.zeros(len(key) + longest, bool)
                go[at[_holds(pairs.value, pair)]] = True
                at = np.flatnonzero(go)
                if not len(at):
                    continue
                padded = np.append(key, np.zeros(longest, np.int64))
                on, columns = np.ones(len(at), bool), [padded[at]]
                for k in range(1, longest):
                    on &= go[at + k - 1]
                    columns.append(np.where(on, padded[at + k], 0))
                table = pa.table([*map(pa.array, columns), pa.array(np.ones(len(at), np.int64))], [*names, "n"])
                yield from counter.add(_grouped([table], names))
        yield from counter.send()

    return run


def grow(words: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """(phrase, occurrences) of two words and more from sorted pointers (rows x words, 0 past the end) with counts, depth first.

    Phrases with fewer than `least` occurrences are given only if the first or last pointer has them, as others may be elsewhere.
    """
    total = np.append(0, np.cumsum(n))
    last = len(words) - 1

    def extend(low: int, high: int, depth: int, prefix: list[int]) -> Iterator[tuple[list[int], int]]:
        column = words[low:high, depth]
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [high - low]]) + low
        size = total[edges[1:]] - total[edges[:-1]]
        grows = (size >= least) | (edges[:-1] == 0) | (edges[1:] == last + 1)
        for k in np.flatnonzero(grows & (words[edges[:-1], depth] != 0)).tolist():
            phrase = [*prefix, int(words[edges[k], depth])]
            if depth:
                yield phrase, int(size[k])
            if depth + 1 < words.shape[1]:
                yield from extend(int(edges[k]), int(edges[k + 1]), depth + 1, phrase)

    if len(words):
        yield from extend(0, len(words), 0, [])


def _growing(least: int):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        *words, n = (c.to_numpy() for c in table.columns)
        phrases, counts = [], []
        for phrase, count in grow(np.stack(words, axis=1), n, least):
            phrases.append(phrase)
            counts.append(count)
            if len(counts) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["phrase", "n"])
                phrases, counts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["phrase", "n"])

    return run


def _words_of(texts: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(key, lang, word, n) of all words, written, and the seed under which no frequent word shares its key."""
    for seed in range(16):
        sent = texts.mapInArrow(_count_words(seed), "key bigint, lang string, word string, n bigint")
        words = scratch.save(sent.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), f"words-{seed}")
        shared = words.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("most")).where((F.col("c") > 1) & (F.col("most") >= least))
        if not shared.limit(1).count():
            return words, seed
        scratch.drop(f"words-{seed}")
    raise ArithmeticError("words share keys under every seed")


def frequent_phrases(docs: DataFrame, scratch: Scratch, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(key, lang, word, n) of all words and (phrase: array of keys, n) of all phrases of 2 to `longest` words with at least `least` occurrences, both written."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    context = docs.sparkSession.sparkContext
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("g"))
    words, seed = _words_of(texts, least, scratch)
    held = context.broadcast(bit_table(words.where(F.col("n") >= least).select("key")))
    counted = texts.mapInArrow(_count_pairs(seed, held), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = context.broadcast(bit_table(scratch.save(counted.where(F.col("n") >= least).select("key"), "pairs")))
    names = [f"w{k}" for k in range(longest)]
    pointers = scratch.save(texts.mapInArrow(_point(seed, held, pairs, longest), ", ".join(f"{w} bigint" for w in names) + ", n bigint"), "pointers")
    scratch.reclaim()
    dealt = pointers.repartitionByRange(max(1, -(-pointers.count() // POINTERS)), *names).sortWithinPartitions(*names)
    grown = dealt.mapInArrow(_growing(least), "phrase array<bigint>, n bigint")
    phrases = scratch.save(grown.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    scratch.drop("pointers", "pairs")
    return words, phrases


def _exact(value: Column, digits: int) -> Column:
    return value.cast(f"decimal({digits},0)")


def scored(words: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """(phrase, lang, a, l, r, n, score, cut): every phrase with its worst cut; n are the words of its language."""
    ones = words.where(F.col("n") >= least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("all_words"))
    counts = phrases.unionByName(ones.select(F.array("key").alias("phrase"), "n"))
    of = phrases.withColumn("key", F.col("phrase")[0]).join(ones.select("key", "lang"), "key").join(totals, "lang").select("phrase", "lang", F.col("n").alias("a"), F.col("all_words").alias("n"))
    cuts = of.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("cut"))).withColumn("right", F.slice("phrase", F.col("cut") + 1, F.size("phrase") - F.col("cut")))
    cuts = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("phrase").alias("right"), F.col("n").alias("r")), "right")
    above = _exact(F.col("a"), 18) * _exact(_exact(F.col("n"), 16) * F.lit(1000), 19)
    cuts = cuts.withColumn("above", above).withColumn("below", _exact(F.col("l"), 18) * _exact(F.col("r"), 19)).withColumn("score", F.expr("above div below"))
    worst = F.min(F.struct("score", "cut", "l", "r")).alias("worst")
    return cuts.groupBy("phrase", "lang", "a", "n").agg(worst).select("phrase", "lang", "a", "n", "worst.*")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    scratch = Scratch(docs.sparkSession, "collocations")
    words, phrases = frequent_phrases(docs, scratch, text=text, lang=lang, least=least, longest=longest)
    inner = F.array(F.slice("phrase", F.lit(1), F.size("phrase") - 1), F.slice("phrase", F.lit(2), F.size("phrase") - 1))
    longer = phrases.where(F.size("phrase") > 2).select(F.explode(inner).alias("phrase"), "n").groupBy("phrase").agg(F.max("n").alias("__longer"))
    own = scored(words, phrases, least).join(longer, "phrase", "left").where("__longer IS NULL OR __longer < a").drop("__longer")
    # all that can be among the first, ties in full, before words are looked up
    best = own.withColumn("__place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("__place") <= top).drop("__place", "cut")
    best = scratch.save(best, "best")
    spelt = best.select("phrase", F.posexplode("phrase").alias("at", "key")).join(words.where(F.col("n") >= least).select("key", "word"), "key")
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("said"))
    out = best.join(spelt, "phrase").drop("phrase").withColumnRenamed("said", "phrase")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
