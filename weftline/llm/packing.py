"""Packing documents into training sequences: first-fit decreasing in randomised groups.

Documents are dealt to groups by a seeded hash, each group small enough for one
task's memory, so groups are independent and their number grows with the corpus.
Within a group each document is cut into full sequences and a remainder; the
remainders are packed first-fit decreasing, where a tournament tree over the
bins' free room finds the first bin that fits in O(log bins).  Bins that stay
underfull are then topped up by cutting the contents of the emptiest ones, and a
last partial sequence is cut into power-of-two lengths, which need no padding.

Defined results: null text is empty, an empty text is its end id alone; a null
document id stays null; equal rows are packed row by row; an empty table gives
no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textbytes as tb
from weftline.llm.scratch import bound_batches
from weftline.llm.tokens import WordBPE

_SEQUENCES_PER_GROUP = 1 << 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tournament:
    """A complete binary tree over bins; each node holds the largest free room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The leftmost bin with room for `size`, which is taken from it."""
        k, room = 1, self.room
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        bin_ = k - self.leaves
        room[k] -= size
        k //= 2
        while k:
            a, b = room[2 * k], room[2 * k + 1]
            room[k] = a if a > b else b
            k //= 2
        return bin_


Piece = tuple[int, int, int]  # document, start, length


def first_fit_decreasing(items: list[Piece], capacity: int) -> list[list[Piece]]:
    tree = Tournament(len(items), capacity)
    bins: list[list[Piece]] = []
    for item in sorted(items, key=lambda x: -x[2]):
        b = tree.first_fit(item[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(item)
    return bins


def top_up(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Fill underfull bins with cuts of the emptiest; what is left over has power-of-two lengths."""
    fill = [sum(p[2] for p in b) for b in bins]
    full = [b for b, n in zip(bins, fill, strict=True) if n == capacity]
    loose = sorted(((n, b) for b, n in zip(bins, fill, strict=True) if n < capacity), key=lambda x: -x[0])
    i, j = 0, len(loose) - 1
    room = capacity - loose[0][0] if loose else 0
    while i < j:
        donor = loose[j][1]
        doc, start, length = donor.pop()
        take = min(length, room)
        if take < length:
            donor.append((doc, start, length - take))
        loose[i][1].append((doc, start + length - take, take))
        room -= take
        if not room:
            full.append(loose[i][1])
            i += 1
            room = capacity - sum(p[2] for p in loose[i][1])
        if not donor:
            j -= 1
            if i == j:
                room = capacity - sum(p[2] for p in loose[i][1])
    for _, rest in loose[i : i + 1]:
        left = sum(p[2] for p in rest)
        while left:
            size = 1 << left.bit_length() - 1
            one: list[Piece] = []
            while size:
                doc, start, length = rest.pop(0)
                take = min(length, size)
                one.append((doc, start, take))
                if take < length:
                    rest.insert(0, (doc, start + take, length - take))
                size -= take
            full.append(one)
            left = sum(p[2] for p in rest)
    return full


def pack_lengths(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences as lists of pieces (document, start, length) over documents of these lengths."""
    whole = [[(d, k * capacity, capacity)] for d, n in enumerate(lengths) for k in range(n // capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    return whole + top_up(first_fit_decreasing(rest, capacity), capacity)


def _packing(tokenizer: str, end_id: int, capacity: int, group_tokens: int, with_ids: bool):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = WordBPE(tokenizer), np.array([end_id], np.uint32)
        docs: list[tuple[object, np.ndarray]] = []
        group, held, used = None, 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, used
            rows = []
            for s, pieces in enumerate(pack_lengths([len(x) for _, x in docs], capacity)):
                offset = 0
                for d, start, length in pieces:
                    ids = docs[d][1][start : start + length]
                    rows.append((docs[d][0], start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(docs[d][1]), group * _SEQUENCES_PER_GROUP + used + s, offset, ids if with_ids else None))
                    offset += length
                last = s
            used += last + 1 if rows else 0
            docs, held = [], 0
            if rows:
                cols = list(zip(*rows, strict=True))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                arrays = [pa.array(c, pa.int64()) if n != "doc_id" else pa.array(c) for n, c in zip(names, cols, strict=False)]
                if with_ids:
                    arrays, names = [*arrays, pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([a if a.type != pa.null() else a.cast(kind) for a in arrays], names)

        for batch in batches:
            kind = batch.column(0).type
            keys, groups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in tb.slices(batch.column(1)):
                ids, bounds = bpe.encode(part)
                for r in range(part.rows):
                    row = part.first + r
                    if groups[row] != group:
                        yield from emit()
                        group, used = groups[row], 0
                    elif held > group_tokens:
                        yield from emit()
                    docs.append((keys[row], np.concatenate([ids[bounds[r] : bounds[r + 1]], end])))
                    held += len(docs[-1][1])
        yield from emit()

    return run


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    capacity: int = 4096,
    group_bytes: int = 6 << 20,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A group holds about `group_bytes` of text; one that gets far more (equal rows) is packed in several goes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    mixed = F.xxhash64(F.lit(seed), "doc_id", F.octet_length("text"))
    dealt = rows.select("doc_id", "text", F.pmod(mixed, F.lit(groups)).alias("grp"), mixed.alias("h")).repartition("grp").sortWithinPartitions("grp", "h", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return dealt.select("doc_id", "text", "grp").mapInArrow(_packing(tokenizer or default_tokenizer(), end_id, capacity, group_bytes, with_ids), schema)
