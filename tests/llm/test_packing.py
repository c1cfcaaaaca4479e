"""Packing against the tokenizer library and an independent check of every piece."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from weftline.llm import textbytes
from weftline.llm.packing import Tournament, pack, pack_lengths
from weftline.llm.tokens import WordBPE

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"aAbBzZ  \n\t'’s<|>0123-_.,É×÷ßÿéÀ́ \u0085\xa0ªº²中文あ😀İΣς\x1c\x00", "<|endoftext|>", "don't", " the "]


def test_ids_equal_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "x" * 500, None]
    for as_text in (False, True):
        bpe = WordBPE(PATH, special_as_text=as_text, cache=500)
        library = Tokenizer.from_file(PATH)
        library.encode_special_tokens = as_text
        for part in textbytes.slices(pa.array(texts), 4000):
            ids, bounds = bpe.encode(part)
            for r in range(part.rows):
                assert ids[bounds[r] : bounds[r + 1]].tolist() == library.encode(texts[part.first + r] or "", add_special_tokens=False).ids


def test_tournament_is_first_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    tree, rooms = Tournament(len(sizes), 64), [64] * len(sizes)
    for n in sizes:
        want = next(i for i, r in enumerate(rooms) if r >= n)
        rooms[want] -= n
        assert tree.first_fit(n) == want


def test_lengths_are_covered_without_padding():
    rng = random.Random(4)
    for lengths in ([], [1], [4096], [4097, 3], [rng.randint(1, 9000) for _ in range(400)]):
        seen = defaultdict(list)
        for pieces in pack_lengths(lengths, 4096):
            n = sum(p[2] for p in pieces)
            assert n == 4096 or n & (n - 1) == 0
            for d, start, length in pieces:
                seen[d].append((start, length))
        for d, n in enumerate(lengths):
            at = 0
            for start, length in sorted(seen[d]):
                assert start == at and length > 0
                at += length
            assert at == n


def test_pieces_of_awkward_rows(spark):
    rows = [(1, "Hello, world", 9), (1, "Hello, world", 9), (None, None, 1), (4, "", 2), (5, "lorem 123 ipsum " * 4000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    library = Tokenizer.from_file(PATH)
    found = pack(docs, with_ids=True).collect()
    by_sequence = defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    long_one = sorted((r for r in found if r.doc_id == 5), key=lambda r: r.start)
    assert [i for r in long_one for i in r.ids] == [*library.encode(rows[4][1], add_special_tokens=False).ids, 2]
    assert sum(r.length for r in found if r.doc_id is None) == 1
    assert sum(r.length for r in found if r.doc_id == 1) == 2 * (len(library.encode("Hello, world", add_special_tokens=False).ids) + 1)
    assert pack(docs.limit(0)).count() == 0
