"""Licence digests, and token counts from flat files against direct counts."""

import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import license_scan as lic
from weftline.llm.scratch import Scratch
from weftline.llm.token_counts import count_document_tokens, count_tokens

COMMON = "/usr/share/common-licenses"


def test_whole_texts_only(spark):
    mit = next(t for i, t in lic.LICENSES if i == "MIT")
    rows = [(1, mit), (2, "The MIT text:\n" + mit), (3, "Copyright (c) 2020 Someone Else\nAll rights reserved.\n\n" + mit.upper().replace("\"", "“").replace(" ", "\n")), (4, None), (5, ""), (6, "  ---  "), (7, "Licenced under the Apache Licence, version 2.0"), (7, mit), (8, "word " * 200_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, license_id string")
    got = sorted((r.doc_id, r.license_id or "", r.license_digest is None) for r in lic.scan_licenses(docs).collect())
    assert got == [(1, "MIT", False), (2, "", False), (3, "MIT", False), (4, "", True), (5, "", False), (6, "", False), (7, "Apache-2.0", False), (7, "MIT", False), (8, "", False)]
    assert lic.scan_licenses(docs.limit(0)).count() == 0


def test_titles_and_bsd(spark):
    text = dict(reversed(lic.LICENSES))
    clause = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    three = text["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", clause + "\n\nTHIS SOFTWARE IS PROVIDED")
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + text["MIT"]), ("MIT", "The MIT License (MIT)\n" + text["MIT"]), ("ISC", "ISC License\n" + text["ISC"]), ("Unlicense", "The Unlicense\n" + text["Unlicense"])]
    rows += [("BSD-3-Clause", three), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + three), ("BSD-2-Clause", text["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* "))]
    rows += [(None, "MIT License"), (None, "ISC License\n" + text["MIT"]), (None, three + " And more.")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert [r.license_id for r in sorted(lic.scan_licenses(docs).collect())] == [i for i, _ in rows]


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="needs the texts of common licences")
def test_long_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    docs = spark.createDataFrame([(k, open(f"{COMMON}/{f}", encoding="utf-8").read()) for k, f in enumerate(names)], "doc_id long, text string")
    assert [r.license_id for r in sorted(lic.scan_licenses(docs).collect())] == list(names.values())


def test_notices(spark):
    docs = spark.createDataFrame([(1, "prose\nReleased under the MIT License.\nmore"), (2, "we released under the MIT license."), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.line, r.license_id) for r in lic.scan_notices(docs).collect()] == [(1, 2, "MIT")]
    words = "|".join(lic.NOTICE_WORDS)
    import re

    assert all(re.search(words, t.lower()) for _, t in lic.LICENSES)
    assert lic.known_licenses(spark).count() == len({t for _, t in lic.LICENSES}) - 0


def test_a_table_of_ones_own(spark):
    known = spark.createDataFrame([("Mine", "my own terms")], "license_id string, t string").select(lic.digest(lic.F.col("t")).alias("license_digest"), "license_id")
    docs = spark.createDataFrame([(1, "My OWN terms!")], "doc_id long, text string")
    assert lic.scan_licenses(docs, known=known).first().license_id == "Mine"


def test_spellings_in_a_row(spark):
    df = spark.createDataFrame([("Licence licence v v  Sub-License, copyright owner",)], "t string")
    assert df.select(lic.canonical(lic.F.col("t"))).first()[0] == "license license version version sublicense copyright holder"


@pytest.mark.parametrize("separator, dtype", [(49407, "<u4"), (0, "<u2")])
def test_counts_with_other_separators_and_widths(spark, separator, dtype):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rows = [(i, "lorem ipsum dolor " * i) for i in range(20)]
    got = count_document_tokens(spark.createDataFrame(rows, "doc_id long, text string"), separator=separator, dtype=dtype, file_ids=50).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(d, len(library.encode(t, add_special_tokens=False).ids)) for d, t in rows]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_blocks_are_stitched(spark, size):
    rng = np.random.default_rng(size)
    rows, want = [], []
    for f in range(4):
        counts = rng.integers(0, 9, 20)
        ids = [i for n in counts for i in [*rng.integers(1, 50, n), 0]] + [5, 6] * (f % 2)
        raw = np.array(ids, "<u2")
        rows += [(f"f{f}", b, bytearray(raw[at : at + size].tobytes())) for b, at in enumerate(range(0, len(raw), size))]
        want += [(f"f{f}", k, int(n), True) for k, n in enumerate(counts)] + [(f"f{f}", 20, 2, False)] * (f % 2)
    blocks = spark.createDataFrame(rows, "file string, block long, payload binary").repartition(5)
    assert sorted(map(tuple, count_tokens(blocks, separator=0).collect())) == sorted(want)


def test_documents_through_flat_files(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rows = [(i, f"Doc {i} " + "lorem ipsum " * (i * 7 % 50)) for i in range(60)] + [(3, "again"), (None, "no id"), (70, None), (71, ""), (72, "a <|endoftext|> inside"), (73, "é" * 20_000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ordinal int").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens) for r in count_document_tokens(docs, file_ids=500).collect()), key=str)
    assert got == sorted(((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert count_document_tokens(docs.limit(0)).count() == 0
    assert Scratch(spark, "x").path


def test_ids_that_files_cannot_hold(spark):
    docs = spark.createDataFrame([(1, "plain words here")], "doc_id long, text string")
    used = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("plain words here", add_special_tokens=False).ids
    assert max(used) > 255 and 0 not in used
    for wrong in ({"dtype": "u1", "separator": 0}, {"separator": used[0]}):
        with pytest.raises(Exception, match="fit the type"):
            count_document_tokens(docs, **wrong).collect()
    several = spark.createDataFrame([(1, "plain words here")] * 5, "file long, text string")
    assert [r.n_tokens for r in count_document_tokens(several, doc_id="file").collect()] == [len(used)] * 5
