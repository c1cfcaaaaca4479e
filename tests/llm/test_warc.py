"""ARC parsing, conversion, and the whole round trip against digests taken directly."""

import base64
import gzip
import hashlib
import random
import time

import pytest

from weftline.llm.warc import convert, convert_arc_folder, read_arc, read_warc, round_trip, warc_bytes, write_arc


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\n\n</html>", b"", b"dns answer\n", b"\n\n\n"]
    urls = ["http://a.example/x y", None, "dns:a.example", "ftp://b.example/\n"]
    data = write_arc(version, "t.arc", [(u, "10.0.0.1", "20080430204825", "text/html; charset=x", b) for u, b in zip(urls, bodies)])
    about, *records = read_arc(data)
    assert about.url == "filedesc://t.arc" and [r.body for r in records] == bodies and {r.version for r in records} == {version}
    assert records[0].url == "http://a.example/x%20y" and records[1].url == "-" and records[0].content_type == "text/html; charset=x"
    warc = [convert(r, "t.arc") for r in (about, *records)]
    assert [w.headers["WARC-Type"] for w in warc] == ["warcinfo", "response", "resource", "response", "resource"]
    assert warc[1].headers["WARC-Date"] == "2008-04-30T20:48:25Z"
    assert warc[1].headers["WARC-Payload-Digest"] == "sha1:" + _b32(b"<html>\n\n</html>")
    assert len({w.headers["WARC-Record-ID"] for w in warc}) == 5
    again = list(read_warc(b"".join(map(warc_bytes, warc))))
    assert [(w.headers, w.block) for w in again] == [(w.headers, w.block) for w in warc]


def test_reading_is_linear():
    rng = random.Random(5)
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(2000) for _ in range(20_000)] + [b"x" * 3_000_000]
    records = [convert(r, "t.arc") for r in read_arc(write_arc(1, "t.arc", [("http://a/", "0.0.0.0", "20240101000000", "text/html", b) for b in bodies]))]
    data = b"".join(warc_bytes(r, 1) for r in records)
    started = time.monotonic()
    assert [r.block for r in read_warc(data)] == [r.block for r in records]
    assert len(data) > 40_000_000 and time.monotonic() - started < 20  # in the square of its size it took minutes
    with pytest.raises(ValueError, match="cut off"):
        list(read_warc(data[:-5]))


def test_damage_is_noticed():
    data = write_arc(1, "t.arc", [("http://a", "1.1.1.1", "20080430204825", "text/plain", b"0123456789")])
    assert list(read_arc(data[:-6]))[-1].truncated
    with pytest.raises(ValueError):
        list(read_arc(b"http://a 1.1.1.1 20080430204825 text/plain 3\nabc\n"))


def test_pages_with_copies_nulls_and_repeats(spark):
    rows = [(1, "http://a/", "same"), (7, "http://b/", "same"), (3, None, "same"), (4, "http://c/", None), (5, "x", ""), (9, "y y\n", "é long\r\n\r\n" * 9000), (9, "y", "other"), (7, "http://b/", "same"), (None, "z", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(pages).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = max(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        own = i == keeper
        want.append((i or 0, len(data), _b32(data), "response" if own else "revisit", None if own else keeper))
    assert got == sorted(want)
    assert round_trip(pages.limit(0)).count() == 0
    big = round_trip(pages, min_revisit_bytes=5).where("payload_bytes < 5")
    assert {r.record_type for r in big.collect()} == {"response"}


def test_folder_of_archives(spark, tmp_path):
    def records(name):
        return [(f"http://{name}/{i}", "10.0.0.1", "20010203040506", "text/html", f"HTTP/1.0 200 OK\r\n\r\n{name} {i}".encode() * (1 + i)) for i in range(5)]

    arcs = tmp_path / "arcs"
    (arcs / "deep").mkdir(parents=True)
    plain = write_arc(1, "a.arc", records("a"))
    (arcs / "a.arc").write_bytes(plain)
    (arcs / "deep" / "a.arc").write_bytes(write_arc(2, "a.arc", records("deep")))
    # one gzip member a record, as crawlers write them
    whole = write_arc(2, "b.arc", records("b"))
    cuts = [r.offset for r in read_arc(whole)] + [len(whole)]
    members = [gzip.compress(whole[a:b]) for a, b in zip([0, *cuts[1:]], cuts[1:])]
    (arcs / "b.arc.gz").write_bytes(b"".join(members))
    (arcs / "cut.arc.gz").write_bytes(b"".join(members)[:-30])
    (arcs / "bad.arc").write_bytes(plain + b"no header here\n")
    (arcs / "empty.arc").write_bytes(b"")
    (arcs / "other.txt").write_bytes(b"not an archive")
    out = tmp_path / "out"
    for _ in range(2):  # again writes the same files
        made = convert_arc_folder(spark, str(arcs), f"file://{out}", file_bytes=200).collect()
    assert {r.source.rpartition("/")[2] for r in made if r.error} == {"cut.arc.gz", "bad.arc"}
    assert sorted(str(p) for p in out.iterdir()) == sorted(r.file for r in made if r.file)
    got = {}
    for r in made:
        if r.file:
            with open(r.file, "rb") as f:
                found = list(read_warc(f.read()))
            assert len(found) == r.records
            got.setdefault(r.source.partition("/arcs/")[2], []).extend(found)
    for name, label in (("a.arc", "a"), ("deep/a.arc", "deep"), ("b.arc.gz", "b"), ("bad.arc", "a")):
        about, *rest = got[name]
        assert about.headers["WARC-Type"] == "warcinfo"
        assert [(w.headers["WARC-Target-URI"], w.block) for w in rest] == [(u, b) for u, _, _, _, b in records(label)]
    assert [w.headers["WARC-Target-URI"] for w in got["cut.arc.gz"][1:]] == [f"http://b/{i}" for i in range(4)]
    ids = [w.headers["WARC-Record-ID"] for found in got.values() for w in found]
    assert len(set(ids)) == len(ids)
