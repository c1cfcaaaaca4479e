"""A raw tree on disk through audit and prepare."""

import csv

import pytest
from pyspark.sql import functions as F

from weftline.plans import ingest
from weftline.sources import raw

POSTS = ["id", "bid", "正文", "位置", "日期", "点赞数", "评论数", "转发数", "完整日期"]


def _write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture
def tree(tmp_path):
    _write(tmp_path / "control/users.csv", ["用户id", "x"], [["100", ""], ["101", ""]])
    _write(tmp_path / "positive/users.csv", ["用户id", "x"], [["200", ""], ["201", ""]])
    for g, u in (("control", "100"), ("control", "101"), ("positive", "200")):
        rows = [["731", "b", "晚饭后练了banjo", "河边", "", "13", "0", "6", "2021-09-08 17:16:15"]]
        if u == "200":
            rows += [["731", "b", "晚饭后\n又练banjo", "河边", "", "9", "8", "5", "2021-09-08 17:16:15"], ["", "b", "no id", "", "", "", "", "", ""], ["732", "b", "later", "", "nonsense", "x", "", "", ""]]
        _write(tmp_path / g / u / f"{u}.csv", POSTS, rows)
        for name in ("pre_731_2.JPG", "odd.png", "pre_5.jpg"):
            p = tmp_path / g / u / "img/original" / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x")
    return str(tmp_path)


def _tables(spark, root):
    parts = {k: [] for k in ("users", "posts", "files", "media")}
    for g in ("control", "positive"):
        parts["users"].append(raw.read_users(spark, root, g))
        parts["posts"].append(raw.read_posts(spark, root, g))
        files = raw.read_files(spark, root, g)
        parts["files"].append(files)
        parts["media"].append(raw.read_media(files, ["img/original"], "live"))
    return ingest.RawTables(**{k: a.unionByName(b) for k, (a, b) in parts.items()})


def test_prepare(spark, tree):
    p = ingest.prepare(_tables(spark, tree), b"key", {"control": ("control", 0), "positive": ("positive", 1)}, ["banjo"])
    subjects = p.subjects.collect()
    assert sorted((r.source_group, r.label_id, r.eligible, r.exclusion_reason, r.post_count, r.media_count) for r in subjects) == [
        ("control", 0, True, None, 1, 3), ("control", 0, True, None, 1, 3), ("positive", 1, False, "missing_user_directory", 0, 0), ("positive", 1, True, None, 2, 3),
    ]
    posts = {r.cleaned_text: r for r in p.posts.collect() if r.likes == 9 or r.cleaned_text == "later"}
    kept = posts["晚饭后\n又练banjo"]
    assert kept.likes == 9 and kept.contains_study_keyword and len(kept.metadata_vector) == 5 and kept.subject_id.startswith("subject-")
    assert posts["later"].published_at is None and posts["later"].likes == 0
    media = p.media.collect()
    assert {r.extension for r in media if r.post_id} == {".jpg"}
    assert sum(r.post_id is not None for r in media) == 3 and not any("731" in str(r) for r in media)
    c = {r.source_group: r for r in p.counters.collect()}
    assert (c["positive"].posts_duplicate_rows_dropped, c["positive"].posts_conflicting_duplicate_rows, c["positive"].posts_missing_sid) == (1, 1, 1)
    assert (c["positive"].excluded_missing_user_directory, c["control"].media_unparseable, c["control"].media_unmatched) == (1, 2, 2)
    ids = {len(r.posts): r for r in p.identities.where("source_group = 'positive'").collect()}
    assert {x.raw_post_id for x in ids[2].posts} == {"731", "732"}


def test_audit(spark, tree):
    a = {r.source_group: r for r in ingest.audit(_tables(spark, tree)).collect()}
    pos, con = a["positive"], a["control"]
    assert (pos.unique_listed_users, pos.user_directories, pos.listed_without_directory, pos.duplicate_post_ids, pos.subjects_with_duplicate_post_ids, pos.conflicting_duplicate_post_ids) == (2, 1, 1, 1, 1, 1)
    assert (pos.post_rows, pos.unique_post_ids, pos.missing_post_ids, pos.invalid_dates) == (4, 2, 1, 1)
    assert (con.post_rows, con.unique_post_ids, con.post_ids_shared_between_subjects, con.duplicate_post_ids) == (2, 1, 1, 1)
    assert (con.media_files, con.image_files, con.media_without_parseable_post_id, con.media_without_matching_post) == (6, 6, 2, 2)
    assert con.media_extensions == {".jpg": 4, ".png": 2}


def test_repeated_listing_is_an_error(spark, tree):
    t = _tables(spark, tree)
    with pytest.raises(ValueError, match="more than once"):
        ingest.prepare(ingest.RawTables(t.users.unionByName(t.users), t.posts, t.files, t.media), b"k", {}, [])


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    raw.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        raw.write_table(df, str(tmp_path / "t"))
    raw.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(raw.read_jsonl(spark, str(tmp_path / "j"), "k long, v string").collect(), key=lambda r: r.k) == sorted(df.collect(), key=lambda r: r.k)
    (tmp_path / "bad.jsonl").write_text("[1]\nnot json\n")
    with pytest.raises(Exception):
        raw.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k long").select(F.count("k")).collect()
