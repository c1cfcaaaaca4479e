"""A study on disk through all commands."""

import csv
import json
import random

import pytest

from weftline import cli
from weftline.plans import store

POSTS = ["id", "bid", "正文", "位置", "日期", "点赞数", "评论数", "转发数", "完整日期"]
USERS = 14


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    base, draw = tmp_path_factory.mktemp("study"), random.Random(2)
    for g, word in (("control", "tea"), ("positive", "rain")):
        own = [f"{'1' if g == 'control' else '2'}{k:02d}" for k in range(USERS)]
        path = base / "raw" / g
        path.mkdir(parents=True)
        with (path / "users.csv").open("w", encoding="utf-8-sig", newline="") as f:
            csv.writer(f).writerows([["用户id", "x"], *([u, ""] for u in own)])
        for u in own:
            (path / u).mkdir()
            with (path / u / f"{u}.csv").open("w", encoding="utf-8-sig", newline="") as f:
                rows = [[f"{u}{k}", "b", f"{word} {draw.choice(['and', 'or', 'but'])} {draw.choice('pqrs')}", "", "", str(draw.randrange(9)), "0", "1", f"2022-03-{k + 1:02d} 08:00:00"] for k in range(draw.randrange(2, 5))]
                csv.writer(f).writerows([POSTS, *rows])
    settings = {
        "raw_root": f"{base}/raw", "prepared_root": f"{base}/set", "private_root": f"{base}/private", "keywords": ["banjo"], "folds": 2, "validation_fraction": 0.2, "maximum_posts": 4,
        "groups": [{"directory": "control", "label_name": "control", "label_id": 0}, {"directory": "positive", "label_name": "positive", "label_id": 1}],
    }
    for name, value in {
        "study": settings,
        "svm": {"seeds": [1, 2], "condition": "original"},
        "pooled": {"seeds": [1, 2], "pooling": "mean", "distributed": True},
        "build": {"maximum_posts": 4, "parts": 2},
        "model": {"d_model": 8, "embedding_dimension": 8, "metadata_dimension": 5, "ffn_hidden_dim": 4, "classifier_hidden_dim": 4},
        "training": {"epochs": 3, "learning_rate": 0.05},
    }.items():
        (base / f"{name}.json").write_text(json.dumps(value))
    return base


def run(study, command, *more):
    assert cli.main([command, "--study", f"{study}/study.json", "--seeds", "1-2", *more]) == 0


def encoder():
    from weftline.operators.neural import stub_encoder

    return stub_encoder(8)()


def test_all_commands(spark, study, monkeypatch, capsys):
    monkeypatch.setenv("WEFTLINE_KEY", "key")
    run(study, "audit")
    assert '"source_group": "control"' in capsys.readouterr().out
    run(study, "prepare")
    assert store.Dataset(spark, f"{study}/private", kind="identities").manifest["id"] == store.Prepared(spark, f"{study}/set").manifest["id"]
    with pytest.raises(FileExistsError):
        run(study, "prepare")
    run(study, "make-splits")
    run(study, "build-features", "--experiment", f"{study}/build.json", "--encoder", "tests.test_commands:encoder", "--dimension", "8", "--out", f"{study}/features")
    assert '"subjects": 28' in capsys.readouterr().out
    run(study, "evaluate", "--experiment", f"{study}/svm.json", "--name", "text")
    run(study, "evaluate", "--experiment", f"{study}/pooled.json", "--inputs", "features", "--features", f"{study}/features", "--name", "pooled")
    run(study, "train-full", "--experiment", f"{study}/model.json", "--training", f"{study}/training.json", "--features", f"{study}/features", "--out", f"{study}/models", "--name", "full")
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["n"] == 2
    assert store.Dataset(spark, f"{study}/models", kind="models").table("parameters").count() > 0
    run(study, "fuse", "--name", "text", "--with", "pooled", "--weight", "0.3")
    run(study, "report", "--name", "text")
    report = capsys.readouterr().out
    assert "| text |" in report and "| full |" in report and "| text+pooled |" in report
    run(study, "compare", "--name", "text", "--with", "text")
    assert capsys.readouterr().out.strip() == ""
    run(study, "compare", "--name", "text", "--with", "pooled")
    assert '"column": "score"' in capsys.readouterr().out
