import pytest

from weftline.plans.hygiene import Rule, scan


def test_planted_faults_are_found_with_file_and_line(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode() if isinstance(text, str) else text)

    put("src/good.py", "import os\npath = os.path.join('home', 'data')\nsecret = read()\n# /home is a word here\n")
    put("README.md", "fine\n" * 3)
    put("empty.py", "")
    assert scan(spark, str(tmp_path)).collect() == []
    put("src/bad.py", "x = 1\n\nroot = '/home/" + "someone/data'\nAPI_" + "KEY = 'abcdefghijklmnop1234'\n")
    put("key.txt", "a\n-----BEGIN RSA " + "PRIVATE KEY-----\n")
    put("conf.json", '{"password": "' + "q" * 20 + '"}')
    put("merge.py", "<" * 7 + " HEAD\nx\n" + ">" * 7 + " other\n")
    put("weights/best.safetensors", b"\0\1")
    put(".env", "A=1")
    put("big.md", "z" * 2000)
    put("blob.bin", b"/home/" + b"someone/\n")  # not a text file
    put(".git/config", "/home/" + "someone/x")
    found = scan(spark, str(tmp_path), largest=1000, needed=["README.md", "LICENSE"])
    assert {tuple(r) for r in found.collect()} == {
        ("src/bad.py", 3, "absolute path of a user"), ("src/bad.py", 4, "credential"), ("key.txt", 2, "private key"), ("conf.json", 1, "credential"),
        ("merge.py", 1, "merge conflict"), ("merge.py", 3, "merge conflict"), ("weights/best.safetensors", None, "data or weights"), (".env", None, "environment file"),
        ("big.md", None, "too large"), ("LICENSE", None, "missing"),
    }
    assert {r.rule for r in scan(spark, str(tmp_path), [Rule("tabs", "line", "\t")]).collect()} == set()
    with pytest.raises(ValueError):
        Rule("x", "other", "y")
