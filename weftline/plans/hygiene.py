"""What a folder of sources must not hold: one pass over its files by rules on names, sizes and lines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`on` is `name` (the path below the root), or `line` (every line of text files); `pattern` is a Java expression that mustn't be found."""

    name: str
    on: str
    pattern: str

    def __post_init__(self) -> None:
        if self.on not in ("name", "line"):
            raise ValueError("a rule is on names or on lines")


RULES = (
    Rule("data or weights", "name", r"(?i)\.(parquet|npz|npy|safetensors|pt|pth|ckpt|onnx|sqlite|db|zip|tar|gz|mp4|mov|jpe?g)$"),
    Rule("environment file", "name", r"(^|/)\.env(\.[^/]+)?$"),
    Rule("cache", "name", r"(^|/)(__pycache__|\.ipynb_checkpoints|\.pytest_cache)/"),
    Rule("private mapping", "name", r"(?i)(^|/)(identity[-_]map|private)[^/]*(/|\.jsonl?$)"),
    Rule("absolute path of a user", "line", r"(?<![\w.])(/home/[A-Za-z][\w.-]*/|/Users/[A-Za-z][\w.-]*/|[A-Za-z]:\\Users\\)"),
    Rule("private key", "line", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("credential", "line", r"""(?i)\b(api[_-]?key|secret|token|passwd|password)\b["']?\s*[:=]\s*["'][A-Za-z0-9+/_\-]{16,}["']"""),
    Rule("access key", "line", r"\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|hf_[A-Za-z]{34})\b"),
    Rule("merge conflict", "line", r"^(<{7}|>{7}) "),
)
TEXTS = ("py", "md", "toml", "json", "jsonl", "yaml", "yml", "txt", "cfg", "ini", "sh", "sql")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files, also of those that Spark's readers pass over as their names begin with a dot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, rows = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        one = found.next()
        rows.append((one.getPath().toString(), one.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def scan(spark: SparkSession, root: str, rules: Sequence[Rule] = RULES, *, largest: int = 5_000_000, texts: Sequence[str] = TEXTS, needed: Sequence[str] = (), skip: str = r"^\.git/") -> DataFrame:
    """(file, line, rule) of all that breaks a rule; line is null for rules on whole files.

    Files over `largest` bytes break `too large` and aren't read; of `needed` ones that lack, `missing`.  Lines end at
    line feeds and are numbered from 1; names that match `skip` are left out, and of names that begin with a dot or an
    underscore only the name and the size are judged.
    """
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    name = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base), "")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = _listed(spark, root).select(name.alias("file"), "length").where(~F.col("file").rlike(skip))
    broken = lambda on, value: F.filter(F.array(*(F.when(value.rlike(r.pattern), F.lit(r.name)) for r in rules if r.on == on), F.lit(None).cast("string")), lambda x: x.isNotNull())
    large = F.when(F.col("length") > largest, F.array(F.lit("too large"))).otherwise(F.array().cast("array<string>"))
    by_file = files.select("file", F.lit(None).cast("int").alias("line"), F.explode(F.concat(broken("name", F.col("file")), large)).alias("rule"))
    # contents only of small text files; Spark prunes them from the first scan and filters this one before reading
    small = every.where(F.col("path").rlike(rf"(?i)\.({'|'.join(texts)})$") & (F.col("length") <= largest)).select(name.alias("file"), F.col("content").cast("string").alias("text")).where(~F.col("file").rlike(skip))
    lines = small.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "said"))
    by_line = lines.select("file", (F.col("at") + 1).alias("line"), F.explode(broken("line", F.col("said"))).alias("rule"))
    out = by_file.unionByName(by_line)
    if needed:
        wanted = spark.createDataFrame([(n,) for n in needed], "file string").join(files, "file", "left_anti")
        out = out.unionByName(wanted.select("file", F.lit(None).cast("int").alias("line"), F.lit("missing").alias("rule")))
    return out
