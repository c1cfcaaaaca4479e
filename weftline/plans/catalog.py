"""Identities of stored tables, results kept by them, and small settings read on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import fields, is_dataclass
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.identity import canonical_digest

C = TypeVar("C")


def identity(kind: str, **parts: Any) -> str:
    """`<kind>-` and 20 hex digits of all that a table depends on."""
    return f"{kind}-{canonical_digest(parts, 20)}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, digest) of every file below a folder, names being relative; files of any size are read in splits.

    A split gives sums over its lines of numbers drawn from the line's SHA-256, plain and times the line's place; as
    these are linear in the place, sums of splits combine to those of the file however it was split. Nothing is
    gathered, and a split is one row. The digest finds changes, it doesn't withstand a forger. Compressed files are
    digested as what they hold, with the bytes they have.
    """
    base = re.sub(r"^\w+:/*", "/", path).rstrip("/") + "/"
    name = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\w+:/*", "/"), "^" + re.escape(base), "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name(F.col("path")).alias("file"), F.col("length").alias("bytes"))
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    drawn = F.sha2(F.col("value").cast("binary"), 256)
    lanes = [F.conv(F.substring(drawn, 1 + 7 * k, 7), 16, 10).cast("decimal(10,0)") for k in range(4)]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("decimal(10,0)")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), place.alias("at"), *(x.alias(f"x{k}") for k, x in enumerate(lanes)))
    wide = "decimal(38,0)"
    splits = rows.groupBy("path", "block").agg(F.count("*").cast(wide).alias("n"), F.min("at").cast(wide).alias("first"), *(F.sum(f"x{k}").cast(wide).alias(f"s{k}") for k in range(4)), *(F.sum(F.col(f"x{k}") * F.col("at")).cast(wide).alias(f"t{k}") for k in range(4)))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("decimal(18,0)") - F.col("first").cast("decimal(18,0)"))
    sums = [F.sum(F.col(f"s{k}")) for k in range(4)] + [F.sum(F.col(f"t{k}") + (F.col(f"s{k}").cast("decimal(20,0)") * F.col("base")).cast(wide)) for k in range(4)]
    of_file = moved.groupBy(name(F.col("path")).alias("file")).agg(F.sha2(F.concat_ws(",", F.sum("n").cast("string"), *(x.cast("string") for x in sums)), 256).alias("digest"))
    return files.join(of_file, "file", "left").withColumn("digest", F.coalesce("digest", F.lit("empty")))


def content_fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of a folder's files by relative path and content; the order of listing doesn't matter."""
    one = F.sha2(F.concat_ws("\0", "file", F.col("bytes").cast("string"), "digest"), 256)
    # an order-free sum of the digests' parts: one small row, no sorted gathering
    parts = [F.sum(F.conv(F.substring(one, k, 15), 16, 10).cast("decimal(38,0)")) for k in (1, 16, 31)]
    row = file_digests(spark, path).agg(F.count("*"), *parts).first()
    return canonical_digest([str(x) for x in row])


def run_manifest(spark: SparkSession, kind: str, settings: dict[str, Any], inputs: dict[str, str]) -> dict[str, Any]:
    """Identity of a run from its settings and inputs; the environment is recorded but isn't part of it."""
    return {
        "run_id": identity(kind, settings=settings, inputs=inputs),
        "settings": settings,
        "inputs": inputs,
        "environment": {"spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "time_zone": spark.conf.get("spark.sql.session.timeZone")},
    }


def stored(spark: SparkSession, root: str, manifest: dict[str, Any], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a run, built and written only if no complete one is there.

    A folder of the same name with another manifest, or one that a failed write has left, is an error.
    """
    at = f"{root}/{manifest['run_id']}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    want = json.dumps({k: v for k, v in manifest.items() if k != "environment"}, sort_keys=True, default=str)
    if fs.exists(fs_path(at)):
        if not fs.exists(fs_path(f"{at}/data/_SUCCESS")) or not fs.exists(fs_path(f"{at}/manifest")):
            raise ValueError(f"{at} is incomplete")
        found = "\n".join(r[0] for r in spark.read.text(f"{at}/manifest").collect())
        if found != want:
            raise ValueError(f"{at} has another manifest")
    else:
        build().write.parquet(f"{at}/data")
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(f"{at}/manifest")
    return spark.read.parquet(f"{at}/data")


def expand_environment(value: Any) -> Any:
    """`${NAME}` in all texts of a setting replaced from the environment; an unset name is an error."""
    if isinstance(value, dict):
        return {k: expand_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_environment(v) for v in value]
    if not isinstance(value, str):
        return value

    def named(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise ValueError(f"the environment has no {m[1]}")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", named, value)


def parse_seeds(text: str) -> list[int]:
    """Distinct seeds of a list such as "42,58-65", in order."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m or m[2] and int(m[2]) < int(m[1]):
            raise ValueError(f"not a seed or a range of seeds: {part!r}")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    if not out or len(set(out)) < len(out):
        raise ValueError("seeds must be given, each once")
    return out


def strict(kind: type[C], values: dict[str, Any]) -> C:
    """A settings dataclass from a dict; unknown and missing keys are errors, nested dataclasses are read alike."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(unknown)}")
    hints = {n: f.type for n, f in known.items()}
    made = {}
    for k, v in values.items():
        inner = getattr(kind, "nested", {}).get(k) or (hints[k] if isinstance(hints[k], type) else None)
        made[k] = strict(inner, v) if inner is not None and is_dataclass(inner) and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    try:
        return kind(**made)
    except TypeError as e:
        raise ValueError(str(e)) from e
