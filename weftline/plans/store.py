"""Stored datasets: tables that appear together, under a manifest, with the rows of a subject in one bucket of files.

A dataset is a folder with `manifest.json` and a folder per table, each partitioned by `bucket`, a hash of the subject,
so that looking subjects up reads the files of their buckets alone.  Publishing writes everything beside its place
and moves the folders in at the end; what fails on the way takes back what it has moved.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.pooling import finite
from weftline.operators.windowing import apply_condition, recent
from weftline.plans.config import CONDITIONS

VERSION = 1
#: Subjects of a lookup; for more, join with the tables instead.
LOOKUP = 1000
#: Names in an encoder's part of a manifest that hold paths of the machine it was made on.
PATH_NAMES = ("config_path", "model_path", "model_name_or_path")


class Files:
    """The few operations on folders that publishing needs, on whatever filesystem a path names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, a: str, b: str) -> None:
        p, fs = self._at(a)
        to, _ = self._at(b)
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(p, to):
            raise OSError(f"{a} couldn't be moved to {b}")

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write_json(self, value: Any, path: str) -> None:
        """Appears whole: written beside, then moved."""
        p, fs = self._at(path + ".new")
        out = fs.create(p, True)
        try:
            out.write(json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1).encode())
        finally:
            out.close()
        to, _ = self._at(path)
        if fs.exists(to):
            fs.delete(to, False)
        if not fs.rename(p, to):
            raise OSError(f"{path} couldn't be written")

    def read_json(self, path: str) -> Any:
        if not self.exists(path):
            raise FileNotFoundError(path)
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below `spark.checkpoint.dir`, or a temporary one where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-store-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def bucket(subject: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(subject.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def bucket_of(subject: Any, buckets: int) -> int:
    """The same for a value on the driver."""
    return crc32(str(subject).encode()) % buckets


def publish(spark: SparkSession, datasets: dict[str, tuple[dict[str, DataFrame], dict[str, Any]]], *, subject: str = "subject_id", buckets: int = 16, files: Files | None = None) -> None:
    """Writes (tables, manifest) for each folder of `datasets`, such as a public and a private one: all of it or nothing.

    Tables without the subject's column are written plain.  A folder that is there already is an error.
    """
    files = files or Files(spark)
    if there := [p for p in datasets if files.exists(p)]:
        raise FileExistsError(there[0])
    mark = uuid.uuid4().hex[:12]
    staged = {path: f"{path.rstrip('/')}.staged-{mark}" for path in datasets}
    moved: list[str] = []
    try:
        for path, (tables, manifest) in datasets.items():
            kinds = {}
            for name, df in tables.items():
                dealt = df.withColumn("bucket", bucket(F.col(subject), buckets)).repartition("bucket").sortWithinPartitions("bucket", subject) if subject in df.columns else df
                (dealt.write.partitionBy("bucket") if subject in df.columns else dealt.write).parquet(f"{staged[path]}/{name}")
                kinds[name] = df.schema.jsonValue()
            files.write_json(manifest | {"version": VERSION, "subject": subject, "buckets": buckets, "tables": kinds, "complete": manifest.get("complete", True)}, f"{staged[path]}/manifest.json")
        for path in datasets:
            files.move(staged[path], path)
            moved.append(path)
    except BaseException:
        for path in [*moved, *staged.values()]:
            files.delete(path)
        raise


class Dataset:
    """A published folder: its manifest is checked when it is opened, subjects are looked up by bucket."""

    def __init__(self, spark: SparkSession, path: str, *, kind: str | None = None, identity: str | None = None, require_complete: bool = True):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.manifest = self.files.read_json(f"{self.path}/manifest.json")
        if self.manifest.get("version") != VERSION:
            raise ValueError(f"{path} has version {self.manifest.get('version')!r}, not {VERSION}")
        if kind is not None and self.manifest.get("kind") != kind:
            raise ValueError(f"{path} holds {self.manifest.get('kind')!r}, not {kind!r}")
        if identity is not None and self.manifest.get("id") != identity:
            raise ValueError(f"{path} is {self.manifest.get('id')!r}, not {identity!r}")
        if require_complete and not self.manifest.get("complete"):
            raise ValueError(f"{path} isn't complete")
        if missing := [n for n in self.manifest["tables"] if not self.files.exists(f"{self.path}/{n}/_SUCCESS")]:
            raise ValueError(f"{path} lacks the table {missing[0]}")

    def table(self, name: str, subjects: Sequence[Any] | None = None, *, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table, or its rows of some subjects or buckets, for which only files of these buckets are read."""
        schema, own = T.StructType.fromJson(self.manifest["tables"][name]), self.manifest["subject"]
        dealt = own in schema.names
        df = self.spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType())]) if dealt else schema).parquet(f"{self.path}/{name}")
        if subjects is not None:
            if len(subjects) > LOOKUP:
                raise ValueError(f"a lookup is of at most {LOOKUP} subjects")
            df = df.where(F.col("bucket").isin(sorted({bucket_of(s, self.manifest["buckets"]) for s in subjects})) & F.col(own).isin(list(subjects)))
        if buckets is not None:
            df = df.where(F.col("bucket").isin(list(buckets)))
        return df.drop("bucket")


class Prepared(Dataset):
    """Subjects, posts and media of a study."""

    def __init__(self, spark: SparkSession, path: str, **how: Any):
        super().__init__(spark, path, kind="prepared", **how)

    def subjects(self, *, eligible_only: bool = True) -> DataFrame:
        """Subjects with `split_post_count`, the posts that models see."""
        df = self.table("subjects")
        df = df.where("eligible") if eligible_only else df
        return df.withColumn("split_post_count", F.least("post_count", F.lit(self.manifest["maximum_posts"]).cast("long")))

    def posts(self, subjects: Sequence[Any] | None = None, *, maximum_posts: int | None = None, condition: str = "original", keywords: Sequence[str] = (), mask: str = "[MASK]") -> DataFrame:
        """Posts under a keyword condition; the window is taken first, so removed posts aren't made up for by older ones."""
        if condition not in CONDITIONS:
            raise ValueError(f"conditions are {', '.join(CONDITIONS)}")
        if maximum_posts is not None and maximum_posts < 1:
            raise ValueError("a window has one post at least")
        df = self.table("posts", subjects)
        if maximum_posts is not None:
            df = recent(df, "subject_id", "published_at", "post_id", maximum_posts).select(*df.columns)
        return apply_condition(df, "cleaned_text", condition, keywords, mask)

    def media(self, subjects: Sequence[Any] | None = None) -> DataFrame:
        return self.table("media", subjects)


@dataclass(frozen=True)
class FeatureShape:
    representations: tuple[str, ...]
    embedding_dimension: int
    metadata_dimension: int
    maximum_posts: int


class FeatureSet(Dataset):
    """Vectors of posts: (subject_id, post_id, pos, representation, embedding, metadata) and the table of subjects they are of."""

    def __init__(self, spark: SparkSession, path: str, **how: Any):
        super().__init__(spark, path, kind="features", **how)
        if any(n in (self.manifest.get("encoder") or {}) for n in PATH_NAMES):
            raise ValueError("the manifest holds a path of another machine: build the features anew")
        if self.table("subjects").limit(1).count() == 0:
            raise ValueError(f"{path} has no subjects")
        m = self.manifest["shape"]
        self.shape = FeatureShape(tuple(m["representations"]), m["embedding_dimension"], m["metadata_dimension"], m["maximum_posts"])

    def problems(self, subjects: Sequence[Any] | None = None) -> DataFrame:
        """(subject_id, rule, cases): every way in which the features differ from their manifest; one aggregation of the rows."""
        n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0))
        per_post = self.table("features", subjects).groupBy("subject_id", "post_id").agg(
            F.count("*").alias("rows"), F.count_distinct("representation").alias("kinds"), n(~F.col("representation").isin(*self.shape.representations)).alias("unknown"),
            n(F.size("embedding") != self.shape.embedding_dimension).alias("width"), n(F.size("metadata") != self.shape.metadata_dimension).alias("metadata width"),
            n(~finite(F.col("embedding")) | ~finite(F.col("metadata"))).alias("not finite"),
        )
        each = per_post.groupBy("subject_id").agg(
            n((F.col("unknown") > 0) | (F.col("kinds") != len(self.shape.representations))).alias("representations"), F.sum("width").alias("width"), F.sum("metadata width").alias("metadata width"), F.sum("not finite").alias("not finite"),
            n(F.col("rows") > F.col("kinds")).alias("repeated post"), F.greatest(F.count("*") - self.shape.maximum_posts, F.lit(0)).alias("too many posts"),
        )
        known = self.table("subjects", subjects).select("subject_id", F.lit(True).alias("known"))
        both = each.join(known, "subject_id", "left").withColumn("unknown subject", F.col("known").isNull().cast("long"))
        rules = ("representations", "width", "metadata width", "not finite", "repeated post", "too many posts", "unknown subject")
        return both.select("subject_id", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("cases")) for r in rules)))).where("cases > 0")

    def load(self, subjects: Sequence[Any]) -> DataFrame:
        """The checked features of some subjects, in order; a subject that isn't in the set is an error, as is any problem."""
        there = {r[0] for r in self.table("subjects", subjects).select("subject_id").collect()}
        if missing := [s for s in subjects if s not in there]:
            raise KeyError(f"no features of subject {missing[0]}")
        bad = self.problems(subjects).limit(1).collect()
        if bad:
            raise ValueError(f"features of {bad[0]['subject_id']}: {bad[0]['rule']}")
        return self.table("features", subjects).orderBy("subject_id", "pos", "representation")


def media_paths(identities: Dataset, raw_root: str, dataset_id: str, subjects: Sequence[Any]) -> DataFrame:
    """(subject_id, media_id, path) from the private mapping of a prepared dataset.

    A mapping of another dataset, an unknown subject, a repeated medium and a path that leaves the root are errors.
    """
    if identities.manifest.get("kind") != "identities" or identities.manifest.get("id") != dataset_id:
        raise ValueError("the private mapping isn't of this dataset")
    rows = identities.table("media_paths", subjects)
    known = {r[0] for r in identities.table("identities", subjects).select("subject_id").collect()}
    if missing := [s for s in subjects if s not in known]:
        raise KeyError(f"the private mapping has no subject {missing[0]}")
    twice = F.count("*").over(Window.partitionBy("subject_id", "media_id")) > 1
    parts = F.filter(F.split("source_path", "[/\\\\]"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    out = F.col("source_path").isNull() | F.col("source_path").rlike(r"^([/\\]|\w+:)") | (depth["least"] < 0)
    path = F.when(twice, F.raise_error(F.lit("a medium is named twice"))).when(out, F.raise_error(F.lit("a medium's path leaves the root"))).otherwise(F.concat(F.lit(raw_root.rstrip("/") + "/"), F.array_join(parts, "/")))
    return rows.select("subject_id", "media_id", path.alias("path"))


def build_resumably(spark: SparkSession, path: str, identity: dict[str, Any], source: Dataset, make: Callable[[list[int]], DataFrame], measures: dict[str, Column], *, parts: int, files: Files | None = None) -> dict[str, int]:
    """`make(buckets)` in `parts` committed pieces below `path`; gives the sums of `measures` over all rows.

    A piece holds the subjects of some buckets of `source`, so it reads these files alone; sums are observed in the pass that writes it, and a piece counts as done once
    its sums are written. A build that was stopped goes on with what isn't done; of another identity it is an error.
    Pieces stay in `path/pieces` (see `pieces`) until the caller publishes them.
    """
    from pyspark.sql import Observation

    files = files or Files(spark)
    want = identity | {"parts": parts}
    if files.exists(f"{path}/identity.json"):
        if files.read_json(f"{path}/identity.json") != json.loads(json.dumps(want)):
            raise ValueError(f"{path} is a build of another identity")
    else:
        files.write_json(want, f"{path}/identity.json")
    total = dict.fromkeys(measures, 0)
    for k in range(parts):
        done = f"{path}/sums/{k}.json"
        if not files.exists(done):
            seen = Observation()
            own = [b for b in range(source.manifest["buckets"]) if b % parts == k]
            df = make(own).observe(seen, *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in measures.items()))
            df.write.mode("overwrite").parquet(f"{path}/pieces/part={k}")
            files.write_json({n: int(seen.get[n]) for n in measures}, done)
        for n, v in files.read_json(done).items():
            total[n] += v
    return total


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a finished build."""
    files = Files(spark)
    parts = files.read_json(f"{path}/identity.json")["parts"]
    if any(not files.exists(f"{path}/sums/{k}.json") for k in range(parts)):
        raise ValueError(f"{path} isn't finished")
    return spark.read.parquet(f"{path}/pieces").drop("part")
