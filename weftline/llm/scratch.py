"""Intermediate tables in the folder that driver and executors share, and small settings."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch for the Python stages: texts may be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 26
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for this session where its owner hasn't; it stays so, as results are lazy plans."""
    for name, unset, value in ((_ROWS, "10000", BATCH_ROWS), (_BYTES, None, BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now == unset or (unset is None and int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(now or "2g"))) > value):
            spark.conf.set(name, str(value))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other batches for what is run inside; then the session's setting is what it was."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; set here only where it is unset, as in tests.

    A path without a scheme belongs to the default filesystem, as in Spark itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()


class Scratch:
    """Written intermediate tables: they cut lineage and outlive lost executors.

    A folder that still holds a result is deleted when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/weftline-{what}-{uuid.uuid4().hex[:12]}"
        bound_batches(spark)
        atexit.register(_forget, self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _files(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; without names the whole folder."""
        for at in [f"{self.path}/{n}" for n in names] or [self.path]:
            path, files = self._files(at)
            files.delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        path, files = self._files(self.path)
        if files.exists(path):
            self.drop(*[n for n in (s.getPath().getName() for s in files.listStatus(path)) if n not in names] or ["-"])

    def reclaim(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not at the driver's next collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def _forget(scratch: Scratch) -> None:
    try:
        if scratch.spark.sparkContext._jsc is not None and not scratch.spark.sparkContext._jsc.sc().isStopped():
            scratch.drop()
    except Exception:  # the JVM is gone; nothing here can reach the files any more
        pass
