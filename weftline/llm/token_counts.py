"""Token counts of documents in flat token files, by a scan for separators.

A flat token file is a run of little-endian unsigned ids in which an
end-of-document id closes each document; it has no index.  The scan reads files
in blocks, finds the separators of a block with one vectorised comparison, and
stitches documents that cross blocks with a prefix scan over the blocks' counts:
how many documents ended before a block, and how many ids its first document
already has.  Only per-document counts leave the executors.

Defined results: a null text is empty and an empty text has 0 tokens; ids after a
file's last separator are an incomplete document; an empty file has no
documents; a file whose bytes are no whole number of ids is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import textbytes as tb
from weftline.llm.packing import default_tokenizer
from weftline.llm.scratch import Scratch, batch_rows, bound_batches
from weftline.llm.tokens import WordBPE

#: End-of-document id of the default tokenizer.
SEPARATOR = 49407
FILE_IDS = 4 << 20
BLOCK_IDS = 1 << 19


def _writing(folder: str, tokenizer: str, separator: int, dtype: str, file_ids: int):
    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        bpe, end = WordBPE(tokenizer, special_as_text=True), np.array([separator], dtype)
        held: list[np.ndarray] = []
        n_held = n_files = ordinal = 0

        def flush() -> None:
            nonlocal held, n_held, n_files, ordinal
            if held:
                name = f"{root}/part-{part:06d}-{n_files:05d}.bin"
                with store.open_output_stream(f"{name}.{attempt}.tmp") as f:
                    for ids in held:
                        f.write(ids.tobytes())
                store.move(f"{name}.{attempt}.tmp", name)
                n_files += 1
            held, n_held, ordinal = [], 0, 0

        for batch in batches:
            names, places = [], []
            for p in tb.slices(batch.column(1)):
                ids, bounds = bpe.encode(p)
                if len(ids) and (int(ids.max()) > np.iinfo(dtype).max or (ids == separator).any()):
                    raise ValueError("an id of a text doesn't fit the type of the files, or is the separator")
                ids = ids.astype(dtype)
                for r in range(p.rows):
                    if n_held > file_ids:
                        flush()
                    own = ids[bounds[r] : bounds[r + 1]]
                    held += [own, end]
                    n_held += len(own) + 1
                    names.append(f"part-{part:06d}-{n_files:05d}.bin")
                    places.append(ordinal)
                    ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
        flush()

    return run


def write_token_files(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, separator: int = SEPARATOR, dtype: str = "<u2", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes flat files from the partitions of `docs` as they are; (file, ordinal, doc_id) in the order written.

    The frame must be materialised once, as its tasks write the files.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_writing(folder, tokenizer or default_tokenizer(), separator, dtype, file_ids), f"file string, ordinal long, doc_id {kind}")


def read_blocks(spark: SparkSession, folder: str, *, block_bytes: int = 2 * BLOCK_IDS) -> DataFrame:
    """(file, block, payload): the files of a folder cut into blocks; files have up to 2 GB, the limit of Spark's reader of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))
    cut = files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.posexplode(starts).alias("block", "at"))
    return cut.select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("at").cast("int") + 1, F.lit(block_bytes)).alias("payload"))


_BLOCK = "file string, block long, ids long, ends long, head long, tail long, inner array<long>"


def _finding(separator: int, dtype: str):
    kind = np.dtype(dtype)

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, head, tail, inner = [], [], [], [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), kind)
                at = np.flatnonzero(ids == separator)
                n.append(len(ids))
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, ends, head, tail)), pa.array(inner, pa.list_(pa.int64()))],
                [x.split()[0] for x in _BLOCK.split(", ")],
            )

    return run


def count_tokens(blocks: DataFrame, *, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens, complete) of every document of the blocks (file, block, payload).

    Blocks of a file must be cut at whole ids and numbered in order.
    """
    found = blocks.mapInArrow(_finding(separator, dtype), _BLOCK)
    file = Window.partitionBy("file").orderBy("block")
    # ids that a block leaves to the next ones add up until a block with a separator
    found = found.withColumn("run", F.sum((F.col("ends") > 0).cast("long")).over(file))
    found = found.withColumn("left", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    found = found.withColumn("carry", F.coalesce(F.lag("left").over(file), F.lit(0)))
    found = found.withColumn("before", F.sum("ends").over(file) - F.col("ends"))
    found = found.withColumn("last", F.lead("block").over(file).isNull())
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    whole = found.select("file", "before", F.posexplode(closed).alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    rest = found.where("last AND left > 0").select("file", (F.col("before") + F.col("ends")).alias("ordinal"), F.col("left").alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(rest)


def count_document_tokens(docs: DataFrame, *, separator: int = SEPARATOR, dtype: str = "<u2", **options) -> DataFrame:
    """(doc_id, n_tokens): writes the documents to flat files and counts by scanning these; further options are the writer's."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.path}/files"
    order = scratch.save(write_token_files(docs, folder, separator=separator, dtype=dtype, **options), "order")
    if order.isEmpty():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    blocks = read_blocks(spark, folder, block_bytes=np.dtype(dtype).itemsize * BLOCK_IDS)
    with batch_rows(spark, 16):  # rows are blocks here
        counts = scratch.save(count_tokens(blocks, separator=separator, dtype=dtype), "counts")
    scratch.drop("files")
    return order.join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens")
