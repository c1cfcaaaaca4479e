"""Sums of fixed-size count arrays that the tasks of a scan have made, without gathering them in one place."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays of so many groups of tasks are summed first, then these sums.
FAN_IN = 256


def pack_counts(counts: np.ndarray) -> bytes:
    """64-bit counts with equal bytes of the numbers side by side, which compresses the zeros away."""
    return zlib.compress(counts.astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return raw.T.copy().view("<i8").ravel()


def _adding(told: Callable[[np.ndarray], bytes]):
    def run(table: pa.Table) -> pa.Table:
        total = sum(unpack_counts(c.as_py()) for c in table.column("counts"))
        out = {n: table.column(n)[:1] for n in table.column_names if n != "counts"}
        return pa.table(out | {"counts": pa.array([told(total)], pa.binary())})

    return run


def sum_counts(parts: DataFrame, told: Callable[[np.ndarray], bytes] = pack_counts) -> DataFrame:
    """(key: int, counts: packed) summed by key, in two levels; `told` says what becomes of a sum."""
    near = parts.select("key", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("part"), "counts")
    first = near.groupBy("key", "part").applyInArrow(_adding(pack_counts), "key int, part int, counts binary")
    return first.select("key", "counts").groupBy("key").applyInArrow(_adding(told), "key int, counts binary")
