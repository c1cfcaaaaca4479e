"""Running sums along a global order: range partitions, sums of each partition, a carried prefix.

No window spans more than a partition, so neither a hot group nor the whole order lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

#: Rows of a partition.
ROWS = 1 << 17


def ranged(df: DataFrame, order: Sequence[Column], scratch: Scratch, name: str, rows: int) -> DataFrame:
    """`df` with its range partition of `order` as `part`, written, as ranges are drawn anew for each job; `rows` is about its number of rows."""
    return scratch.save(df.repartitionByRange(max(1, -(-rows // ROWS)), *order).withColumn("part", F.spark_partition_id()), name)


def running(df: DataFrame, value: str, order: Sequence[Column], out: str, group: Sequence[str] = ()) -> DataFrame:
    """A table of `ranged` with the sum of `value` up to each row of its group, itself included.

    The order must begin with `group`.  Partitions' sums are one row a partition and group.
    """
    keys = ["part", *group]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__own", F.sum(value).over(within)).join(carried, keys).withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before")
