"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector by random projections: a hash is the direction, of
`directions` random ones, to which a vector or its opposite is nearest, and hashes
and then signs of further projections are concatenated to a key.  All vectors are
ordered by it and each is compared with the `window` before it.  Pairs at or above the
threshold, verified by cosine in double precision, are links; the passes' links
are united and their connected components found.  Few passes run at a time and
their shuffles are dropped before the next, so disk holds a few copies of the
vectors whatever the number of passes.

Vectors with equal hashes are a run.  A run of up to `window` + 1 rows is compared
whole by its windows; one that has more, as where many vectors lie about one
direction, is then compared whole too, in blocks, except for pairs whose component
is already the same.  So a pair at or above the threshold is found once it shares a
run, however vectors are spread, and there are so many passes that a pair just at
the threshold shares none with probability `miss`.

Bounded windows can't list all pairs of a group larger than they are, so the
links of a vector are counted exactly within its component: an angle to the
component's mean direction proves pairs linked when the two angles together are
within the threshold's, which settles tight groups of any size in linear work,
and what this leaves open is compared block by block.

Equal vectors are one node.  Defined results: a vector that is null, empty, zero
or holds null or non-finite components links with nothing, as does a row with a
null id; vectors of different lengths don't link; rows that repeat an id count as
vectors of their own; the least id names a component, so ties can't arise; columns
other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.scratch import Scratch

_BLOCK = 1000
_RUN_BLOCK = 4000
_SLACK = 1e-6
#: Values of a hash at most, in pairs; and bits that order the rows of a run.
_MOST_DIRECTIONS, _TAIL_BITS = 512, 16
#: Passes whose shuffles are on disk at once.
_AT_ONCE = 2


class Hashing(NamedTuple):
    """`hashes` concatenated hashes of 2 * `directions` values make a run."""

    hashes: int
    directions: int

    @staticmethod
    def of(n: int, window: int) -> Hashing:
        """As many values as make evenly spread vectors have half a window's rows in a run, or fewer."""
        values = max(2.0, 2 * n / window)
        hashes = int(np.ceil(np.log(values) / np.log(2 * _MOST_DIRECTIONS)))
        return Hashing(hashes, int(np.ceil(values ** (1 / hashes) / 2)))

    def agreement(self, threshold: float) -> float:
        """How often two vectors at the threshold share a run; projections make this the same in all dimensions."""
        rng = np.random.default_rng(5)
        x = rng.standard_normal((20_000, self.directions), np.float32)
        y = threshold * x + (1 - threshold**2) ** 0.5 * rng.standard_normal(x.shape, np.float32)
        same = _digits(x) == _digits(y)
        return max(float(same.mean()) - 2 * float(same.std()) / len(x) ** 0.5, 1e-3) ** self.hashes


def _digits(y: np.ndarray) -> np.ndarray:
    i = np.abs(y).argmax(axis=1)
    return 2 * i + (y[np.arange(len(y)), i] > 0)


def passes_needed(n: int, threshold: float, window: int, miss: float) -> int:
    """Passes after which a pair at the threshold has never shared a run with probability `miss`."""
    found = Hashing.of(n, window).agreement(threshold)
    return int(np.ceil(np.log(miss) / np.log1p(-min(found, 0.999)))) + 1


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as unit rows in double precision."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashing(passes: range, hashing: Hashing, seed: int, last: str = "vector"):
    """(node, dim, vector) or (node, dim, vector, root) to (pass, dim, run, key, node, `last`) of each vector for each pass."""
    count, width = hashing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1)).astype(np.int64)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit = _matrix(part.column(2)).astype(np.float32)
                for p in passes:
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([seed, dim, p]).standard_normal((dim, count * width + _TAIL_BITS), np.float32)
                    y = unit @ planes[dim, p]
                    found = np.zeros(len(y), np.int64)
                    for k in range(count):
                        found = found * (2 * width) + _digits(y[:, k * width : (k + 1) * width])
                    key = found << _TAIL_BITS | (y[:, count * width :] > 0) @ (1 << np.arange(_TAIL_BITS))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), p), pa.int32()), part.column(1), pa.array(found), pa.array(key), part.column(0), part.column(last)], ["pass", "dim", "run", "key", "node", last])

    return run


_EDGE = "u long, v long, pass int, dim int, key long, node long, vector "


def _compare(window: int, threshold: float, edges_out: bool):
    """Rows sorted by pass, dim and key: links (u, v), at most a spanning forest of each window's, and the rows at both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        tail: pa.RecordBatch | None = None
        opening: list[pa.RecordBatch] = []
        opened = 0
        label: dict[int, int] = {}

        def top(x: int) -> int:
            while label.setdefault(x, x) != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        def links(rows: pa.RecordBatch, old: int) -> tuple[list[int], list[int]]:
            u, v = [], []
            group = np.asarray(rows.column("pass")).astype(np.int64) << 32 | np.asarray(rows.column("dim")).astype(np.int64)
            ids = np.asarray(rows.column("node"))
            for g in np.unique(group[old:]).tolist():
                at = np.flatnonzero(group == g)
                x = _matrix(rows.column("vector").take(pa.array(at)))
                fresh = int(np.searchsorted(at, old))
                i, j = np.nonzero(x[fresh:] @ x.T >= threshold)
                i += fresh
                keep = (j < i) & (i - j <= window)
                for a, b in zip(ids[at[i[keep]]].tolist(), ids[at[j[keep]]].tolist(), strict=True):
                    ra, rb = top(a), top(b)
                    if ra != rb:
                        label[ra] = rb
                        u.append(a)
                        v.append(b)
            return u, v

        def found(u: list[int], v: list[int], schema: pa.Schema) -> pa.RecordBatch:
            none = [pa.nulls(len(u), schema.field(n).type) for n in schema.names]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *none], ["u", "v", *schema.names])

        def edge(rows: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(rows.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *rows.columns], ["u", "v", *rows.schema.names])

        for batch in batches:
            kind = batch.schema
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                if opened < window:
                    opening.append(rows.slice(0, window - opened))
                    opened += opening[-1].num_rows
                joined = pa.Table.from_batches([tail, rows] if tail is not None else [rows]).combine_chunks().to_batches()[0]
                u, v = links(joined, joined.num_rows - rows.num_rows)
                if u:
                    yield found(u, v, kind)
                tail = joined.slice(max(0, joined.num_rows - window))
                if len(label) > 1_000_000:
                    label.clear()
        if edges_out and kind is not None:
            # the first rows, and the last ones that aren't among them already
            rest = pa.Table.from_batches([tail]).to_batches()[0]
            for rows in [*opening, rest]:
                yield edge(rows)

    return run


def _compare_blocks(threshold: float):
    """Rows sorted by pass, dim, run, a, b and side: links (u, v) between the roots of near rows, at most a spanning forest of each pair of blocks'."""
    group = ["pass", "dim", "run", "a", "b"]

    def links(rows: pa.Table) -> pa.RecordBatch:
        side, roots, x = np.asarray(rows.column("side")), np.asarray(rows.column("root")), _matrix(rows.column("vector").combine_chunks())
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        other = x[right].T
        label: dict[int, int] = {}
        u, v = [], []

        def top(r: int) -> int:
            while label.setdefault(r, r) != r:
                label[r] = label[label[r]]
                r = label[r]
            return r

        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            i, j = np.nonzero((x[part] @ other >= threshold) & (roots[part][:, None] != roots[right][None, :]))
            for a, b in np.unique(np.stack([roots[part[i]], roots[right[j]]], axis=1), axis=0).tolist():
                ra, rb = top(a), top(b)
                if ra != rb:
                    label[ra] = rb
                    u.append(a)
                    v.append(b)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(n)).astype(np.int64) for n in group], axis=1)
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *starts.tolist(), batch.num_rows]
            if kept and (keys[0] != last).any():
                yield links(pa.Table.from_batches(kept))
                kept = []
            for at, to in zip(bounds[:-1], bounds[1:], strict=True):
                kept.append(batch.slice(at, to - at))
                if to < batch.num_rows:
                    yield links(pa.Table.from_batches(kept))
                    kept = []
            last = keys[-1]
        if kept:
            yield links(pa.Table.from_batches(kept))

    return run


def _crowded_links(nodes: DataFrame, roots: DataFrame, passes: int, hashing: Hashing, threshold: float, window: int, seed: int) -> DataFrame:
    """(u, v): roots with near vectors among the rows of runs that windows don't compare whole.

    Rows of a run are dealt to blocks, those of a component larger than a block to
    blocks of its own, so that pairs of blocks within one component are left out.
    """
    run = ["pass", "dim", "run"]
    rooted = nodes.select("node", F.size("vector").alias("dim"), "vector").join(roots, "node", "left").select("node", "dim", "vector", F.coalesce("root", "node").alias("root"))
    hashed = rooted.mapInArrow(_hashing(range(passes), hashing, seed, "root"), "pass int, dim int, run long, key long, node long, root long")
    hashed = hashed.select("pass", "dim", "run", "node", "root")
    tally = hashed.groupBy(*run, "root").agg(F.count("*").alias("own"))
    loose = F.when(F.col("own") <= _RUN_BLOCK, F.col("own")).otherwise(0)
    crowded = tally.groupBy(*run).agg(F.sum("own").alias("rows"), F.count("*").alias("groups"), F.sum(loose).alias("loose"))
    crowded = crowded.where((F.col("rows") > window + 1) & (F.col("groups") > 1)).select(*run, F.ceil(F.col("loose") / F.lit(_RUN_BLOCK)).alias("blocks"))
    large = tally.where(F.col("own") > _RUN_BLOCK).select(*run, "root", F.ceil(F.col("own") / F.lit(_RUN_BLOCK)).alias("parts"))
    rows = hashed.join(crowded, run).join(large, [*run, "root"], "left")
    hashed_node = F.xxhash64("node")
    own = F.xxhash64("root", F.pmod(hashed_node, F.col("parts")))
    rows = rows.select(*run, "node", "root", F.when(F.col("parts").isNotNull(), own).otherwise(F.pmod(hashed_node, F.col("blocks"))).alias("block"))

    def numbers(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    shared = crowded.where("blocks > 0").select(*run, F.lit(None).cast("long").alias("owner"), numbers("blocks").alias("block"))
    owned = large.join(crowded.select(*run), run).select(*run, F.col("root").alias("owner"), numbers("parts").alias("part"))
    blocks = shared.unionByName(owned.select(*run, "owner", F.xxhash64("owner", "part").alias("block")))
    first, second = blocks.withColumnRenamed("block", "a"), blocks.select(*run, F.col("owner").alias("other"), F.col("block").alias("b"))
    pairs = first.join(second, run).where((F.col("a") <= F.col("b")) & (F.col("owner").isNull() | F.col("other").isNull() | (F.col("owner") != F.col("other")))).select(*run, "a", "b")
    ends = pairs.select(*run, F.col("a").alias("block"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.where("a != b").select(*run, F.col("b").alias("block"), "a", "b", F.lit(1).alias("side")))
    dealt = rows.join(ends, [*run, "block"]).select(*run, "a", "b", "side", "node", "root").join(nodes.select("node", "vector"), "node").drop("node")
    dealt = dealt.repartition(*run, "a", "b").sortWithinPartitions(*run, "a", "b", "side")
    return dealt.mapInArrow(_compare_blocks(threshold), "u long, v long")


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, mult, vector, mean) to (node, root, mult, vector, angle)."""
    for batch in batches:
        angle = np.zeros(batch.num_rows)
        dims = np.asarray(batch.column(3).value_lengths())
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x, c = _matrix(batch.column(3).take(pa.array(at))), np.asarray(batch.column(4).take(pa.array(at)).flatten()).reshape(len(at), -1)
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            angle[at] = np.arccos(np.clip((x * c).sum(axis=1), -1, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(angle)], ["node", "root", "mult", "vector", "angle"])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by root within a batch."""
    for batch in batches:
        roots = np.asarray(batch.column(0))
        dims = np.asarray(batch.column(1).value_lengths())
        out_r, out_v = [], []
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            own, back = np.unique(roots[at], return_inverse=True)
            total = np.zeros((len(own), dim))
            np.add.at(total, back, _matrix(batch.column(1).take(pa.array(at))))
            out_r += own.tolist()
            out_v += list(total)
        yield pa.RecordBatch.from_arrays([pa.array(out_r, pa.int64()), pa.array(out_v, pa.list_(pa.float64()))], ["root", "total"])


def _add_vectors(table: pa.Table) -> pa.Table:
    rows = table.column("total").combine_chunks()
    return pa.table({"root": table.column("root")[:1], "total": pa.array([np.asarray(rows.flatten()).reshape(len(rows), -1).sum(axis=0)], pa.list_(pa.float64()))})


def _count_block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        rows = table.column("vector").combine_chunks()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(left), np.int64)
        if len(left) and len(right):
            near = _matrix(rows.take(pa.array(left))) @ _matrix(rows.take(pa.array(right))).T >= threshold
            n = near.astype(np.int64) @ np.asarray(table.column("mult"))[right]
        return pa.table({"node": table.column("node").take(pa.array(left)), "linked": n})

    return run


def _link_counts(nodes: DataFrame, roots: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, linked): vectors at or above the threshold from each member of a component, its own copies with it."""
    kind = nodes.schema["vector"].dataType.simpleString()
    members = scratch.save(nodes.join(roots, "node").select("node", "root", "mult", "vector"), "members")
    sums = members.select("root", "vector").mapInArrow(_unit, "root long, total array<double>")
    part = F.pmod(F.spark_partition_id(), F.lit(256)).alias("part")
    sums = sums.select("root", "total", part).groupBy("root", "part").applyInArrow(_add_vectors, "root long, total array<double>")
    means = sums.groupBy("root").applyInArrow(_add_vectors, "root long, total array<double>").withColumnRenamed("total", "mean")
    turned = scratch.save(members.join(means, "root").select("node", "root", "mult", "vector", "mean").mapInArrow(_angles, f"node long, root long, mult long, vector {kind}, angle double"), "angles")
    limit = float(np.arccos(threshold)) - _SLACK
    whole = turned.groupBy("root").agg(F.max("angle").alias("widest"), F.sum("mult").alias("total"), F.count("*").alias("size"))
    placed = turned.join(whole, "root")
    sure = placed.where(F.col("angle") + F.col("widest") <= limit).select("node", F.col("total").alias("linked"))
    open_ = whole.where(2 * F.col("widest") > limit).select("root", "widest", F.ceil(F.col("size") / F.lit(_BLOCK)).alias("blocks"))
    against = turned.join(open_, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = against.where(F.col("angle") + F.col("widest") > limit).select("root", F.col("own").alias("i"), F.explode(others).alias("j"), F.lit(0).alias("side"), "node", "mult", "vector")
    right = against.select("root", F.explode(others).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "mult", "vector")
    counted = left.unionByName(right).groupBy("root", "i", "j").applyInArrow(_count_block(threshold), "node long, linked long")
    return sure.unionByName(counted.groupBy("node").agg(F.sum("linked").alias("linked")))


def near_duplicate_vectors(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, window: int = 256, miss: float = 1e-4, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `df`."""
    scratch = Scratch(df.sparkSession, "vectors")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    key = F.when(good, F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")))
    keyed = rows.withColumn("k", key)
    kind = rows.schema["vector"].dataType.simpleString()
    nodes = scratch.save(keyed.where("k IS NOT NULL").groupBy("k").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("vector").alias("vector")).withColumn("node", F.col("k.a")), "nodes")
    n = nodes.count()
    passes, hashing = passes_needed(n, threshold, window, miss), Hashing.of(n, window)
    links, seams = [], []
    for first in range(0, passes, _AT_ONCE):
        some = range(first, min(passes, first + _AT_ONCE))
        hashed = nodes.select("node", F.size("vector").alias("dim"), "vector").mapInArrow(_hashing(some, hashing, seed), f"pass int, dim int, run long, key long, node long, vector {kind}").drop("run")
        ordered = hashed.repartitionByRange("pass", "dim", "key", "node").sortWithinPartitions("pass", "dim", "key", "node")
        once = scratch.save(ordered.mapInArrow(_compare(window, threshold, True), _EDGE + kind), f"windows-{first}")
        links.append(once.where("u IS NOT NULL").select("u", "v"))
        seams.append(once.where("u IS NULL").select("pass", "dim", "key", "node", "vector"))
        del hashed, ordered
        scratch.reclaim()
    seam = reduce(DataFrame.unionByName, seams).dropDuplicates(["pass", "node", "key"]).repartition("pass").sortWithinPartitions("pass", "dim", "key", "node")
    more = seam.mapInArrow(_compare(window, threshold, False), _EDGE + kind)
    links = reduce(DataFrame.unionByName, links).unionByName(more.where("u IS NOT NULL").select("u", "v"))
    near = scratch.save(components(links, scratch), "near")
    crowded = components(_crowded_links(nodes, near, passes, hashing, threshold, window, seed), scratch, "crowded")
    merged = crowded.select(F.col("node").alias("root"), F.col("root").alias("least_root"))
    both = near.unionByName(crowded.select("node", F.col("node").alias("root")).join(near.select("node"), "node", "left_anti"))
    roots = scratch.save(both.join(merged, "root", "left").select("node", F.coalesce("least_root", "root").alias("root")), "roots")
    counts = _link_counts(nodes.select("node", "mult", "vector"), roots, threshold, scratch)
    known = nodes.select("k", "node", "mult", "least").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(named, "root").select("k", (F.coalesce("linked", "mult") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "k").join(known, "k", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    result = scratch.save(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), "result")
    scratch.keep("result")
    return result
