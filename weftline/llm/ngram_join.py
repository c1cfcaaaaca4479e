"""Exact self-join of documents on word-shingle Jaccard similarity, for connected classes.

A document is the set of its distinct `words`-word shingles; two documents link
when `100 * |A & B| >= percent * |A | B|`.  The join is lossless:

* Prefix filter.  Sort a set of n by any global order of all shingles: sets with
  o in common share k among their first n - o + k.  Prefixes are a 25th of a set
  longer than k = 1 needs, so that documents which only share a passage fall
  short of the k that their sizes demand.
* Several global orders.  All orders put shingles of many documents last and
  break ties by different hashes.  How common a shingle is comes from a counting
  sketch over all documents, a counter per 64 bytes of text but 2**23 at most, so
  it may be broadcast.  Beyond some GB of text only shingles whose count stands out
  from a counter's mean still have a class of their own and the others are in hash
  order; any content of the sketch keeps the filter lossless.  A candidate pair
  must share k prefix shingles under every order before its sets are compared.
* Representatives.  Documents with equal sets are one node (a 60-bit digest), so
  copies never meet each other.
* Connectivity instead of pairs.  First every node is compared with one other: a
  node votes with a few of its prefix shingles for the node of each whose own
  shingles are the most common, as those of the original of a group of near copies
  are; these stars link such groups in linear work.  Then only pairs that share a
  prefix shingle across different components are left.  Nodes that share too little
  with partners of any size at hand fall out one by one.  The rest are counted
  under all orders: at shingles of few nodes pair by pair, at the others in blocks
  of their leader's nodes, by bit matrices of the prefixes; and only what passes
  the intersection of all orders has its texts compared.  What is skipped is
  connected already, so the classes are exact.

The texts of a candidate group are streamed past its leader's set in one task; a
leader of many candidates is dealt to several tasks.

Defined results: a null or empty text, or one without words, has no shingles and
links with nothing; a row with a null id gets its count and a null class; rows
that repeat an id are returned one by one, with the class of their text; columns
other than id and text are ignored, whatever their names; texts of any length are
one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import textbytes as tb
from weftline.llm.components import components
from weftline.llm.packed import pack_counts, sum_counts
from weftline.llm.scratch import Scratch

_CHUNKS = 128
_SEEDS = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89]
#: A prefix is longer than necessary by the set's size over this.
_EXTRA = 25
#: Postings of a very common shingle are dealt to buckets of about so many.
_BUCKET = 250_000
#: At a shingle of more nodes, pairs are counted by blocks.
_FEW = 48
#: Nodes on either side of a block of prefixes, and of one of texts.
_WIDE = 4096
_SIDE = 256
#: Candidates that one task compares with a leader.
_GROUP = 2000
#: Prefix shingles of a node, under each order, that vote for its star centre.
_VOTES = 8
#: Bits of a node; a node's rank as a star centre is above them.
_NODE_BITS = 60
#: Bits of a shingle within its bucket.
_LOCAL_BITS = 37


def _node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little") >> 64 - _NODE_BITS


def _scan(words: int, bits: int):
    """Per document (id, text's hash) its set's size and node; per task the sketch of its shingles."""

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)  # a task's counts stop at the largest; what is common stays common
        id_type = None
        names = ["doc_id", "said", "n", "node", "chunk", "counts"]
        for batch in batches:
            sizes, nodes = [], []
            id_type = batch.column(0).type
            for part in tb.slices(batch.column(2)):
                held = list(tb.shingle_sets(part, words))
                sizes += [len(own) for own in held]
                nodes += [_node(own) if len(own) else None for own in held]
                slot = np.sort((np.concatenate(held) & np.uint64((1 << bits) - 1)).astype(np.uint32))
                if len(slot):
                    first = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1])
                    slot, more = slot[first], np.diff(np.append(first, len(slot)))
                    counts[slot] = np.minimum(counts[slot] + more, 65535)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if id_type is not None and counts.any():
            packed = [pack_counts(c) for c in np.split(counts, _CHUNKS)]
            none = pa.nulls(_CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(_CHUNKS, id_type), none, none, none, pa.array(range(_CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names)

    return run


def _classing(mean: float):
    """A summed counter's class: 0 if within noise of the mean, else one that grows with the count, two to an octave."""

    def run(counts: np.ndarray) -> bytes:
        over = counts - mean
        cls = np.maximum(np.ceil(2 * np.log2(np.maximum(over, 1.0))), 1)
        return np.where(over <= 5 * mean**0.5 + 4, 0, cls).astype(np.uint8).tobytes()

    return run


class _Orders:
    def __init__(self, classes: np.ndarray, percent: int):
        self.classes, self.percent = classes, percent
        self.mask = np.uint64(len(classes) - 1)

    def least(self, n: int) -> int:
        """The overlap that any set linked with one of n shingles has with it at least."""
        return -(-self.percent * n // 100)

    def prefix(self, own: np.ndarray, order: int) -> np.ndarray:
        """The shingles that come first under an order; as many as are necessary."""
        n = len(own)
        if not n:
            return own
        key = self.classes[(own & self.mask).astype(np.int64)].astype(np.uint64) << np.uint64(56) | tb.mix64(own ^ np.uint64(_SEEDS[order])) >> np.uint64(8)
        p = min(n - 1, n - self.least(n) + n // _EXTRA)
        return own[key <= np.partition(key, p)[p]]

    def rank(self, own: np.ndarray) -> int:
        """0 to 7, the higher the fewer of a set's shingles are uncommon."""
        rare = int((self.classes[(own & self.mask).astype(np.int64)] == 0).sum())
        return 7 - min(7, (rare.bit_length() + 1) // 2)


def _postings(words: int, shared, buckets: int, n_orders: int):
    """(bucket, salted, shingles, nodes): the prefixes of each distinct set in the task.

    A shingle has its order in the two low bits, then whether it votes, then its hash: 5 bytes within its
    bucket, or 8 where the shingle is so common that it is dealt to several buckets.
    """

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: _Orders = shared.value
        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        votes: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            order_of = np.repeat(np.arange(len(tokens), dtype=np.uint64) % np.uint64(n_orders), [len(x) for x in tokens])
            t, v, voting = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(votes).astype(np.uint64)
            tokens.clear(), votes.clear(), nodes.clear()
            held = 0
            cls = orders.classes[(t & orders.mask).astype(np.int64)].astype(np.int64)
            parts = np.maximum(1, np.ceil(2.0 ** (cls / 2) / _BUCKET)).astype(np.uint64)
            h = tb.mix64(t + order_of * np.uint64(0x632BE59BD9B4E019))
            flags = voting << np.uint64(2) | order_of
            many = parts > 1
            bucket = h % np.uint64(buckets)
            code = (h // np.uint64(buckets) & np.uint64((1 << _LOCAL_BITS) - 1)) << np.uint64(3) | flags
            if many.any():
                salt = tb.mix64(v[many].view(np.uint64)) % parts[many]
                bucket[many] = tb.mix64(h[many] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
                code[many] = h[many] & ~np.uint64(7) | flags[many]
            place = bucket.astype(np.int64) * 2 + many
            order = np.argsort(place, kind="stable")
            place, code, v = place[order], code[order], v[order]
            cut = np.flatnonzero(np.diff(place)) + 1
            first = np.concatenate([[0], cut])
            raw = code.astype("<u8").view(np.uint8).reshape(-1, 8)
            told = [x.tobytes() if p & 1 else x[:, :5].tobytes() for p, x in zip(place[first].tolist(), np.split(raw, cut), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[first] // 2), pa.array(place[first] % 2), pa.array(told, pa.binary()), pa.array([x.tobytes() for x in np.split(v, cut)], pa.binary())],
                ["bucket", "salted", "tokens", "nodes"],
            )

        for batch in batches:
            for part in tb.slices(batch.column(0)):
                for own in tb.shingle_sets(part, words):
                    if not len(own):
                        continue
                    node = _node(own)
                    if node in seen:
                        continue
                    seen.add(node)
                    ranked = orders.rank(own) << _NODE_BITS | node
                    for k in range(n_orders):
                        some = orders.prefix(own, k)
                        tokens.append(some)
                        votes.append(some <= np.partition(some, _VOTES)[_VOTES] if len(some) > _VOTES else np.ones(len(some), bool))
                        nodes.append(np.full(len(some), ranked, np.int64))
                        held += len(some)
                    if held > 250_000:
                        yield from flush()
        yield from flush()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Postings of shingles that several nodes have (or, where salted, may have); `lead` is whom a posting votes for."""
    bucket = table.column("bucket")[0].as_py()
    mask = np.int64((1 << _NODE_BITS) - 1)
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
    salted = np.asarray(table.column("salted"))
    columns = [table.column(c).combine_chunks() for c in ("tokens", "nodes")]
    for flag in (0, 1):
        rows = np.flatnonzero(salted == flag).tolist()
        if not rows:
            continue
        raw = np.concatenate([np.frombuffer(columns[0][r].as_buffer(), np.uint8) for r in rows])
        v = np.concatenate([np.frombuffer(columns[1][r].as_buffer(), np.int64) for r in rows])
        if flag:
            t = raw.view("<u8").astype(np.uint64)
        else:
            wide = np.zeros((len(v), 8), np.uint8)
            wide[:, :5] = raw.reshape(-1, 5)
            t = wide.view("<u8").ravel().astype(np.uint64)
        votes, t = (t >> np.uint64(2) & np.uint64(1)).astype(bool), t & ~np.uint64(4)
        if not flag:
            t = (np.uint64(bucket) << np.uint64(_LOCAL_BITS) | t >> np.uint64(3)) << np.uint64(2) | t & np.uint64(3)
        order = np.lexsort((v, t))
        t, v, votes = t[order], v[order], votes[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        t, v, votes = t[new], v[new], votes[new]
        first = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
        n = np.diff(np.append(first, len(t)))
        lead = np.repeat(v[first + n - 1], n)
        keep = slice(None) if flag else np.repeat(n, n) > 1
        lead = np.where(votes & (lead != v), lead & mask, -1)
        for held, values in zip(out, (t.view(np.int64), v & mask, np.full(len(t), flag, np.int64), lead), strict=True):
            held.append(values[keep])
    token, node, many, lead = (np.concatenate(x) for x in out)
    found = pa.table({"token": token, "node": node, "salted": many == 1, "lead": pa.array(lead, mask=lead < 0)})
    tb.release()
    return found


def _dealing(buckets: int):
    """(token, node, root, n) to (bucket, tokens, nodes, roots, sizes), byte planes that compress well."""

    def planes(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            t, v, r, n = (np.asarray(rows.column(c)) for c in ("token", "node", "root", "n"))
            bucket = (tb.mix64(t.view(np.uint64) >> np.uint64(_LOCAL_BITS + 2)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, t, v, r, n = (x[order] for x in (bucket, t, v, r, n))
            cut = np.flatnonzero(np.diff(bucket)) + 1
            told = [pa.array([planes(x) for x in np.split(y, cut)], pa.binary()) for y in (t, v, v ^ r, n)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cut])]), *told], ["bucket", "tokens", "nodes", "roots", "sizes"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_held += batch.num_rows
            if n_held > 500_000:
                yield flush()
                n_held = 0
        if held:
            yield flush()

    return run


def _open(table: pa.Table) -> pa.Table:
    """The postings of a bucket's shingles whose nodes have several roots."""

    def read(name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        parts = [np.frombuffer(column[r].as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for r in range(len(column))]
        return np.concatenate(parts)

    t, v, r, n = (read(c) for c in ("tokens", "nodes", "roots", "sizes"))
    r ^= v
    order = np.lexsort((r, t))
    t, v, r, n = (x[order] for x in (t, v, r, n))
    first = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
    m = np.diff(np.append(first, len(t)))
    keep = np.repeat(r[first] != r[first + m - 1], m)
    return pa.table({"token": t[keep], "node": v[keep], "root": r[keep], "n": n[keep]})


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    return int((b[k] == a).sum())


def _verify(words: int, percent: int):
    """Streams (a, salt, kind, node, text), leaders first in each (a, salt); yields which candidates link."""

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, None
        for batch in batches:
            groups = list(zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            kinds, nodes = batch.column("kind").to_pylist(), batch.column("node").to_pylist()
            left, right = [], []
            for part in tb.slices(batch.column("text")):
                for r, own in enumerate(tb.shingle_sets(part, words), part.first):
                    if not len(own) or _node(own) != nodes[r]:
                        continue  # texts of equal hash
                    if kinds[r] == 0:
                        group, lead = groups[r], own
                        continue
                    if groups[r] != group:
                        continue
                    n, m = len(lead), len(own)
                    if 100 * min(n, m) < percent * max(n, m):
                        continue
                    both = _overlap(lead, own)
                    if 100 * both >= percent * (n + m - both):
                        left.append(group[0])
                        right.append(nodes[r])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return run


def _block_links(words: int, percent: int):
    """Links between two blocks of texts of one leader, at most one for each node and component of the other side."""

    def run(table: pa.Table) -> pa.Table:
        side, root, node = (np.asarray(table.column(c)) for c in ("side", "root", "node"))
        sets: list[np.ndarray] = []
        for part in tb.slices(table.column("text")):
            sets.extend(tb.shingle_sets(part, words))
        good = np.array([len(x) > 0 and _node(x) == v for x, v in zip(sets, node.tolist(), strict=True)], bool)
        left, right = np.flatnonzero((side == 0) & good), np.flatnonzero((side == 1) & good)
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return none
        flat = [np.concatenate([sets[r] for r in rows]) for rows in (left, right)]
        vocabulary = np.intersect1d(*(np.unique(x) for x in flat), assume_unique=True)
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(vocabulary), 8192):
            some = vocabulary[at : at + 8192]
            dense = []
            for rows, values in zip((left, right), flat, strict=True):
                k = np.searchsorted(some, values)
                k[k == len(some)] = 0
                hit = some[k] == values
                m = np.zeros((len(rows), len(some)), np.float32)
                m[np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])[hit], k[hit]] = 1
                dense.append(m)
            both += dense[0] @ dense[1].T
        size = np.array([len(x) for x in sets], np.int64)
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (root[left][:, None] != root[right][None, :])
        i, j = np.nonzero(linked)
        pairs = np.unique(np.stack([i, root[right][j]]), axis=1, return_index=True)[1]
        return pa.table({"u": node[left][i[pairs]], "v": node[right][j[pairs]]})

    return run


def _passing(percent: int, n_orders: int):
    """Nodes of two blocks (side 0 and 1) that share enough under every order with any node of another component.

    Rows hold the crowded shingles of a node with their weights by order, and `few`, what it has at other
    shingles; two nodes share at most the lesser of that.  Yields (i, j, side, node, root) for sub-blocks of
    texts, numbered within the blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        side, node, root, n = (np.asarray(table.column(c)) for c in ("side", "node", "root", "n"))
        lists = table.column("tokens").combine_chunks()
        lengths = np.asarray(lists.value_lengths()).astype(np.int64)
        flat = np.asarray(lists.flatten())
        weights = [np.asarray(table.column(f"w{k}").combine_chunks().flatten()).astype(np.float32) for k in range(n_orders)]
        few = [np.asarray(table.column(f"f{k}")).astype(np.float32) for k in range(n_orders)]
        vocabulary, at = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(node[left])], right[np.argsort(node[right])]
        itself = table.column("i")[0] == table.column("j")[0]
        out: list[list[np.ndarray]] = [[] for _ in range(3)]

        def dense(rows: np.ndarray, values: np.ndarray | None, lo: int, hi: int) -> np.ndarray:
            m = np.zeros((len(rows), hi - lo), np.float32)
            spans = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            place = np.repeat(np.arange(len(rows)), lengths[rows])
            some = (at[spans] >= lo) & (at[spans] < hi)
            spans, place = spans[some], place[some]
            m[place, at[spans] - lo] = 1 if values is None else values[spans]
            return m

        for i in range(0, len(left), _SIDE):
            x = left[i : i + _SIDE]
            for j in range(i if itself else 0, len(right), _SIDE):
                y = right[j : j + _SIDE]
                both = [np.minimum(f[x][:, None], f[y][None, :]) for f in few]
                for lo in range(0, len(vocabulary), 4096):
                    hi = min(len(vocabulary), lo + 4096)
                    other = dense(y, None, lo, hi).T
                    for k in range(n_orders):
                        both[k] = both[k] + dense(x, weights[k], lo, hi) @ other
                ok = (root[x][:, None] != root[y][None, :]) & (np.minimum.reduce(both) >= _must_share(n[x][:, None], n[y][None, :], percent))
                ok &= 100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :])
                for s, rows, any_ in ((0, x, ok.any(axis=1)), (1, y, ok.any(axis=0))):
                    rows = rows[any_]
                    out[0].append(np.full(len(rows), (i // _SIDE) << 20 | j // _SIDE, np.int64))
                    out[1].append(np.full(len(rows), s, np.int64))
                    out[2].append(rows)
        sub, s, rows = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        first = {c: np.full(len(rows), table.column(c)[0].as_py(), np.int64) for c in ("a", "i", "j")}
        return pa.table(first | {"sub": sub, "side": s, "node": node[rows], "root": root[rows]})

    return run


def _must_share(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix shingles linked sets of these sizes share at least under each order."""
    spare = [np.minimum(n - 1, n + -percent * n // 100 + n // _EXTRA) + 1 - n for n in (na, nb)]
    return -(-percent * (na + nb) // (100 + percent)) + np.minimum(*spare)


class _Join:
    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, percent: int, n_orders: int):
        self.scratch = Scratch(docs.sparkSession, "ngram")
        # an id may stand for several texts, so a text is known by its hash as well
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("said"), F.col(text).alias("text"))
        self.words, self.percent, self.n_orders = words, percent, n_orders
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.bits = min(23, max(16, (int(size) // 64).bit_length()))

    def sketch(self) -> DataFrame:
        """Sizes and nodes of all documents; broadcasts the orders."""
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        scanned = self.scratch.save(self.docs.mapInArrow(_scan(self.words, self.bits), f"doc_id {kind}, said long, n long, node long, chunk int, counts binary"), "scan")
        shingles = int(scanned.agg(F.sum("n")).first()[0] or 0)
        self.buckets = max(16, -(-shingles * self.n_orders * (105 - self.percent) // 100 // _BUCKET))
        sums = sum_counts(scanned.where("chunk IS NOT NULL").select(F.col("chunk").alias("key"), "counts"), _classing(shingles / (1 << self.bits)))
        classes = np.zeros((_CHUNKS, (1 << self.bits) // _CHUNKS), np.uint8)
        for r in sums.collect():
            classes[r["key"]] = np.frombuffer(r["counts"], np.uint8)
        self.orders = self.docs.sparkSession.sparkContext.broadcast(_Orders(classes.ravel(), self.percent))
        return scanned.where("chunk IS NULL").select("doc_id", "said", "n", "node")

    def postings(self) -> DataFrame:
        """Prefix shingles with the nodes that share them, and the votes for star centres."""
        texts = self.docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text")
        posted = texts.mapInArrow(_postings(self.words, self.orders, self.buckets, self.n_orders), "bucket long, salted long, tokens binary, nodes binary")
        return self.scratch.save(posted.groupBy("bucket").applyInArrow(_shared, "token long, node long, salted boolean, lead long"), "shared")

    def with_text(self, roles: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """`roles` (node and more) with the text of each node's representative."""
        roles = self.scratch.save(roles.join(nodes.select("node", "doc_id", "said"), "node"), f"{name}-roles")
        # documents that no role needs stay out of the shuffle: a table of at most 2**20 slots
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
        wanted = F.broadcast(roles.select(slot.alias("slot")).distinct())
        texts = self.docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("slot", slot).join(wanted, "slot", "left_semi").drop("slot")
        return roles.join(texts, ["doc_id", "said"]).drop("doc_id", "said")

    def verify(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of nodes that link, as (u, v)."""
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(_GROUP)).alias("parts"))
        dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
        roles = dealt.select("a", "salt", F.lit(1).alias("kind"), F.col("b").alias("node")).unionByName(dealt.select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("node")).distinct())
        sent = self.with_text(roles, nodes, name).select("a", "salt", "kind", "node", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
        return self.scratch.save(sent.mapInArrow(_verify(self.words, self.percent), "u long, v long"), name)

    def stars(self, shared: DataFrame, nodes: DataFrame) -> DataFrame:
        """(a, b): for each node the one that most of its votes are for, unless these are few of them."""
        votes = shared.where("lead IS NOT NULL").groupBy("node", F.col("lead").alias("a")).agg(F.count("*").alias("both"))
        best = votes.groupBy("node").agg(F.max(F.struct("both", "a")).alias("m")).join(nodes.select("node", "n"), "node")
        cast = self.n_orders * F.least(F.lit(_VOTES), self.prefix_size("n"))
        return best.where(4 * F.col("m.both") >= cast).select(F.col("m.a").alias("a"), F.col("node").alias("b"))

    def prefix_size(self, n: str) -> Column:
        return F.least(F.col(n) - 1, F.col(n) - F.floor((self.percent * F.col(n) + 99) / F.lit(100)) + F.floor(F.col(n) / F.lit(_EXTRA))) + 1

    def must_share(self, a: Column, b: Column) -> Column:
        """`_must_share` as an expression."""
        spare = [F.least(n - 1, n - F.floor((self.percent * n + 99) / F.lit(100)) + F.floor(n / F.lit(_EXTRA))) + 1 - n for n in (a, b)]
        return F.floor((self.percent * (a + b) + 99 + self.percent) / F.lit(100 + self.percent)) + F.least(*spare)

    def least_of(self, prefix: str) -> Column:
        return F.least(*(F.col(f"{prefix}{k}") for k in range(self.n_orders)), F.lit(1 << 60).cast("long"))

    def by_order(self) -> list[Column]:
        return [F.count(F.when(F.col("token").bitwiseAND(3) == k, 1)).alias(f"w{k}") for k in range(self.n_orders)]

    def across(self, shared: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
        """Postings (token, node, root, n) at shingles of several components, of nodes that share enough with any others."""
        own = Window.partitionBy("node")
        placed = shared.select("token", "node", "salted").join(nodes.select("node", "n"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        for k in range(self.n_orders):
            placed = placed.withColumn(f"w{k}", F.sum(F.when(F.col("token").bitwiseAND(3) == k, 1).otherwise(0)).over(own))
        enough = F.lit(1) + F.floor(self.percent * F.col("n") / F.lit(100 * _EXTRA))
        placed = self.scratch.save(placed.where(self.least_of("w") >= enough).select("token", "node", "root", "n", "salted"), "placed")
        dealt = placed.where("NOT salted").drop("salted").mapInArrow(_dealing(self.buckets), "bucket long, tokens binary, nodes binary, roots binary, sizes binary")
        found = dealt.groupBy("bucket").applyInArrow(_open, "token long, node long, root long, n long")
        return self.scratch.save(found.unionByName(placed.where("salted").drop("salted")), "across")

    def open_postings(self, across: DataFrame) -> DataFrame:
        """(token, node, root, n, m, lead, weights), each token standing for all that have the same nodes."""
        marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
        split = across.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.max("node").alias("lead"), F.min("n").alias("least"), F.max("n").alias("most"), *marks).where("lo != hi")
        # the shingles of a passage have the same nodes: one of them stands for all, with their number under each order
        alike = split.groupBy("m", "x1", "x2").agg(F.min("token").alias("token"), F.max("lead").alias("lead"), F.min("least").alias("least"), F.max("most").alias("most"), *self.by_order())
        met = across.join(alike.drop("x1", "x2"), "token")
        own = Window.partitionBy("node")
        for k in range(self.n_orders):
            met = met.withColumn(f"s{k}", F.sum(f"w{k}").over(own))
        # partners have sizes between these, and what must be shared with them is least at either end (2 for rounding)
        smaller = F.greatest(F.min("least").over(own), F.floor(self.percent * F.col("n") / F.lit(100)))
        larger = F.least(F.max("most").over(own), F.ceil(100 * F.col("n") / F.lit(self.percent)))
        met = met.withColumn("lo", F.least("n", smaller)).withColumn("hi", F.greatest("n", larger))
        need = F.greatest(F.lit(1), F.least(self.must_share(F.col("n"), F.col("lo")), self.must_share(F.col("n"), F.col("hi"))) - 2)
        kept = met.where(self.least_of("s") >= need)
        return self.scratch.save(kept.select("token", "node", "root", "n", "m", "lead", *(f"w{k}" for k in range(self.n_orders))), "open")

    def pairs(self, open_: DataFrame) -> DataFrame:
        """Pairs (a, b) that share enough under every order at shingles of few nodes."""
        weights = [f"w{k}" for k in range(self.n_orders)]
        few = open_.where(F.col("m") <= _FEW)
        x, y = few.select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), *weights), few.select("token", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
        both = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")))
        both = both.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), *(F.sum(w).alias(w) for w in weights))
        # what a pair shares at shingles of many nodes isn't counted here, but pairs that share any are counted in blocks
        return both.where(self.least_of("w") >= self.must_share(F.col("na"), F.col("nb"))).select("a", "b")

    def block_pairs(self, open_: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Links across components between nodes that share any shingle of many nodes."""
        orders = range(self.n_orders)
        crowded = open_.where(F.col("m") > _FEW)
        leads = crowded.select("lead", "node").distinct()
        few = [F.sum(F.when(F.col("m") <= _FEW, F.col(f"w{k}")).otherwise(0)).alias(f"f{k}") for k in orders]
        lists = F.sort_array(F.collect_list(F.when(F.col("m") > _FEW, F.struct("token", *(f"w{k}" for k in orders)))))
        own = open_.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), lists.alias("l"), *few).where(F.size("l") > 0)
        own = own.select("node", "root", "n", F.col("l.token").alias("tokens"), *(F.col(f"l.w{k}").alias(f"w{k}") for k in orders), *(f"f{k}" for k in orders))
        # blocks of a leader hold nodes of about one size; those whose sizes can't link don't meet
        kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.12)))).cast("long")
        placed = leads.join(own.select("node", "n"), "node").select(F.col("lead").alias("a"), "node", kind.alias("kind"))
        counts = placed.groupBy("a", "kind").agg(F.count("*").alias("own"))
        totals = counts.groupBy("a").agg(F.sum("own").alias("all"))
        sized = counts.join(totals, "a").select("a", "kind", "own", (F.col("all") > _WIDE).alias("wide"))
        kinds = sized.groupBy("a", F.when(F.col("wide"), F.col("kind")).otherwise(-1).alias("group")).agg(F.ceil(F.sum("own") / F.lit(_WIDE)).alias("parts"))
        blocks = kinds.select("a", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        blocks = blocks.select("a", "group", (F.col("group") * (1 << 32) + F.col("part")).alias("block"))
        apart = int(np.ceil(np.log(100 / self.percent) / np.log(1.12))) + 1
        x, y = blocks.select("a", F.col("group").alias("gi"), F.col("block").alias("i")), blocks.select("a", F.col("group").alias("gj"), F.col("block").alias("j"))
        meet = x.join(y, "a").where((F.col("i") <= F.col("j")) & (F.abs(F.col("gi") - F.col("gj")) <= apart)).select("a", "i", "j")
        ends = meet.select("a", F.col("i").alias("block"), "i", "j", F.lit(0).alias("side")).unionByName(meet.select("a", F.col("j").alias("block"), "i", "j", F.lit(1).alias("side")))
        wide = totals.where(F.col("all") > _WIDE).select("a")
        group = F.when(F.col("is_wide"), F.col("kind")).otherwise(-1)
        rows = placed.join(wide.withColumn("is_wide", F.lit(True)), "a", "left").select("a", "node", group.alias("group"))
        rows = rows.join(kinds, ["a", "group"]).select("a", "node", (F.col("group") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
        sent = rows.join(ends, ["a", "block"]).drop("block").join(own, "node")
        passing = sent.groupBy("a", "i", "j").applyInArrow(_passing(self.percent, self.n_orders), "a long, i long, j long, sub long, side long, node long, root long")
        passing = self.scratch.save(passing, f"{name}-passing")
        met = self.with_text(passing, nodes, name).select("a", "i", "j", "sub", "side", "node", "root", "text")
        return self.scratch.save(met.groupBy("a", "i", "j", "sub").applyInArrow(_block_links(self.words, self.percent), "u long, v long"), name)

    def run(self) -> DataFrame:
        info = self.sketch()
        has = info.where("node IS NOT NULL AND doc_id IS NOT NULL")
        shared = self.postings()
        nodes = has.groupBy("node").agg(F.min(F.struct("doc_id", "said")).alias("rep"), F.min("n").alias("n"))
        nodes = self.scratch.save(nodes.select("node", "rep.doc_id", "rep.said", "n"), "nodes")
        self.scratch.reclaim()
        stars = self.scratch.save(self.stars(shared, nodes), "stars")
        links = self.verify(stars, nodes, "links")
        self.scratch.reclaim()
        roots = self.scratch.save(components(links, self.scratch, "cc1"), "roots1")
        across = self.across(shared, nodes, roots)
        self.scratch.drop("shared", "placed", "links-roles", "links")
        self.scratch.reclaim()
        open_ = self.open_postings(across)
        rest = self.pairs(open_)
        more = self.verify(self.scratch.save(rest.join(stars, ["a", "b"], "left_anti"), "rest"), nodes, "links2")
        more = more.unionByName(self.block_pairs(open_, nodes, "links3"))
        lifted = more.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("u", F.coalesce("root", "u")).drop("root")
        lifted = lifted.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("v", F.coalesce("root", "v")).select("u", "v")
        roots2 = self.scratch.save(components(lifted, self.scratch, "cc2"), "roots2")
        final = nodes.select("node", F.col("doc_id").alias("rep")).join(roots, "node", "left").withColumn("r1", F.coalesce("root", "node")).drop("root")
        final = final.join(roots2.withColumnRenamed("node", "r1"), "r1", "left").withColumn("root", F.coalesce("root", "r1"))
        named = final.groupBy("root").agg(F.min("rep").alias("component_id"))
        classes = final.join(named, "root").select("node", "component_id")
        out = info.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        result = self.scratch.save(out, "result")
        self.scratch.keep("result")
        self.orders.destroy()
        return result


def near_duplicate_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, n_orders: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`; component_id is the least id reachable by links."""
    return _Join(docs, doc_id, text, words, percent, n_orders).run()


def keep_one_per_class(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that have their class's least id, once each, with the columns of `docs`.

    Rows with a null id are in no class and stay; rows with one id but different texts are different documents.
    """
    classes = near_duplicate_classes(docs, doc_id=doc_id, text=text, **options)
    least = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__least")).distinct()
    mark = "__text_hash"
    named = docs.where(F.col(doc_id).isNotNull()).join(least, F.col(doc_id) == F.col("__least"), "left_semi")
    named = named.withColumn(mark, F.xxhash64(text)).dropDuplicates([doc_id, mark]).drop(mark)
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
