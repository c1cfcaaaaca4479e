"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text (shares of character classes, words, lines,
   repetition), computed for a slice of texts at once.
2. Boosted trees of depth three on labelled rows; every path from a root to a
   node is a rule, a conjunction of thresholds.
3. Logistic regression with an L1 penalty on the rules keeps few of them; the
   penalty is chosen on a part of the labelled rows set aside.
4. The rules are compiled into one Spark column expression over the statistics.

The model is fitted on at most `max_rows` labelled rows, those with the least
hash of their id.  Without labelled rows of both classes the score is the share
of label 1 (0.5 without any).

Defined results: null and empty texts have zero statistics and a score like any
other; labels that are null are ignored, of several labels for an id the largest
holds; repeated rows score alike; columns in the way of the operator's own are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import textbytes as tb
from weftline.llm.scratch import bound_batches

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_chars", "line_words", "upper", "digit", "space", "wide", "stop_sign", "bracket",
    "exclaim", "pipe", "odd_sign", "other_sign", "signed_word", "shout_word", "short_word", "long_word", "distinct_words", "top_word",
    "same_as_last", "distinct_pairs", "distinct_lines", "stopped_lines",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_CLASSES = {
    "upper": _UPPER,
    "digit": _table(b"0123456789"),
    "space": _table(b" \t\n\v\f\r"),
    "wide": _table(bytes(range(0xC0, 256))),
    "stop_sign": _table(b".,;:?"),
    "bracket": _table(b"()[]{}<>"),
    "exclaim": _table(b"!"),
    "pipe": _table(b"|"),
    "odd_sign": _table(b"#$%&*"),
    "other_sign": _table(b"\"'+-/=@\\^_`~"),
}


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the distinct keys and the count of the commonest."""
    n, top = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(keys[a:b])
            edge = np.flatnonzero(own[1:] != own[:-1]) + 1
            n[r] = len(edge) + 1
            top[r] = np.diff(np.concatenate([[0], edge, [b - a]])).max()
    return n, top


def statistics(part: tb.TextSlice) -> np.ndarray:
    """A row of STATISTICS for each row of the slice."""
    data, bounds = part.data, part.offsets
    size = np.maximum(1, np.diff(bounds) - _sums((data & 0xC0) == 0x80, bounds)).astype(float)
    chars = np.diff(bounds) - _sums((data & 0xC0) == 0x80, bounds)
    out = {name: _sums(table[data], bounds) / size for name, table in _CLASSES.items()}
    letters = np.maximum(1, _sums(_LETTER[data], bounds))
    out["upper"] = _sums(_UPPER[data], bounds) / letters
    upper_wide = np.zeros(len(data), bool)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    upper_wide[lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)]] = True
    out["upper"] += _sums(upper_wide, bounds) / letters
    upper_total = np.concatenate([[0], np.cumsum(_UPPER[data] | upper_wide, dtype=np.int64)])
    letter_total = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    found = tb.find_words(part, tb.NOT_SPACE)
    lines = tb.find_words(part, ~_table(b"\n"))
    s, e, rows = found.starts, found.ends, found.row_offsets
    n = np.maximum(1, np.diff(rows)).astype(float)
    last = data[e - 1] if len(e) else np.empty(0, np.uint8)
    odd = _CLASSES["odd_sign"] | _CLASSES["exclaim"] | _CLASSES["pipe"]
    up, letter = upper_total[e] - upper_total[s], letter_total[e] - letter_total[s]
    tb.lower_ascii(data)
    hashes = tb.span_hashes(data, s, e)
    line_hashes = tb.span_hashes(data, lines.starts, lines.ends)
    distinct, top = _distinct(hashes, rows)
    # pairs of words of one row; a row's last word has none with the next row's first
    owner = np.repeat(np.arange(part.rows), np.diff(rows))
    inside = owner[1:] == owner[:-1]
    pairs = tb.window_hashes(hashes, 2)[inside]
    before = np.concatenate([[0], np.cumsum(inside)])
    pair_bounds = before[np.minimum(rows, len(before) - 1)]
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & inside]) if len(hashes) else np.empty(0, bool)
    n_lines = np.maximum(1, np.diff(lines.row_offsets)).astype(float)
    out |= {
        "log_chars": np.log1p(chars),
        "log_words": np.log1p(np.diff(rows)),
        "log_lines": np.log1p(np.diff(lines.row_offsets)),
        "word_chars": size / n,
        "line_words": n / n_lines,
        "signed_word": _sums(odd[last], rows) / n,
        "shout_word": _sums((up == letter) & (up > 2), rows) / n,
        "short_word": _sums((e - s) <= 2, rows) / n,
        "long_word": _sums((e - s) >= 14, rows) / n,
        "distinct_words": distinct / n,
        "top_word": top / n,
        "same_as_last": _sums(same, rows) / n,
        "distinct_pairs": _distinct(pairs, pair_bounds)[0] / n,
        "distinct_lines": _distinct(line_hashes, lines.row_offsets)[0] / n_lines,
        "stopped_lines": _sums(_table(b".?!\"")[data[lines.ends - 1]] if len(lines.ends) else np.empty(0, bool), lines.row_offsets) / n_lines,
    }
    return np.column_stack([out[k] for k in STATISTICS]).astype(np.float64)


def _measure(text: str, out: str):
    kinds = pa.struct([(k, pa.float64()) for k in STATISTICS])

    @tb.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(p) for p in tb.slices(batch.column(text))]
            x = np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))
            names = [n for n in batch.schema.names if n != out]
            made = pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(len(STATISTICS))], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, out])

    return run


def with_statistics(docs: DataFrame, *, text: str = "text", out: str = "statistics") -> DataFrame:
    """`docs` with a struct of STATISTICS of each whole text."""
    bound_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != out]
    fields.append(T.StructField(out, T.StructType([T.StructField(k, T.DoubleType()) for k in STATISTICS])))
    return docs.mapInArrow(_measure(text, out), T.StructType(fields))


Condition = tuple[int, bool, float]  # statistic, above the threshold?, threshold


@dataclass
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        """The model as a Spark column over a struct of statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, above, t in conditions:
                c = stats[STATISTICS[k]]
                holds = holds & ((c > F.lit(t)) if above else (c <= F.lit(t)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same on the driver."""
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * rule_holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def rule_holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in conditions:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int, step: np.ndarray, rules: set) -> None:
    """Splits by the second-order gain over binned statistics; adds the node's value to `step` at the leaves."""
    g, h = grad[rows].sum(), hess[rows].sum()
    if path:
        rules.add(tuple(sorted(path)))
    best = (1e-6, None)
    if depth:
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            gs = np.cumsum(np.bincount(codes[rows, k], grad[rows], len(edges) + 1))[:-1]
            hs = np.cumsum(np.bincount(codes[rows, k], hess[rows], len(edges) + 1))[:-1]
            ns = np.cumsum(np.bincount(codes[rows, k], minlength=len(edges) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 10) | (len(rows) - ns < 10)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), (k, j))
    if best[1] is None:
        step[rows] += -g / (h + 1)
        return
    k, j = best[1]
    t = float(cuts[k][j])
    low = codes[rows, k] <= j
    _grow(x, cuts, codes, grad, hess, rows[low], (*path, (k, False, t)), depth - 1, step, rules)
    _grow(x, cuts, codes, grad, hess, rows[~low], (*path, (k, True, t)), depth - 1, step, rules)


def tree_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, seed: int = 7) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees, in a fixed order."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    rng, rules = np.random.default_rng(seed), set()
    margin = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(x))
        rows = np.flatnonzero(rng.random(len(x)) < 0.5)
        if len(rows) < 40:
            rows = np.arange(len(x))
        _grow(x, cuts, codes, p - y, p * (1 - p), rows, (), depth, step, rules)
        margin += rate * step
    return sorted(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 150) -> np.ndarray:
    """Weights, the free bias first, that minimise mean log loss + penalty * |weights|, by accelerated proximal steps."""
    n, k = r.shape
    w = np.zeros(k + 1) if start is None else start.copy()
    z, pace = w.copy(), 1.0
    v = np.ones(k + 1)
    for _ in range(12):
        u = v[0] + r @ v[1:]
        v = np.concatenate([[u.sum()], r.T @ u])
        v /= np.linalg.norm(v)
    u = v[0] + r @ v[1:]
    size = 4 * n / max(float(u @ u) * 1.05, 1e-12)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z[0] + r @ z[1:], -30, 30)))
        grad = np.concatenate([[(p - y).mean()], r.T @ (p - y) / n])
        new = z - size * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        ahead = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        z = new + (pace - 1) / ahead * (new - w)
        w, pace = new, ahead
    return w


def _loss(w: np.ndarray, r: np.ndarray, y: np.ndarray) -> float:
    m = w[0] + r @ w[1:]
    return float(np.mean(np.logaddexp(0, m) - y * m))


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, rules and weights from statistics and 0/1 labels, in any order of the rows that is fixed."""
    y = y.astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleModel(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    held = np.column_stack([rule_holds(x, c) for c in rules]).astype(np.float32) if rules else np.empty((len(x), 0), np.float32)
    kinds, keep = set(), []
    for k in range(held.shape[1]):
        if (key := held[:, k].tobytes()) not in kinds:
            kinds.add(key)
            keep.append(k)
    rules, held = [rules[k] for k in keep], held[:, keep]
    aside = np.arange(len(y)) % 4 == 3
    if y[~aside].min() == y[~aside].max():
        aside[:] = False
    best, w = (np.inf, 3e-3), None
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3):
        w = lasso_logistic(held[~aside], y[~aside], penalty, w)
        loss = _loss(w, held[aside], y[aside]) if aside.any() else np.inf
        best = min(best, (loss, penalty))
    w = lasso_logistic(held, y, best[1], steps=300)
    return RuleModel(float(w[0]), [(c, float(v)) for c, v in zip(rules, w[1:], strict=True) if abs(v) > 1e-6])


def held_out(doc_id: str) -> Column:
    """Rows that no model may learn from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 12_000) -> RuleModel:
    """A model from the labelled rows that aren't held out, `max_rows` at most."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("k")).agg(F.max(label).alias("y"))
    some = marked.orderBy(F.xxhash64("k"), "k").limit(max_rows)  # so many rows at most are broadcast
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k")
    measured = with_statistics(rows, text="t", out="s").groupBy("k", "y").agg(F.min("s").alias("s")).orderBy(F.xxhash64("k"), "k").collect()
    x = np.array([list(r["s"]) for r in measured], float).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([int(r["y"] > 0) for r in measured]))


def score_quality(docs: DataFrame, model: RuleModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of each whole text."""
    stats = "__statistics"
    return with_statistics(docs, text=text, out=stats).withColumn(out, model.column(F.col(stats))).drop(stats)
