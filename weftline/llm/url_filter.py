"""URL filter: rules first, and for the rest the likelihood ratio of two character models.

URLs that a rule allows train one smoothed variable-order Markov model, those it
blocks another: an order-k estimate is the count of the character after the k
characters before it, smoothed by the estimate of order k - 1, down to single
characters.  A URL's score is the difference of its log-likelihoods divided by
its length.  The models read the whole URL with its host in lower case: scheme,
path, query string and fragment with it.  A logistic curve that turns scores into
verdicts is fitted on a quarter of the rule-judged URLs, by models of the others
alone; the verdicts are then given by models of all rule-judged URLs.

Counts are a table keyed by a character and
the ORDER before it, exactly and without hashing, that grows with the input.  URLs
are dealt to chunks, whose distinct keys are joined to the counts, so that a key
that all URLs share is joined once a chunk.

Defined results: null URLs and those without `://` have an empty host and path;
the former are judged as the empty text, the latter as they stand; where the rules leave one of the models
without URLs every remaining URL is allowed; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import textbytes as tb
from weftline.llm.scratch import Scratch

ORDER, SMOOTH = 5, 1.5
_SYMBOL, _START, _END = 9, 256, 257
#: Kinds of URLs: blocked and allowed ones that make the models, the same set aside, all others.
_ASIDE, _KINDS = 2, 4
_N = [f"n{c}" for c in range(_KINDS)]
#: Models that calibrate and models that judge: the counts of blocked and allowed URLs of each.
_MODELS = {"trial": ("trial_blocked", "trial_allowed"), "full": ("blocked", "allowed")}
_CLASSES = [c for pair in _MODELS.values() for c in pair]
#: Text of a chunk of URLs, and grams held before they are counted.
_CHUNK_BYTES, _HELD = 1 << 16, 1 << 20
_BINS, _BIN = 400, 0.025

Rule = tuple[str, str]  # rule such as `net/`, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def whole_text(url: Column) -> Column:
    """The URL with A-Z of its host lower-cased; empty for null."""
    pattern = r"(?s)^(.*?://)([^/?#]*)(.*)$"
    host = F.translate(F.regexp_extract(url, pattern, 2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(url.contains("://"), F.concat(F.regexp_extract(url, pattern, 1), host, F.regexp_extract(url, pattern, 3))).otherwise(url), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(part: tb.TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds, and per character the key of it (lowest) and the ORDER before it; an order-k context with its character is the lowest k + 1 symbols."""
    n = np.diff(part.offsets)
    room = n + ORDER + 1
    begin = np.cumsum(room) - room
    text = np.full(int(room.sum()), _START, np.int64)
    where = np.repeat(begin + ORDER - part.offsets[:-1], n) + np.arange(len(part.data))
    text[where] = part.data
    text[begin + ORDER + n] = _END
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    at = np.repeat(begin + ORDER - bounds[:-1], n + 1) + np.arange(bounds[-1])
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram << _SYMBOL | text[at - k]
    return bounds, gram


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, text) to (chunk, gram, n0, n1, ...): the grams of each chunk with their counts by kind."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        chunk, gram, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((gram, chunk))
        chunk, gram, kind = chunk[order], gram[order], kind[order]
        new = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (gram[1:] != gram[:-1])])
        first = np.flatnonzero(new)
        n = [np.add.reduceat((kind == c).astype(np.int64), first) for c in range(_KINDS)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (chunk[first], gram[first], *n)], ["chunk", "gram", *_N])

    for batch in batches:
        chunks, kinds = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1))
        for part in tb.slices(batch.column(2)):
            bounds, gram = _grams(part)
            rows = np.repeat(np.arange(part.first, part.first + part.rows), np.diff(bounds))
            held.append((chunks[rows], gram, kinds[rows]))
        if sum(len(g) for _, g, _ in held) > _HELD:
            yield counted()
            held = []
    if held:
        yield counted()


def _log_ratios(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, trial, full) for each gram of `counts` (gram and the counts of _MODELS): differences of its log-probabilities.

    Counts of shorter contexts are sums of those of longer ones.  A gram has at most
    2**_SYMBOL extensions by a symbol, so neither joins nor windows have hot keys.
    """
    levels = [scratch.save(counts, f"order-{ORDER}")]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND((1 << _SYMBOL * (k + 1)) - 1).alias("gram")
        levels.insert(0, scratch.save(levels[0].groupBy(shorter).agg(*(F.sum(c).alias(c) for c in _CLASSES)), f"order-{k}"))
    context = Window.partitionBy(F.shiftright("gram", _SYMBOL))
    below = None
    for k, level in enumerate(levels):
        level = level.select("gram", *_CLASSES, *(F.sum(c).over(context).alias(f"{c}_of") for c in _CLASSES))
        if below is None:
            level = level.select("*", *(F.lit(1.0 / 256).alias(f"{c}_p") for c in _CLASSES))
        else:
            level = level.withColumn("shorter", F.col("gram").bitwiseAND((1 << _SYMBOL * k) - 1)).join(below.withColumnRenamed("gram", "shorter"), "shorter")
        below = level.select("gram", *(((F.col(c) + SMOOTH * F.col(f"{c}_p")) / (F.col(f"{c}_of") + SMOOTH)).alias(f"{c}_p") for c in _CLASSES))
    return below.select("gram", *((F.log(f"{allowed}_p") - F.log(f"{blocked}_p")).alias(model) for model, (blocked, allowed) in _MODELS.items()))


def _score(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a chunk with the mean ratios of their characters by both models, from the ratios of all the chunk's grams."""
    order = np.argsort(np.asarray(known.column("gram")))
    grams, *ratios = (np.asarray(known.column(c))[order] for c in ("gram", *_MODELS))
    scores = [np.empty((len(_MODELS), 0))]
    for part in tb.slices(rows.column("__text")):
        bounds, gram = _grams(part)
        at = np.searchsorted(grams, gram)
        scores.append(np.stack([np.add.reduceat(r[at], bounds[:-1]) for r in ratios]) / np.diff(bounds))
    for model, score in zip(_MODELS, np.concatenate(scores, axis=1), strict=True):
        rows = rows.append_column(f"__{model}", pa.array(score))
    return rows


def _logistic(x: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of sigmoid(slope * x + offset) for binned counts n[0] (blocked) and n[1] (allowed), classes weighted alike."""
    w = np.maximum(n, 0) / np.maximum(n.sum(axis=1, keepdims=True), 1)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = w[1] * (p - 1) + w[0] * p
        h = (w[0] + w[1]) * p * (1 - p)
        ga, gb = (g * x).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return float(a), float(b)


def _calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset from the trial scores of the URLs set aside; 1 and 0 where a class has none."""
    place = F.least(F.greatest(F.floor(F.col("__trial") / F.lit(_BIN)) + _BINS // 2, F.lit(0)), F.lit(_BINS - 1))
    n = np.zeros((2, _BINS))
    for r in scored.where(F.col("__kind").isin(_ASIDE, _ASIDE + 1)).groupBy(place.alias("bin"), "__kind").count().collect():
        n[r["__kind"] - _ASIDE, r["bin"]] = r["count"]
    if not n[0].any() or not n[1].any():
        return 1.0, 0.0
    return _logistic((np.arange(_BINS) - _BINS // 2 + 0.5) * _BIN, n)


def filter_urls(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, p_allow) for every row; p_allow is the models' probability.

    A key named as one of the other columns comes back with `_key` behind its name.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url))
    own = "__key"  # the caller's name may be one of those below
    given = f"{key}_key" if key.lower() in ("host", "path", "rule", "verdict", "p_allow") else key
    rows = pages.select(F.col(key).alias(own), host.alias("host"), path.alias("path"), whole_text(F.col(url)).alias("__text"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("__says", verdict)
    aside = F.when(F.crc32("__text") % 4 == 2, _ASIDE).otherwise(0)
    rows = rows.withColumn("__kind", F.when(F.col("__says").isNull(), _KINDS).otherwise(aside + (F.col("__says") == "allow").cast("int")))
    size = rows.agg(F.sum(F.octet_length("__text") + 1).alias("bytes"), *(F.max(F.col("__kind").isin(c, _ASIDE + c)).alias(f"has{c}") for c in (0, 1)), F.count_distinct(F.when(F.col("__kind") < _ASIDE, F.col("__kind"))).alias("trial_classes")).first()
    if not size["has0"] or not size["has1"]:
        return rows.select(F.col(own).alias(given), "host", "path", "rule", F.coalesce("__says", F.lit("allow")).alias("verdict"), F.lit(1.0).alias("p_allow"))
    chunk = F.pmod(F.xxhash64(own, "__text"), F.lit(-(-size["bytes"] // _CHUNK_BYTES)))
    dealt = scratch.save(rows.withColumn("__chunk", chunk).repartition("__chunk").sortWithinPartitions("__chunk"), "dealt")
    grams = dealt.select("__chunk", "__kind", "__text").mapInArrow(_counting, "chunk long, gram long, " + ", ".join(f"{n} long" for n in _N))
    grams = scratch.save(grams, "grams")
    sums = [F.sum(n) for n in _N]
    sums += [sums[c] + sums[_ASIDE + c] for c in (0, 1)]
    counts = grams.groupBy("gram").agg(*(sums[at].alias(c) for at, c in zip((0, 1, -2, -1), _CLASSES, strict=True)))
    ratios = scratch.save(_log_ratios(counts, scratch), "ratios")
    known = grams.select("chunk", "gram").join(ratios, "gram")
    kind = T.StructType([*dealt.schema.fields, *(T.StructField(f"__{model}", T.DoubleType()) for model in _MODELS)])
    scored = scratch.save(dealt.groupBy("__chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score, kind), "scored")
    scratch.drop("dealt", "grams", "ratios", *(f"order-{k}" for k in range(ORDER + 1)))
    slope, offset = _calibrate(scored) if size["trial_classes"] == 2 else (1.0, 0.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("__full") * slope + offset)))
    return scored.withColumn("p_allow", p).select(F.col(own).alias(given), "host", "path", "rule", F.coalesce("__says", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")).alias("verdict"), "p_allow")
