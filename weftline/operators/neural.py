"""Forward passes of the attention and mean-pool classifiers in numpy, for scoring with given weights.

Training and the frozen encoders are outside: an encoder is a function from a batch of inputs to vectors (see embed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact form; erf by a rational approximation with an error below 2e-7."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return x * 0.5 * (1 + np.sign(x) * erf)


def layer_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    mean, var = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - mean) / np.sqrt(var + eps) * gain + shift


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray, heads: int, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled dot-product attention of projected (rows, width) arrays; masked keys get no weight, and no weight is left undefined."""
    split = lambda x: x.reshape(len(x), heads, -1).transpose(1, 0, 2)
    q_, k_, v_ = split(q), split(k), split(v)
    logits = q_ @ k_.transpose(0, 2, 1) / np.sqrt(q_.shape[-1])
    if bias is not None:
        logits = logits + bias
    logits = np.where(mask[None, None, :], logits, -1e30)
    w = np.exp(logits - logits.max(-1, keepdims=True)) * mask[None, None, :]
    w = w / np.maximum(w.sum(-1, keepdims=True), 1e-12)
    return (w @ v_).transpose(1, 0, 2).reshape(len(q), -1), w


def sinusoidal(n: int, width: int) -> np.ndarray:
    at, k = np.arange(n)[:, None], np.arange(0, width, 2)[None, :]
    angle = at * np.exp(-np.log(10000.0) * k / width)
    out = np.zeros((n, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle[:, : width // 2])
    return out


def masked_mean(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (x * mask[:, None]).sum(0) / max(1.0, float(mask.sum()))


def last_token(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The vector at the last attended position."""
    return x[np.flatnonzero(mask)[-1]]


def token_mean(x: np.ndarray, attended: np.ndarray, special: np.ndarray) -> np.ndarray:
    """Mean of the attended tokens that aren't special; the first token where there is none."""
    own = attended & ~special
    return x[own].mean(0) if own.any() else x[0]


def mean_mlp(x: np.ndarray, mask: np.ndarray, weights: dict[str, np.ndarray]) -> float:
    """Logit of the mean-pool head: norm, linear, GELU, linear."""
    h = layer_norm(masked_mean(x, mask), weights["norm_gain"], weights["norm_shift"])
    return float(gelu(h @ weights["w1"] + weights["b1"]) @ weights["w2"] + weights["b2"])


def score_sequences(rows: DataFrame, subject: str, position: str, vector: str, forward: Callable[[np.ndarray], float]) -> DataFrame:
    """(subject, logit) of `forward` over each subject's window of vectors in order, which the window bounds."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(position, kind="stable")
        return pd.DataFrame({subject: [key[0]], "logit": [forward(np.stack(ordered[vector].to_numpy()).astype(np.float64))]})

    kind = rows.schema[subject].dataType.simpleString()
    return rows.select(subject, position, vector).groupBy(subject).applyInPandas(run, f"{subject} {kind}, logit double")


def embed(rows: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """`rows` with a vector per text. The encoder is made once a task, and equal texts, such as all empty ones, are encoded once."""
    distinct = rows.select(F.coalesce(text, F.lit("")).alias("__text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            yield pd.DataFrame({"__text": batch["__text"], out: [v.astype(np.float32) for v in encode(batch["__text"].tolist())]})

    made = distinct.mapInPandas(run, f"__text string, {out} array<float>")
    return rows.withColumn("__text", F.coalesce(text, F.lit(""))).join(made, "__text").drop("__text")


def stub_encoder(width: int = 8) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in for a frozen encoder: length first, then character sums."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            out[i, 0] = len(t)
            for k, ch in enumerate(t):
                out[i, 1 + k % (width - 1)] += ord(ch) % 97
        return out

    return lambda: encode
