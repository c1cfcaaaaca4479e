"""The two-level attention classifier over padded batches of subjects, with its derivatives.

A subject is a window of posts, a post a few content vectors and, if wanted, metadata.  Within a post a learned query
attends to these tokens; over a subject's posts self-attention follows, then their mean, if wanted joined by a skip of
the raw mean, and a head that gives one logit.  Every layer returns its output and a function from the derivative by
the output to that by the input, which adds the parameters' derivatives up.  Spark deals the batches: see training.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from weftline.operators.neural import gelu, sinusoidal

VARIANTS = ("full", "without_post_cross_attention", "without_user_self_attention", "mean_pooling_at_both_levels")
POSITIONS = ("none", "sinusoidal", "relative_bias")

Array = np.ndarray
Back = Callable[[Array], Array]


@dataclass(frozen=True)
class HierarchicalSettings:
    d_model: int
    embedding_dimension: int
    post_attention_heads: int = 1
    user_attention_heads: int = 1
    ffn_hidden_dim: int = 16
    classifier_hidden_dim: int = 16
    dropout: float = 0.0
    representations: int = 1  # content vectors of a post; the first is the one whose prefix is an embedding itself
    metadata_dimension: int = 0
    embedding_prefix_dim: int | None = None
    attention_inner_dim: int | None = None
    user_position_encoding: str = "none"
    relative_position_max_distance: int | None = None
    raw_mean_skip_dim: int | None = None
    classifier_head: str = "mlp"
    architecture_variant: str = "full"

    def __post_init__(self) -> None:
        if self.architecture_variant not in VARIANTS or self.user_position_encoding not in POSITIONS or self.classifier_head not in ("mlp", "linear"):
            raise ValueError("unknown variant, position encoding or head")
        if self.representations < 1 or self.metadata_dimension < 0 or not 0 <= self.dropout < 1:
            raise ValueError("a post has at least one content vector, and dropout is a share")
        if self.inner % self.post_attention_heads or self.inner % self.user_attention_heads:
            raise ValueError("the heads divide the attention's width")
        if self.prefix > self.embedding_dimension:
            raise ValueError("embeddings are narrower than the prefix")
        if (self.user_position_encoding == "relative_bias") != (self.relative_position_max_distance is not None):
            raise ValueError("relative positions need a largest distance, others have none")

    @property
    def inner(self) -> int:
        return self.attention_inner_dim or self.d_model

    @property
    def prefix(self) -> int:
        return self.embedding_prefix_dim or self.d_model

    @property
    def attends_within_posts(self) -> bool:
        return self.architecture_variant in ("full", "without_user_self_attention")

    @property
    def attends_over_posts(self) -> bool:
        return self.architecture_variant in ("full", "without_post_cross_attention")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of all parameters."""
        d, out = self.d_model, {}

        def linear(name: str, into: int, width: int) -> None:
            out[f"{name}.weight"], out[f"{name}.bias"] = (width, into), (width,)

        def norm(name: str, width: int) -> None:
            out[f"{name}.gain"], out[f"{name}.shift"] = (width,), (width,)

        def block(name: str, attention: bool) -> None:
            if attention:
                for part in ("query", "key", "value"):
                    linear(f"{name}.{part}", d, self.inner)
                linear(f"{name}.output", self.inner, d)
                norm(f"{name}.context_norm", d)
            norm(f"{name}.ffn_norm", d)
            linear(f"{name}.ffn_in", d, self.ffn_hidden_dim)
            linear(f"{name}.ffn_out", self.ffn_hidden_dim, d)

        for k in range(self.representations):
            if k or self.prefix != d:
                linear(f"content{k}", self.embedding_dimension if k else self.prefix, d)
        if self.metadata_dimension:
            norm("metadata_norm", self.metadata_dimension)
            linear("metadata", self.metadata_dimension, d)
        if self.architecture_variant != "mean_pooling_at_both_levels":
            block("post", self.attends_within_posts)
            block("user", self.attends_over_posts)
        if self.attends_within_posts:
            out["post.class_query"] = (d,)
            norm("post.query_norm", d)
        if self.attends_over_posts and self.relative_position_max_distance:
            out["user.relative"] = (2 * self.relative_position_max_distance + 1, self.user_attention_heads)
        width = d
        if self.raw_mean_skip_dim:
            norm("skip_norm", self.embedding_dimension)
            linear("skip", self.embedding_dimension, self.raw_mean_skip_dim)
            width += self.raw_mean_skip_dim
        norm("head_norm", width)
        if self.classifier_head == "mlp":
            linear("head_in", width, self.classifier_hidden_dim)
            width = self.classifier_hidden_dim
        linear("head_out", width, 1)
        return out


def initial(settings: HierarchicalSettings, seed: int) -> dict[str, Array]:
    """Parameters to start from; each depends on the seed and its own name alone."""
    out = {}
    for name, shape in settings.shapes().items():
        draw = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(name.encode())])
        kind = name.rsplit(".", 1)[1]
        if kind in ("weight", "bias"):
            into = shape[1] if kind == "weight" else settings.shapes()[name.replace(".bias", ".weight")][1]
            out[name] = draw.uniform(-1, 1, shape) / np.sqrt(into)
        elif kind == "class_query":
            out[name] = draw.normal(size=shape) * 0.02
        else:
            out[name] = np.ones(shape) if kind == "gain" else np.zeros(shape)
    return out


def pack(parameters: dict[str, Array]) -> Array:
    return np.concatenate([parameters[k].ravel() for k in sorted(parameters)])


def unpack(settings: HierarchicalSettings, flat: Array) -> dict[str, Array]:
    out, at = {}, 0
    for name, shape in sorted(settings.shapes().items()):
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    if at != len(flat):
        raise ValueError("the parameters are of other settings")
    return out


class Layers:
    """Layers over one set of parameters; `slopes` collects their derivatives."""

    def __init__(self, parameters: dict[str, Array], dropout: float = 0.0, draws: list[np.random.Generator] | None = None):
        self.p, self.slopes = parameters, {k: np.zeros_like(v) for k, v in parameters.items()}
        self.dropout, self.draws = dropout, draws  # a generator per subject while training

    def linear(self, name: str, x: Array) -> tuple[Array, Back]:
        w = self.p[f"{name}.weight"]

        def back(dy: Array) -> Array:
            flat = dy.reshape(-1, dy.shape[-1])
            self.slopes[f"{name}.weight"] += flat.T @ x.reshape(-1, x.shape[-1])
            self.slopes[f"{name}.bias"] += flat.sum(axis=0)
            return dy @ w

        return x @ w.T + self.p[f"{name}.bias"], back

    def norm(self, name: str, x: Array, eps: float = 1e-5) -> tuple[Array, Back]:
        gain = self.p[f"{name}.gain"]
        spread = np.sqrt(x.var(axis=-1, keepdims=True) + eps)
        unit = (x - x.mean(axis=-1, keepdims=True)) / spread

        def back(dy: Array) -> Array:
            self.slopes[f"{name}.gain"] += (dy * unit).reshape(-1, len(gain)).sum(axis=0)
            self.slopes[f"{name}.shift"] += dy.reshape(-1, len(gain)).sum(axis=0)
            du = dy * gain
            return (du - du.mean(axis=-1, keepdims=True) - unit * (du * unit).mean(axis=-1, keepdims=True)) / spread

        return unit * gain + self.p[f"{name}.shift"], back

    def gelu(self, x: Array) -> tuple[Array, Back]:
        y = gelu(x)
        below = np.where(x == 0, 0.5, y / np.where(x == 0, 1, x))  # the normal distribution's share below x
        return y, lambda dy: dy * (below + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi))

    def drop(self, x: Array) -> tuple[Array, Back]:
        """Dropout by each subject's own generator, so batches don't matter; the first axis is subjects."""
        if not self.dropout or self.draws is None:
            return x, lambda dy: dy
        per = x.shape[0] // len(self.draws)
        keep = np.concatenate([g.random((per, *x.shape[1:])) for g in self.draws]) >= self.dropout
        keep = keep / (1 - self.dropout)
        return x * keep, lambda dy: dy * keep

    def chain(self, x: Array, *steps: Callable[[Array], tuple[Array, Back]]) -> tuple[Array, Back]:
        backs = []
        for step in steps:
            x, b = step(x)
            backs.append(b)

        def back(dy: Array) -> Array:
            for b in reversed(backs):
                dy = b(dy)
            return dy

        return x, back

    def feed_forward(self, name: str, x: Array) -> tuple[Array, Back]:
        """x plus two layers of its norm."""
        y, b = self.chain(x, lambda v: self.norm(f"{name}.ffn_norm", v), lambda v: self.linear(f"{name}.ffn_in", v), self.gelu, self.drop, lambda v: self.linear(f"{name}.ffn_out", v), self.drop)
        return x + y, lambda dy: dy + b(dy)

    def attention(self, name: str, query: Array, context: Array, heads: int, asks: Array, answers: Array | None, bias: Array | None = None) -> tuple[Array, Array, Callable[[Array], tuple[Array, Array, Array]]]:
        """Outputs (batch, queries, width), weights (batch, heads, queries, keys), and derivatives by query, context and bias.

        `asks` and `answers` mask queries and keys; a query without any key has no weights.
        """
        split = lambda x: x.reshape(*x.shape[:2], heads, -1).transpose(0, 2, 1, 3)
        join = lambda x: x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)
        (q, bq), (k, bk), (v, bv) = (self.linear(f"{name}.{part}", x) for part, x in (("query", query), ("key", context), ("value", context)))
        q, k, v = split(q), split(k), split(v)
        scale = 1 / np.sqrt(q.shape[-1])
        logits = q @ k.transpose(0, 1, 3, 2) * scale + (0 if bias is None else bias)
        open_ = asks[:, None, :, None] & (True if answers is None else answers[:, None, None, :])
        logits = np.where(open_, logits, -np.inf)
        top = logits.max(axis=-1, keepdims=True)
        w = np.exp(logits - np.where(np.isfinite(top), top, 0))
        w = w / np.maximum(w.sum(axis=-1, keepdims=True), 1e-300)
        used, dropped = self.drop(w)
        out, bo = self.linear(f"{name}.output", join(used @ v))
        asked = asks[:, :, None]

        def back(dy: Array) -> tuple[Array, Array, Array]:
            dc = split(bo(dy * asked))
            dw = dropped(dc @ v.transpose(0, 1, 3, 2))
            ds = w * (dw - (dw * w).sum(axis=-1, keepdims=True))
            dq, dk = ds @ k * scale, ds.transpose(0, 1, 3, 2) @ q * scale
            return bq(join(dq)), bk(join(dk)) + bv(join(used.transpose(0, 1, 3, 2) @ dc)), ds

        return out * asked, w, back


def forward(s: HierarchicalSettings, layers: Layers, content: Array, metadata: Array, mask: Array) -> tuple[Array, dict[str, Array], Callable[[Array], None]]:
    """Logits of (subjects, posts, representations, width) content with (subjects, posts, m) metadata and a mask of posts.

    Also the weights of both attentions, and the way back from derivatives by the logits.
    """
    n, r, _, _ = content.shape
    d, shown = s.d_model, {}
    seen = mask[:, :, None].astype(float)
    tokens, token_backs = [], []
    for k in range(s.representations):
        x = content[:, :, k, :] if k else content[:, :, 0, : s.prefix]
        y, b = layers.linear(f"content{k}", x) if f"content{k}.weight" in layers.p else (x, None)
        tokens.append(y)
        token_backs.append(b)
    if s.metadata_dimension:
        y, b = layers.chain(metadata, lambda v: layers.norm("metadata_norm", v), lambda v: layers.linear("metadata", v))
        tokens.append(y)
        token_backs.append(b)
    within = np.stack(tokens, axis=2)

    if s.attends_within_posts:
        flat = within.reshape(n * r, len(tokens), d)
        query = np.broadcast_to(layers.p["post.class_query"], (n * r, 1, d))
        asked, bq = layers.norm("post.query_norm", query)
        told, bc = layers.norm("post.context_norm", flat)
        got, w, ba = layers.attention("post", asked, told, s.post_attention_heads, mask.reshape(-1, 1), None)
        posts, bf = layers.feed_forward("post", query + got)
        shown["post_attention"] = w.reshape(n, r, *w.shape[1:])
        posts = posts[:, 0].reshape(n, r, d)

        def post_back(dy: Array) -> Array:
            dy = bf(dy.reshape(n * r, 1, d))
            dq, dc, _ = ba(dy)
            layers.slopes["post.class_query"] += (dy + bq(dq)).sum(axis=(0, 1))
            return bc(dc).reshape(within.shape)
    else:
        posts, bm = within.mean(axis=2), None
        if s.architecture_variant == "without_post_cross_attention":
            posts, bm = layers.feed_forward("post", posts)

        def post_back(dy: Array) -> Array:
            dy = dy if bm is None else bm(dy)
            return np.repeat(dy[:, :, None] / len(tokens), len(tokens), axis=2)

    posts = posts * seen
    if s.user_position_encoding == "sinusoidal" and s.architecture_variant != "mean_pooling_at_both_levels":
        posts = (posts + sinusoidal(r, d)) * seen
    if s.attends_over_posts:
        bias, at = None, None
        if "user.relative" in layers.p:
            far = s.relative_position_max_distance
            at = np.clip(np.arange(r)[None] - np.arange(r)[:, None], -far, far) + far
            bias = layers.p["user.relative"][at].transpose(2, 0, 1)
        told, bt = layers.norm("user.context_norm", posts)
        got, shown["user_attention"], bu = layers.attention("user", told, told, s.user_attention_heads, mask, mask, bias)
        users, bf2 = layers.feed_forward("user", posts + got)

        def user_back(dy: Array) -> Array:
            dy = bf2(dy)
            dq, dc, ds = bu(dy)
            if at is not None:
                np.add.at(layers.slopes["user.relative"], at, ds.sum(axis=0).transpose(1, 2, 0))
            return dy + bt(dq + dc)
    elif s.architecture_variant == "without_user_self_attention":
        users, user_back = layers.feed_forward("user", posts)
    else:
        users, user_back = posts, lambda dy: dy

    share = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1.0)
    mean = (users * share).sum(axis=1)
    final, bs = mean, None
    if s.raw_mean_skip_dim:
        raw = (content[:, :, 0] * share).sum(axis=1)
        skip, bs = layers.chain(raw, lambda v: layers.norm("skip_norm", v), lambda v: layers.linear("skip", v), layers.gelu, layers.drop)
        final = np.concatenate([mean, skip], axis=1)
    steps = [lambda v: layers.norm("head_norm", v)]
    if s.classifier_head == "mlp":
        steps += [lambda v: layers.linear("head_in", v), layers.gelu, layers.drop]
    logits, bh = layers.chain(final, *steps, lambda v: layers.linear("head_out", v))
    shown["user_embedding"] = mean

    def back(dy: Array) -> None:
        dx = bh(dy[:, None])
        if bs is not None:
            bs(dx[:, d:])
        dx = user_back(dx[:, None, :d] * share) * seen
        dx = post_back(dx)
        for k, b in enumerate(token_backs):
            if b is not None:
                b(dx[:, :, k])

    return logits[:, 0], shown, back


def loss_and_slopes(s: HierarchicalSettings, parameters: dict[str, Array], content: Array, metadata: Array, mask: Array, labels: Array, draws: list[np.random.Generator] | None = None) -> tuple[float, dict[str, Array]]:
    """The summed logistic loss of labels 0 and 1, and its derivatives by the parameters."""
    layers = Layers(parameters, s.dropout, draws)
    logits, _, back = forward(s, layers, content, metadata, mask)
    back(1 / (1 + np.exp(-logits)) - labels)
    return logistic_loss(logits, labels), layers.slopes


def logistic_loss(logits: Array, labels: Array) -> float:
    return float((np.maximum(logits, 0) - logits * labels + np.log1p(np.exp(-np.abs(logits)))).sum())
