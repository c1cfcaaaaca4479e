"""Registered queries of the neural and of the distributed linear models; their SQL is written out from the same parameters."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import hierarchical as hi
from weftline.operators import newton
from weftline.operators import training as tr
from weftline.operators import windowing as win
from weftline.plans.queries import query, r6, table

#: A subject's window of vectors.
LIMIT = 64


def _settings(variant: str) -> hi.HierarchicalSettings:
    """Settings of a variant; those with attention over posts differ in how they know positions, too."""
    positions = {"full": {"user_position_encoding": "relative_bias", "relative_position_max_distance": 3}, "without_post_cross_attention": {"user_position_encoding": "sinusoidal"}}
    return hi.HierarchicalSettings(
        d_model=8, embedding_dimension=64, post_attention_heads=2, user_attention_heads=2, ffn_hidden_dim=6, classifier_hidden_dim=5, representations=2, attention_inner_dim=4,
        raw_mean_skip_dim=3 if variant == "full" else None, classifier_head="linear" if variant == "mean_pooling_at_both_levels" else "mlp", architecture_variant=variant, **positions.get(variant, {}),
    )


@cache
def _model(variant: str) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(11)
    return {k: np.round(v + 0.3 * draw.normal(size=v.shape), 6) for k, v in sorted(hi.initial(_settings(variant), 5).items())}


class _Said:
    """The forward pass in SQL: every layer as an expression of a list."""

    def __init__(self, variant: str):
        self.s, self.p = _settings(variant), _model(variant)

    def list(self, x: np.ndarray) -> str:
        return f"[{', '.join(self.list(v) if v.ndim else repr(float(v)) + '::DOUBLE' for v in np.asarray(x))}]"

    def linear(self, name: str, x: str) -> str:
        rows = np.column_stack([self.p[f"{name}.weight"], self.p[f"{name}.bias"]])
        return f"list_transform({self.list(rows)}, lambda w: list_dot_product(w, list_append({x}, 1.0::DOUBLE)))"

    def norm(self, name: str, x: str) -> str:
        return f"list_transform(list_zip({x}, {self.list(self.p[f'{name}.gain'])}, {self.list(self.p[f'{name}.shift'])}), lambda z: (z[1] - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5) * z[2] + z[3])"

    def gelu(self, x: str) -> str:
        t = "(1 / (1 + 0.3275911 * abs(g) / sqrt(2)))"
        erf = f"(1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-g * g / 2))"
        return f"list_transform({x}, lambda g: g * 0.5 * (1 + sign(g) * {erf}))"

    def add(self, x: str, y: str) -> str:
        return f"list_transform(list_zip({x}, {y}), lambda z: z[1] + z[2])"

    def mean(self, x: str, width: int) -> str:
        return "[" + ", ".join(f"avg({x}[{i + 1}])" for i in range(width)) + "]"

    def feed_forward(self, name: str, made: str, source: str) -> str:
        """Common tables from (subject_id, pos, x) of `source` to the same of `made`."""
        return f"""{made}_n AS MATERIALIZED (SELECT *, {self.norm(f"{name}.ffn_norm", "x")} AS y FROM {source}),
{made}_h AS MATERIALIZED (SELECT * EXCLUDE y, {self.linear(f"{name}.ffn_in", "y")} AS y FROM {made}_n),
{made} AS MATERIALIZED (SELECT subject_id, pos, {self.add("x", self.linear(f"{name}.ffn_out", self.gelu("y")))} AS x FROM {made}_h)"""

    def context(self, heads: int, score: str) -> str:
        """The heads' weighted means of v, one after the other; `score` is of head h."""
        wide = self.s.inner // heads
        cells = [f"sum(exp({score.format(h=h, part=f'{h * wide + 1}:{(h + 1) * wide}')}) * v[{h * wide + i + 1}]) / sum(exp({score.format(h=h, part=f'{h * wide + 1}:{(h + 1) * wide}')}))" for h in range(heads) for i in range(wide)]
        return "[" + ", ".join(cells) + "]"

    def tables(self, tag: str) -> str:
        s, p = self.s, self.p
        out = [f"{tag}_t AS MATERIALIZED (SELECT subject_id, pos, e[1:{s.prefix}] AS x FROM z UNION ALL SELECT subject_id, pos, {self.linear('content1', 'e')} FROM z)"]
        if s.attends_within_posts:
            told = hi.Layers(p)
            asked, _ = told.linear("post.query", told.norm("post.query_norm", p["post.class_query"][None])[0])
            scale = 1 / np.sqrt(s.inner // s.post_attention_heads)
            score = f"{scale} * list_dot_product(k[{{part}}], {self.list(asked[0])}[{{part}}])"
            out.append(f"{tag}_n AS MATERIALIZED (SELECT subject_id, pos, {self.norm('post.context_norm', 'x')} AS x FROM {tag}_t)")
            out.append(f"{tag}_k AS MATERIALIZED (SELECT subject_id, pos, {self.linear('post.key', 'x')} AS k, {self.linear('post.value', 'x')} AS v FROM {tag}_n)")
            out.append(f"{tag}_c AS MATERIALIZED (SELECT subject_id, pos, {self.context(s.post_attention_heads, score)} AS c FROM {tag}_k GROUP BY subject_id, pos)")
            out.append(f"{tag}_q AS MATERIALIZED (SELECT subject_id, pos, {self.add(self.list(p['post.class_query']), self.linear('post.output', 'c'))} AS x FROM {tag}_c)")
            out.append(self.feed_forward("post", f"{tag}_p", f"{tag}_q"))
        else:
            out.append(f"{tag}_q AS MATERIALIZED (SELECT subject_id, pos, {self.mean('x', s.d_model)} AS x FROM {tag}_t GROUP BY subject_id, pos)")
            out.append(self.feed_forward("post", f"{tag}_p", f"{tag}_q") if "post.ffn_in.weight" in p else f"{tag}_p AS (FROM {tag}_q)")
        if s.user_position_encoding == "sinusoidal":
            wave = ", ".join(f"{'sin' if i % 2 == 0 else 'cos'}(pos * {float(np.exp(-np.log(10000.0) * (i // 2 * 2) / s.d_model))!r})" for i in range(s.d_model))
            out.append(f"{tag}_w AS MATERIALIZED (SELECT subject_id, pos, {self.add('x', f'[{wave}]')} AS x FROM {tag}_p)")
        else:
            out.append(f"{tag}_w AS (FROM {tag}_p)")
        if s.attends_over_posts:
            scale = 1 / np.sqrt(s.inner // s.user_attention_heads)
            score = f"{scale} * list_dot_product(q[{{part}}], k[{{part}}])"
            if s.relative_position_max_distance:
                far = s.relative_position_max_distance
                score += f" + {self.list(p['user.relative'].T)}[{{h}} + 1][least({far}, greatest(-{far}, j - pos)) + {far} + 1]"
            out.append(f"{tag}_o AS MATERIALIZED (SELECT subject_id, pos, x, {self.norm('user.context_norm', 'x')} AS y FROM {tag}_w)")
            out.append(f"{tag}_l AS MATERIALIZED (SELECT subject_id, pos, x, {self.linear('user.query', 'y')} AS q, {self.linear('user.key', 'y')} AS k, {self.linear('user.value', 'y')} AS v FROM {tag}_o)")
            out.append(f"{tag}_j AS MATERIALIZED (SELECT a.subject_id, a.pos, a.x, a.q, b.pos AS j, b.k, b.v FROM {tag}_l a JOIN {tag}_l b USING (subject_id))")
            out.append(f"{tag}_d AS MATERIALIZED (SELECT subject_id, pos, any_value(x) AS x, {self.context(s.user_attention_heads, score)} AS c FROM {tag}_j GROUP BY subject_id, pos)")
            out.append(f"{tag}_e AS MATERIALIZED (SELECT subject_id, pos, {self.add('x', self.linear('user.output', 'c'))} AS x FROM {tag}_d)")
            out.append(self.feed_forward("user", f"{tag}_u", f"{tag}_e"))
        else:
            out.append(self.feed_forward("user", f"{tag}_u", f"{tag}_w") if "user.ffn_in.weight" in p else f"{tag}_u AS (FROM {tag}_w)")
        out.append(f"{tag}_m AS MATERIALIZED (SELECT subject_id, {self.mean('x', s.d_model)} AS x FROM {tag}_u GROUP BY subject_id)")
        if s.raw_mean_skip_dim:
            out.append(f"{tag}_r AS MATERIALIZED (SELECT subject_id, {self.mean('e', s.embedding_dimension)} AS r FROM z GROUP BY subject_id)")
            out.append(f"{tag}_y AS MATERIALIZED (SELECT subject_id, {self.gelu(self.linear('skip', self.norm('skip_norm', 'r')))} AS r FROM {tag}_r)")
            out.append(f"{tag}_f AS MATERIALIZED (SELECT subject_id, list_concat(x, r) AS x FROM {tag}_m JOIN {tag}_y USING (subject_id))")
        else:
            out.append(f"{tag}_f AS (FROM {tag}_m)")
        out.append(f"{tag}_g AS MATERIALIZED (SELECT subject_id, {self.norm('head_norm', 'x')} AS x FROM {tag}_f)")
        if s.classifier_head == "mlp":
            out.append(f"{tag}_i AS MATERIALIZED (SELECT subject_id, {self.gelu(self.linear('head_in', 'x'))} AS x FROM {tag}_g)")
        else:
            out.append(f"{tag}_i AS (FROM {tag}_g)")
        out.append(f"{tag} AS (SELECT '{s.architecture_variant}' AS variant, subject_id, ({self.linear('head_out', 'x')})[1] AS v FROM {tag}_i)")
        return ",\n".join(out)


_WINDOW = f"z AS MATERIALIZED (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY vec_id) - 1 AS pos, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT vec_id % 50 AS subject_id, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id DESC) AS k FROM embeddings) WHERE k <= {LIMIT})"
_SCORES = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(hi.VARIANTS)))
_TABLES = ",\n".join(_Said(v).tables(f"v{k}") for k, v in enumerate(hi.VARIANTS))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest vectors of each subject, all rows of embeddings being dealt to 50 subjects."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("subject_id"), "vec_id", "embedding")
    window = win.recent(rows, "subject_id", "vec_id", "vec_id", LIMIT)
    subjects = rows.select("subject_id").distinct()
    return tr.sequences(window, subjects, ["embedding", "embedding"], LIMIT, position="vec_id")


@query(f"WITH {_WINDOW},\n{_TABLES}\nSELECT variant, subject_id, round(v, 5) AS decision_value, round(1 / (1 + exp(-v)), 5) AS score FROM ({_SCORES})")
def hierarchical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four variants of the attention model with given weights: both attentions, positions, skip and heads."""
    seqs = _sequences(spark, sf_dir)
    who = seqs.select("subject_id", F.lit(0).alias("split_seed"), F.lit(0).alias("outer_fold"), F.lit("test").alias("role"), F.lit(0).alias("label_id"))
    out = None
    for variant in hi.VARIANTS:
        scored = tr.score(seqs, who, tr.to_table(spark, {(0, 0): _model(variant)}), _settings(variant), LIMIT)
        part = scored.select(F.lit(variant).alias("variant"), "subject_id", F.round("decision_value", 5).alias("decision_value"), F.round("score", 5).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def hierarchical_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the attention model trained on each fold; the label is whether a subject's number is over 24."""
    seqs = _sequences(spark, sf_dir)
    fold = F.pmod(F.xxhash64("subject_id"), F.lit(3)).cast("int")
    who = seqs.select("subject_id", F.lit(58).alias("split_seed"), F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("outer_fold"), (F.col("subject_id") > 24).cast("int").alias("label_id"), fold.alias("own"))
    who = who.withColumn("role", F.when(F.col("own") == F.col("outer_fold"), "test").when(F.pmod(F.col("own") + 1, F.lit(3)) == F.col("outer_fold"), "validation").otherwise("train")).drop("own")
    _, history = tr.fit(seqs, who, _settings("full"), tr.TrainingSettings(epochs=6, learning_rate=0.01), LIMIT)
    return history


def _solved(solver: str, steps: int = 12) -> str:
    """Newton's steps for two features and the bias, one common table each; the 3 by 3 systems by Cramer's rule."""
    if solver == "logistic":
        slope, bend = "-y / (1 + exp(y * f))", "1 / (1 + exp(f)) / (1 + exp(-f))"
    else:
        slope, bend = "CASE WHEN y * f < 1 THEN -2 * y * (1 - y * f) ELSE 0 END", "CASE WHEN y * f < 1 THEN 2 ELSE 0 END"
    tables = [
        "x AS MATERIALIZED (SELECT c_nationkey AS nation, CAST(c_acctbal AS DOUBLE) / 1000 AS a, length(c_name) * 0.05::DOUBLE + (c_custkey % 7) * 0.1::DOUBLE AS b, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM customer)",
        "w0 AS MATERIALIZED (SELECT nation, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w FROM x GROUP BY nation)",
    ]
    for k in range(steps):
        tables.append(f"""m{k} AS MATERIALIZED (SELECT nation, any_value(u) + sum(s * a) AS p, any_value(v) + sum(s * b) AS q, any_value(w) + sum(s) AS r, 1 + sum(h * a * a) AS aa, sum(h * a * b) AS ab, sum(h * a) AS ac, 1 + sum(h * b * b) AS bb, sum(h * b) AS bc, 1 + sum(h) AS cc
FROM (SELECT *, {slope} AS s, {bend} AS h FROM (SELECT *, a * u + b * v + w AS f FROM x JOIN w{k} USING (nation))) GROUP BY nation)""")
        det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
        du = f"(p * (bb * cc - bc * bc) - ab * (q * cc - bc * r) + ac * (q * bc - bb * r)) / {det}"
        dv = f"(aa * (q * cc - bc * r) - p * (ab * cc - bc * ac) + ac * (ab * r - q * ac)) / {det}"
        dw = f"(aa * (bb * r - q * bc) - ab * (ab * r - q * ac) + p * (ab * bc - bb * ac)) / {det}"
        tables.append(f"w{k + 1} AS MATERIALIZED (SELECT nation, u - {du} AS u, v - {dv} AS v, w - {dw} AS w FROM w{k} JOIN m{k} USING (nation))")
    return "WITH " + ",\n".join(tables) + f"\nSELECT nation, feature, round(value, 6) AS coefficient FROM (SELECT nation, u AS acctbal, v AS key, w AS \"(bias)\" FROM w{steps}) UNPIVOT (value FOR feature IN (acctbal, key, \"(bias)\"))"


def _per_nation(spark: SparkSession, sf_dir: str, solver: str) -> DataFrame:
    """A model for each nation's customers: does their balance and their key tell two segments?"""
    rows = table(spark, sf_dir, "customer")
    cells = F.array(F.struct(F.lit("acctbal").alias("feature"), (F.col("c_acctbal").cast("double") / 1000).alias("value")), F.struct(F.lit("key").alias("feature"), (F.length("c_name") * F.lit(0.05) + (F.col("c_custkey") % 7) * F.lit(0.1)).alias("value")))
    train = rows.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("label"), F.inline(cells))
    return newton.fit_distributed(train, solver, 1.0, ["nation"]).select("nation", "feature", r6("coefficient").alias("coefficient"))


@query(_solved("logistic"))
def logistic_by_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_nation(spark, sf_dir, "logistic")


@query(_solved("svm"))
def svm_by_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_nation(spark, sf_dir, "svm")
