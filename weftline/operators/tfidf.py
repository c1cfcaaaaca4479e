"""Character TF-IDF fitted on training rows only, as a table of weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document(df: DataFrame, subject: str, order: Sequence[str], text: str) -> DataFrame:
    """(subject, text): a subject's texts in order, joined by line feeds."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return df.groupBy(subject).agg(F.array_join(F.transform(rows, lambda r: r["__text"]), "\n").alias("text"))


def characters(text: Column) -> Column:
    """Characters of the lower-cased text with runs of white space made one space."""
    plain = F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")
    return F.filter(F.split(plain, ""), lambda c: c != "")


def grams(df: DataFrame, doc: Sequence[str], text: str, largest: int = 2) -> DataFrame:
    """(doc, gram, n) of all runs of 1 to `largest` characters."""
    chars = df.select(*doc, characters(F.col(text)).alias("c"))
    runs = [F.col("c")]
    for k in range(1, largest):
        ahead = F.slice(F.col("c"), k + 1, F.greatest(F.size("c"), F.lit(1)))
        runs.append(F.zip_with(F.slice(runs[-1], 1, F.greatest(F.size("c") - k, F.lit(0))), ahead, lambda a, b: F.concat(a, b)))
    return chars.select(*doc, F.explode(F.concat(*runs)).alias("gram")).groupBy(*doc, "gram").agg(F.count("*").alias("n"))


def fit_idf(counts: DataFrame, train: DataFrame, fold: Sequence[str], doc: str, minimum: int = 2) -> DataFrame:
    """(fold, gram, idf) over the training documents (fold, doc): 1 + ln((1 + n) / (1 + df)), grams of at least `minimum` documents."""
    sizes = train.groupBy(*fold).agg(F.count("*").alias("docs"))
    df = train.join(counts, doc).groupBy(*fold, "gram").agg(F.count("*").alias("df")).where(F.col("df") >= minimum)
    return df.join(F.broadcast(sizes), list(fold)).select(*fold, "gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def transform(counts: DataFrame, docs: DataFrame, idf: DataFrame, fold: Sequence[str], doc: str) -> DataFrame:
    """(fold, doc, gram, weight) for documents (fold, doc) of any role: (1 + ln n) * idf, scaled to unit length."""
    raw = docs.join(counts, doc).join(idf, [*fold, "gram"]).select(*fold, doc, "gram", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norms = raw.groupBy(*fold, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, [*fold, doc]).select(*fold, doc, "gram", (F.col("w") / F.col("norm")).alias("weight"))
