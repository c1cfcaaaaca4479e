import re
from fractions import Fraction

from pyspark.sql import functions as F

from weftline.llm.mixing import count_words, mix, taken_words

KIND = "doc_id long, text string, source string, size long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, -1) for i, t, s in rows], KIND).repartition(3)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes, weights, total, most=3):
    """Shares by weight, the excess shared anew until nobody is above, in exact fractions."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(weight[s] for s in sizes if s not in full)
        level = Fraction(total - sum(most * sizes[s] for s in full), rest) if rest else Fraction(0)
        more = {s for s in sizes if s not in full and level * weight[s] > most * sizes[s]}
        if not more:
            return {s: Fraction(most * sizes[s]) if s in full else level * weight[s] for s in sizes}
        full |= more


ROWS = [(i, "w " * (i * 7 % 23), "abcd"[i % 4] if i % 3 else "a") for i in range(300)]
ROWS += [(900, "x " * 5000, "tiny"), (901, None, "empty"), (902, "", "empty"), (903, "one word 　 two", None), (904, "y " * 40, None), (None, "no id here", "b")]
ROWS += [(77, "again and again", "c")] * 20


def test_targets_and_takes(spark):
    found = [r.asDict() for r in taken_words(mix(documents(spark, ROWS), (5, 2, 1))).collect()]
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(i), words(t)) for i, t, _ in ROWS)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = plain_targets(sizes, (5, 2, 1), sum(sizes.values()))
    stream = mix(documents(spark, ROWS), (5, 2, 1))
    taken = {r["source"]: r for r in stream.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()}
    assert set(taken) == set(sizes)
    for s, r in taken.items():
        assert r["size"] == sizes[s] and abs(r["target"] - float(target[s])) < 1e-6
        assert abs(r["taken"] - target[s]) <= len(sizes)
    assert sum(r["taken"] for r in found) == sum(sizes.values())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)


def test_reruns_agree_whatever_the_partitions(spark):
    ask = lambda n: sorted(map(str, taken_words(mix(documents(spark, ROWS).repartition(n), (5, 2, 1))).collect()))
    assert ask(1) == ask(7)


def test_every_prefix_is_mixed_in_proportion(spark):
    stream = mix(documents(spark, ROWS), (5, 2, 1)).where("taken > 0").orderBy("at").collect()
    at, served, largest = 0, {}, 5000
    for r in stream:
        assert r["at"] == at  # gapless
        at += r["words"]
        served[r["source"]] = served.get(r["source"], 0) + r["words"]
        for s, n in served.items():
            own = next(x["target"] for x in stream if x["source"] == s)
            assert n <= r["finish"] * own + largest + 1


def test_other_budgets_and_no_rows(spark):
    stream = mix(documents(spark, ROWS), (1,), total=100)
    assert stream.agg(F.sum("taken")).first()[0] == 100
    all_ = sum(words(t) for _, t, _ in ROWS)
    assert mix(documents(spark, ROWS), (1,), total=10 * all_).agg(F.sum("taken")).first()[0] == 3 * all_
    assert taken_words(mix(documents(spark, []), (5, 2, 1))).collect() == []
    assert [tuple(r) for r in taken_words(mix(documents(spark, [(1, None, None)]), (5,))).collect()] == [(1, 0, 0, 0.0, 0)]


def test_size_expression(spark):
    texts = ["", None, " a  b\x0bc\r\n", "x" * 200_000 + " " + "y" * 10, "\x1fa\x85b é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(count_words(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [words(t) for t in texts]
