"""Every registered query of the cohort operators against its SQL twin in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftline.plans import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", list(q.SQL))
def test_query_equals_sql(spark, duck, name):
    found = q.QUERIES[name](spark, DATA)
    want = duck.execute(q.SQL[name])
    got_columns, got = rows(found.columns, [tuple(r) for r in found.collect()])
    want_columns, wanted = rows([d[0] for d in want.description], want.fetchall())
    assert got_columns == want_columns and len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a == b or all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6) for x, y in zip(a, b))


def test_models_separate_the_classes(spark):
    for name in ("svm_fit_predict", "lr_fit_predict", "tfidf_svm"):
        df = q.QUERIES[name](spark, DATA)
        assert df.count() > 0 and df.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
