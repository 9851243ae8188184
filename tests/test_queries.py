"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import vector
from corvane.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select * from ({ORACLE[name]})")
    assert sorted(want.columns) == cols
    assert sorted(repr(tuple(r)) for r in df.select(cols).collect()) == sorted(map(repr, want.select(*cols).fetchall()))


def test_index_finds_the_exact_best(spark):
    for sf in (SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        exact = {(r.qid, r.vec_id) for r in QUERIES["cosine_batch"](spark, sf).collect()}
        got = {(r.qid, r.vec_id) for r in QUERIES["ann_batch"](spark, sf).collect()}
        assert len(got) == len(exact) and len(exact & got) >= 0.9 * len(exact)


def test_search_splits_hot_cells_and_takes_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60 + i, [float(i), 1.0]) for i in range(20)] + [(90, None), (91, []), (92, [0.0, 0.0]), (93, [1.0])]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    c = vector.fit_cells(v, "v", cells=4)
    index = vector.build_index(v, "id", "v", c)
    exact = sorted(map(tuple, vector.top_k_batch(v, "id", "v", q, "qid", 5, block=2).collect()))
    assert index.count() == len(rows)
    assert exact == sorted(map(tuple, vector.search_index(index, "id", "v", q, "qid", c, 5, probes=4, block=7).collect()))
    assert [r[1] for r in exact if r[0] == 20] == [0, 1, 2, 3, 4]
    none = v.where("false")
    assert vector.fit_cells(none, "v").size == 0 and vector.top_k_batch(none, "id", "v", q, "qid").count() == 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]
