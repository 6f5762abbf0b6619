import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyword, semantic
from tidemark.plans import evaluate


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [2.0, 0.0]), (6, [-1.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_k_guards(spark, vectors):
    q = vectors.filter("vec_id = 1")
    got = [(r.vec_id, r.similarity) for r in semantic.top_k(vectors, q, 10).collect()]
    assert got == [(1, 1.0), (5, 1.0), (4, 0.707107), (6, -1.0)]
    assert semantic.top_k(vectors, vectors.filter("vec_id = 2"), 3).count() == 0
    with pytest.raises(Exception, match="expected 3"):
        semantic.with_norms(vectors.filter("vec_id = 1"), dimension=3).collect()


def test_batch_agrees_with_single(spark, vectors):
    batch = semantic.batch_top_k(vectors, vectors, 3)
    assert {r.query_id for r in batch.collect()} == {1, 4, 5, 6}
    one = [r.vec_id for r in batch.filter("query_id = 4").orderBy("rank").collect()]
    assert one == [r.vec_id for r in semantic.top_k(vectors, vectors.filter("vec_id = 4"), 3).collect()]


def test_index_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0")
    found = semantic.LshIndex(64).top_k(e, q, 5)
    assert semantic.LshIndex.recall_against(found, semantic.batch_top_k(e, q, 5)).first().recall >= 0.9


def test_keyword_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "Cats running fast"), (2, "a cat ran; the cat runs"), (3, "dogs"), (4, None)], "doc_id long, text string")
    ids = lambda q, a: sorted(r.doc_id for r in keyword.keyword_search(docs, q, analyzer=a).collect())
    assert ids("cat runs", "english") == [1, 2] and ids("cat runs", "simple") == [2]
    assert ids("the of", "english") == [] and ids("", "simple") == []
    index = keyword.inverted_index(docs)
    direct = keyword.keyword_search(docs, "cat", 5)
    mean = docs.select(F.avg(F.size(keyword.ANALYZERS["simple"](F.col("text"))))).first()[0]
    assert keyword.search_index(index, ["cat"], 4, mean, 5).collect() == direct.collect()


def test_hit_rates(spark):
    results = spark.createDataFrame([(1, "a", 2), (2, "x", 1)], "question_id int, source string, rank int")
    asked = spark.createDataFrame([(1, "a", "set"), (2, "b", "set"), (3, "c", "simple")], "question_id int, expected_source string, tag string")
    got = evaluate.hit_rates(results, asked)
    assert sorted(map(tuple, got.collect())) == [("set", 2, 0.5, 0.25), ("simple", 1, 0.0, 0.0)]
    assert {r.delta for r in evaluate.hit_deltas(got, got).collect()} == {0.0}


def test_index_meets_every_row_when_all_buckets_are_probed(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 5 - 2), float(i % 3)]) for i in range(300)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [float("nan"), 1.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = semantic.LshIndex(3, bits=4, probes=16)
    index.HELD = 64
    order = ("query_id", "rank")
    assert index.top_k(e, e.filter("vec_id % 10 = 0"), 5).orderBy(*order).collect() == semantic.batch_top_k(e, e.filter("vec_id % 10 = 0"), 5).orderBy(*order).collect()
    with pytest.raises(Exception, match="expected 4"):
        semantic.LshIndex(4, probes=1).top_k(e, e, 5).collect()


def test_index_keeps_rows_where_they_are_read(spark, sf_dir):
    """Rows aren't copied once a table: only a query's best of a partition is shuffled."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = semantic.LshIndex(64).top_k(e, e.filter("vec_id % 50 = 0"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
