import random

from pyspark.sql import functions as F

from rolemill.llm import exact_topk as T
from tests.llm.helpers import same_as_sql

KIND = "vec_id long, embedding array<float>"


def search(spark, rows, parts=5):
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    return T.exact_topk(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), 5)


def test_like_sql_with_ties_sparse_and_odd_vectors(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        dims = 16 if i % 9 else rng.randrange(0, 20)
        rows.append((i, [rng.choice([0.0, 0.0, -0.5, 0.25, 0.004, -0.001]) for _ in range(dims)]))
    rows += [(800, None), (801, [float("nan")] * 16), (850, [float("inf")] + [0.0] * 15), (851, [None] + [0.5] * 15), (900, [3.0e4] * 16), (950, [])]
    assert same_as_sql(search(spark, rows), T.SQL, embeddings=(rows, "vec_id BIGINT, embedding FLOAT[]")) == ""


def test_common_vector_fills_many_ties(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(900)]
    df = search(spark, rows)
    assert same_as_sql(df, T.SQL, embeddings=(rows, "vec_id BIGINT, embedding FLOAT[]")) == ""


def test_few_rows_and_repeated_ids(spark):
    assert search(spark, [(0, [1.0])]).count() == 0
    out = sorted((r.rank, r.vec_id, r.score) for r in search(spark, [(0, [1.0]), (0, [1.0]), (3, [2.0])]).collect())
    assert out == [(1, 3, 256 * 512)] * 2 + [(2, 0, 256 * 256)] * 2
    assert search(spark, []).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 1.00390625])]
    out = {r.vec_id: r.score for r in search(spark, rows).collect()}
    assert out[2] - out[1] == 256 and out[1] == 2**56 + 65536


def test_null_ids_come_last_whatever_the_size(spark):
    for many in (3, 900):
        rows = [(0, [1.0])] + [(None, [1.0])] * 3 + [(i, [1.0]) for i in range(1, many)]
        out = [r.vec_id for r in search(spark, rows).where("query_id = 0").orderBy("rank").collect()]
        assert out == ([1, 2, None, None, None] if many == 3 else [1, 2, 3, 4, 5])


def test_scores_beyond_64_bits_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        search(spark, [(0, [1e30]), (1, [1.0])])
