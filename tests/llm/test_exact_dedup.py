from pyspark.sql import functions as F

from rolemill.llm import exact_dedup as E
from tests.llm.helpers import same_as_sql

ROWS = [
    (1, "a b"),
    (2, "a  b "),
    (3, "ab"),
    (4, None),
    (5, ""),
    (6, " \n"),
    (7, "Ab"),
    (8, "a b"),
    (9, "x" * 200_000),
    (10, "x" * 100_000 + "\r\n" + "x" * 100_000),
    (11, "é b"),
    (12, "éb"),
]
KIND = "doc_id long, text string"
SQL_KIND = "doc_id BIGINT, text VARCHAR"


def test_like_sql_with_nulls_ties_and_long_texts(spark):
    df = E.exact_dedup(spark.createDataFrame(ROWS, KIND))
    assert same_as_sql(df, E.SQL, documents=(ROWS, SQL_KIND)) == ""


def test_hot_group_is_whole(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = E.exact_dedup(spark.createDataFrame(rows, KIND).repartition(16))
    assert same_as_sql(df, E.SQL, documents=(rows, SQL_KIND)) == ""


def test_of_repeated_rows_one_stays_and_extra_columns_do_no_harm(spark):
    rows = [(1, "t", "x"), (1, "t", "x"), (None, "t", "y"), (None, "lone", "z")]
    out = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, word string").withColumn("mask", F.lit(1))).collect()
    assert sum(r.kept for r in out if r.group_size == 3) == 1
    assert {r.keep_id for r in out if r.group_size == 3} == {1}
    assert [r.kept for r in out if r.group_size == 1] == [True]


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], KIND)).count() == 0


def test_single_rows_pass_the_filter(spark):
    keys = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    keys = keys.union(keys.limit(100))
    bloom = E.repeated_bits(keys, "k", 1025)
    marked = E.possibly_repeated(keys, "k", bloom, 1025)
    often = keys.groupBy("k").count().where("count > 1").select("k")
    assert marked.join(often, "k").where("NOT suspect").count() == 0
    assert marked.join(often, "k", "left_anti").where("suspect").count() < 200
