"""Values that only larger tables hold, against the queries' SQL."""

import pytest

from rolemill.catalog.registry import ORACLES, QUERIES
from rolemill.functions import text
from tests.oracle import connect, difference


def differs(spark, folder, query, **tables):
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/files/{name}")
        [file] = (folder / "files" / name).glob("*.parquet")
        file.rename(folder / f"{name}.parquet")
    return difference(QUERIES[query](spark, str(folder)), connect(str(folder)), ORACLES[query])


def test_a_cent_does_not_outweigh_20_000_order_numbers(spark, tmp_path):
    orders = [(0, 1, 100.0), (20_000, 1, 100.01), (5, 2, 7.0), (6, 2, 7.01), (7, 3, 1.99)]
    assert differs(spark, tmp_path, "best_candidate", orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double")) == ""


def test_relative_dates_before_year_0(spark, tmp_path):
    months = [(12 * i + 2, n) for i, n in enumerate((5, 24_279, 24_291, 24_300, 36_000, 150_000))]
    days = [(10, 1)] + [(12 * i, n) for i, n in enumerate((0, 400_000, 738_000, 739_500, 900_000), 10)]
    spark.createDataFrame(months + days, "event_id long, user_id long").createOrReplaceTempView("asked")
    rows = [tuple(r) for r in spark.sql("SELECT event_id, user_id, 'a', 1.0D, timestamp_ntz'2024-01-01', '' FROM asked").collect()]
    kind = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string"
    assert differs(spark, tmp_path, "parse_relative_date", events=(rows, kind)) == ""


TITLES = ["quí", "quién", "el qui", "thé", "éthe", "the", "théthe", "licensed", "Un-", "sun", "ЯTHEЯ", "the_", "the1", ""]


@pytest.mark.parametrize("query", ["title_deny", "simple_rate"])
def test_words_beside_letters_of_other_scripts(spark, tmp_path, query):
    docs = [(i, f"{t}\nbody", "es", "web") for i, t in enumerate(TITLES)]
    assert differs(spark, tmp_path, query, documents=(docs, "doc_id long, text string, lang string, source string"), pages=([(0, "https://a.example/1")], "page_id long, url string")) == ""


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"a\\b", r"a\\b"), (r"[\]b]", r"[\]b]"), (r"[x]\d", r"[x]\d")],
)
def test_edges_leave_other_parts_alone(pattern, want):
    assert text.ascii_edges(pattern) == want


def test_edges_are_replaced(spark):
    df = spark.createDataFrame([("né",), ("n e",), ("nx",)], "t string")
    got = [r[0] for r in df.select(df.t.rlike(text.ascii_edges(r"n\b"))).collect()]
    assert got == [True, True, False]
    inner = [r[0] for r in df.select(df.t.rlike(text.ascii_edges(r"n\B"))).collect()]
    assert inner == [False, False, True]
