"""The fields of a card are evaluated once, also where rows are filtered by one of them."""

from rolemill.catalog.registry import QUERIES
from tests.conftest import SF_DIR


def test_a_filter_on_the_address_does_not_evaluate_all_fields_again(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = QUERIES["extract_cards"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("map_from_entries") == 1
