"""Physical plans: no nested-loop joins, pruned scans, no single-task windows over whole tables."""

import pytest

from rolemill.catalog.registry import QUERIES
from tests.conftest import SF_DIR

JOINS = [
    "increment_anti_join", "filter_duplicates", "prioritized_update_match", "application_match", "increment_load",
    "merge_fill_blank", "location_winner", "daily_quota", "fail_closed_update", "issue_leases", "load_report",
    "upsert_jobs", "scrape_to_stage", "apply_action_join", "source_gate", "resolve_source_id", "run_all", "sync_job_states",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_joins_are_equality_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("name", "columns", "pushed"),
    [
        ("top_good_jobs", {"o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"}, ""),
        ("scan_pages", {"page_id", "url", "html"}, ""),
        ("run_summary", {"event_id", "event_type", "ts"}, ""),
    ],
)
def test_scans_read_only_their_columns(spark, name, columns, pushed):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} <= columns
    assert pushed in plan


def test_quota_is_reached_in_levels(spark):
    """No window goes over a whole counter: rows are ranked by range of row numbers first."""
    plan = plan_of(QUERIES["daily_quota"](spark, SF_DIR))
    assert plan.count("Window") >= 2 and "NestedLoop" not in plan


def test_top_list_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_good_jobs"](spark, SF_DIR))


def test_orders_come_out_in_order(spark):
    from rolemill.catalog.registry import ORACLES
    from tests.oracle import connect

    con = connect(SF_DIR)
    for name in ("mart_order", "top_good_jobs", "plan_order", "lease_limit"):
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        have = [tuple(r) for r in QUERIES[name](spark, SF_DIR).select(*names).collect()]
        assert have == cursor.fetchall()


def test_matches_read_each_side_once(spark):
    """Hash exchanges and scans of the matches, those of the composed views included."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, exchanges, scans in (("prioritized_update_match", 10, 7), ("application_match", 10, 7), ("issue_leases", 9, 7)):
            plan = plan_of(QUERIES[name](spark, SF_DIR))
            assert plan.count("Exchange hashpartitioning") <= exchanges, name
            assert plan.count("FileScan") <= scans, name
            assert "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
