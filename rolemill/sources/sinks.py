"""Sinks: event log, day-partitioned analytics tables, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import text

# Columns and types of the analytics tables.
ANALYTICS = {
    "scrape_runs": "run_id string, source_id string, success boolean, jobs_received int, jobs_new int, finished_at timestamp",
    "job_events": "event_id string, job_id string, source_id string, run_id string, event_type string, created_at timestamp, payload string",
    "notifications": "job_id string, channel string, target_chat_id string, status string, sent_at timestamp",
    "apply_actions": "action_id string, job_id string, action string, source string, created_at timestamp",
    "daily_aggregates": "day date, new_jobs int, rated_jobs int, apply_jobs int, delete_jobs int, notifications_sent int, apply_actions int",
}
DAY_OF = {"scrape_runs": "finished_at", "job_events": "created_at", "notifications": "sent_at", "apply_actions": "created_at", "daily_aggregates": "day"}


def analytics_events(df: DataFrame, event_type, payload: Column, created_at: Column) -> DataFrame:
    """Rows of the analytics log: event type, time, payload struct."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    stamp = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select(kind.alias("event_type"), stamp.alias("created_at"), payload.alias("payload"))


def write_events_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def typed(df: DataFrame, table: str) -> DataFrame:
    """A frame in the columns and types of an analytics table; missing columns are null."""
    out = []
    for item in ANALYTICS[table].split(","):
        name, kind = item.strip().split(" ")
        out.append((F.col(name) if name in df.columns else F.lit(None)).try_cast(kind).alias(name))
    return df.select(*out)


def write_mart(df: DataFrame, table: str, root: str) -> None:
    """Append an analytics table, one folder per day.

    Rows are rebalanced by day before the write: Spark gathers a small day in one task
    and cuts a busy one by bytes, so files have about the advised size at any volume.
    """
    day_column = DAY_OF[table]
    day = F.to_date(F.col(day_column))
    rows = typed(df, table)
    if day_column == "day":
        rows.withColumn("event_day", day).write.mode("append").partitionBy("event_day").parquet(f"{root}/{table}")
        return
    shaped = rows.withColumn("event_day", day).hint("rebalance", F.col("event_day"))
    shaped.write.mode("append").partitionBy("event_day").parquet(f"{root}/{table}")


def scrape_log(df: DataFrame, source: Column, stage: Column, details: Column, at: Column) -> DataFrame:
    """Rows of the scrape log: when, source, stage, details."""
    return df.select(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        text(source).alias("source"),
        text(stage).alias("stage"),
        text(details).alias("details"),
    )


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
