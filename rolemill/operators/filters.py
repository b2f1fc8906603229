"""Row filters over status, rate, time and version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import ascii_edges, text, title_deny_pattern, trim


def by_status(df: DataFrame, *states: str) -> DataFrame:
    return df.filter(trim("Status").isin(*states))


def loaded_unrated(df: DataFrame) -> DataFrame:
    """Loaded rows with neither a rate nor a model."""
    return df.filter((trim("Status") == "Loaded") & (trim("JobRateNum") == "") & (trim("RatedModelName") == ""))


def weak_model(df: DataFrame, models) -> DataFrame:
    return df.filter((trim("Status") == "Loaded") & trim("RatedModelName").isin(*models))


def title_denied(title, pattern: str | None) -> Column:
    """True where the title matches the configured pattern."""
    prepared = title_deny_pattern(pattern)
    return F.lit(False) if prepared is None else text(title).rlike(ascii_edges(prepared))


def is_older(date, as_of, days: int) -> Column:
    """True for readable dates at or before the cutoff; false for the rest."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return F.coalesce(F.col(date) <= cutoff if isinstance(date, str) else date <= cutoff, F.lit(False))


def older_than(df: DataFrame, date: str, as_of, days: int) -> DataFrame:
    return df.filter(is_older(date, as_of, days))


def good_jobs(df: DataFrame, min_rate: int) -> DataFrame:
    return df.filter((F.col("rate_num") >= min_rate) & (F.col("status") == "2Apply"))


def enabled_sources(df: DataFrame, supported=()) -> DataFrame:
    """Enabled sources with an address; an empty ``supported`` allows all."""
    kept = df.filter(F.col("enabled") & (text("scrape_page_url") != ""))
    return kept.filter(F.col("source_id").isin(*supported)) if supported else kept


def _minutes(count: Column) -> Column:
    return F.make_dt_interval(mins=count)


def due_at(df_columns=None) -> Column:
    """The earliest moment a source may run again, null when it may at once."""
    at_least_one = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1)))
    by_start = F.col("last_started_at") + _minutes(at_least_one("min_interval_min"))
    tries = F.least(F.col("consecutive_failures"), at_least_one("retry_limit"))
    by_failure = F.when(
        F.col("consecutive_failures") > 0,
        F.col("last_failure_at") + _minutes(at_least_one("retry_backoff_min") * tries),
    )
    return F.greatest(by_start, by_failure)


def due_sources(df: DataFrame, as_of) -> DataFrame:
    """Sources that are not leased and whose interval and back-off have passed."""
    free = F.coalesce(F.col("leased_until") <= as_of, F.lit(True))
    return df.filter(free & F.coalesce(due_at() <= as_of, F.lit(True)))


def notify_candidates(jobs: DataFrame, notifications: DataFrame, chat: str, min_rate: int = 4) -> DataFrame:
    """Good jobs nobody was told about yet in this chat."""
    sent = notifications.filter((F.col("status") == "sent") & (F.col("target_chat_id") == chat)).select("job_id")
    wanted = good_jobs(jobs, min_rate).filter(trim("notified_at") == "")
    return wanted.join(sent, "job_id", "left_anti")


def version_gate(df: DataFrame, column: str, version: int) -> DataFrame:
    """Only rows a stage has not handled in this version."""
    return df.filter(F.coalesce(F.col(column), F.lit(0)) < version)
