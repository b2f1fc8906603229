"""Orders and limits: mart order, top lists, plans, leases, load order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.operators.winners import SEQ


def mart_order(df: DataFrame) -> DataFrame:
    """Rate down, then rating and load time down, unreadable times last."""
    return df.orderBy(
        F.col("rate").desc(), F.desc_nulls_last("JobRateDttm"), F.desc_nulls_last("LoadDttm"), F.col(SEQ)
    )


def top_good_jobs(df: DataFrame, limit: int = 20) -> DataFrame:
    """Newest good jobs, as many as asked for (one at least); a caller that must bound what it serves bounds ``limit``."""
    return df.orderBy(F.desc_nulls_last("last_seen_at"), "job_id").limit(max(1, limit))


def plan_order(df: DataFrame, limit: int = 1) -> DataFrame:
    """Highest priority first, then by source id, as many as asked for (one at least)."""
    return df.orderBy(F.col("priority").desc(), "source_id").limit(max(1, limit))


def first_in_order(df: DataFrame, limit: int) -> DataFrame:
    """The first rows in table order; 0 means all."""
    return df.orderBy(SEQ).limit(limit) if limit > 0 else df


def newest_load_first(df: DataFrame) -> DataFrame:
    """Later loads on top, each load in its own order."""
    return df.orderBy(F.desc_nulls_last("LoadDttm"), SEQ)
