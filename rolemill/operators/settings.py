"""Parameters of the jobs: typed values, setting tables and message layouts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import join_filled, text, trim


@dataclass(frozen=True)
class Settings:
    """Everything a rule reads from configuration. Lists are short and written by hand."""

    title_deny: str = ""
    stack_negative: tuple[str, ...] = ()
    company_negative: tuple[str, ...] = ()
    target_keywords: tuple[str, ...] = ("backend", "node", "typescript", "gcp", "remote")
    deny_keywords: tuple[str, ...] = ("intern", "frontend", "designer", "qa")
    weak_models: tuple[str, ...] = ()
    archive_days: int = 7
    min_apply_rate: int = 3
    notify_min_rate: int = 4
    plan_daily_cap: int = 24
    enqueue_daily_cap: int = 200
    notify_daily_cap: int = 20
    lease_minutes: int = 240
    lease_keep_hours: int = 72

    @classmethod
    def from_table(cls, table: DataFrame) -> Settings:
        """Read known keys of a (row_seq, key, value) table; unknown keys stay behind in Spark."""
        names = [f.name for f in fields(cls)]
        known = first_values(table, fold=True).filter(F.col("key").isin(*names))
        given = {row["key"]: row["value"] for row in known.collect()}
        parsed = {}
        for f in fields(cls):
            if f.name not in given:
                continue
            raw = given[f.name]
            if f.type == "int":
                parsed[f.name] = int(raw)
            elif f.type == "str":
                parsed[f.name] = raw
            else:
                parsed[f.name] = tuple(v.strip().lower() for v in raw.split(",") if v.strip())
        return cls(**parsed)


@dataclass(frozen=True)
class KeywordRule:
    deny: tuple[str, ...] = field(default_factory=tuple)
    target: tuple[str, ...] = field(default_factory=tuple)


def first_values(table: DataFrame, fold: bool = False) -> DataFrame:
    """First value per key in row order; keys trimmed, optionally in lower case."""
    key = F.lower(trim("key")) if fold else trim("key")
    return (
        table.select(key.alias("key"), "row_seq", text("value").alias("value"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("entries"), F.min_by("value", "row_seq").alias("value"))
    )


def notify_message(title, company, location, rate, reason, address) -> Column:
    """The lines of a notification, blank lines left out."""
    rated = F.concat(F.lit("Rate: "), text(rate))
    return join_filled("\n", F.lit("New good job"), trim(title), trim(company), trim(location), rated, trim(reason), trim(address))
