"""Source configuration: typed rows with defaults, and the sheet-to-table synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import first_filled, trim
from rolemill.functions.values import non_negative_int, positive_int, truthy_enabled

# Numbers used where a cell is blank or not a number.
NUMBER_DEFAULTS = {
    "priority": ("priority", 100),
    "minIntervalMin": ("min_interval_min", 60),
    "retryLimit": ("retry_limit", 2),
    "retryBackoffMin": ("retry_backoff_min", 15),
    "dailySuccessCap": ("daily_success_cap", 0),
}
CONFIG = ["source_id", "name", "enabled", "scrape_page_url", *[n for n, _ in NUMBER_DEFAULTS.values()], "max_tabs_per_site"]
RUNTIME = ["leased_until", "last_started_at", "last_success_at", "last_failure_at", "consecutive_failures"]


def load_source_config(sheet: DataFrame) -> DataFrame:
    """Sheet rows as typed configuration; rows with neither id nor name are dropped."""
    have = {c.lower(): c for c in sheet.columns}
    cell = lambda name: F.col(have[name.lower()]) if name.lower() in have else F.lit("")
    ident = first_filled(cell("source_id"), cell("id"), cell("name"))
    numbers = [
        non_negative_int(cell(name), default).alias(out) for name, (out, default) in NUMBER_DEFAULTS.items()
    ]
    return sheet.select(
        ident.alias("source_id"),
        first_filled(cell("name"), ident).alias("name"),
        truthy_enabled(cell("enabled")).alias("enabled"),
        trim(cell("scrapePageUrl")).alias("scrape_page_url"),
        *numbers,
        positive_int(cell("maxTabsPerSite"), 0).alias("max_tabs_per_site"),
    ).filter(F.col("source_id") != "")


def sync_source_config(stored: DataFrame, sheet: DataFrame) -> DataFrame:
    """Configuration columns from the sheet, runtime columns as stored; sources only stored stay."""
    fresh = load_source_config(sheet)
    renamed = fresh.select(F.col("source_id").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in CONFIG[1:]])
    joined = stored.join(renamed, F.col("source_id") == F.col("_id"), "full_outer")
    merged = [F.coalesce(f"_n_{c}", c).alias(c) for c in CONFIG[1:]]
    runtime = [F.coalesce(c, F.lit(0)).alias(c) if c == "consecutive_failures" else F.col(c) for c in RUNTIME]
    return joined.select(F.coalesce("source_id", "_id").alias("source_id"), *merged, *runtime)
