"""From scrape to new rows: staging, validation, incremental load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rolemill.functions import keys as K
from rolemill.functions.text import blank_to_null, text, trim
from rolemill.operators import joins, schema
from rolemill.operators.winners import SEQ, keep_first, mark
from rolemill.session import written


def append_stage(rows: DataFrame, header, page_name: str = "") -> DataFrame:
    """Rows as they enter staging: the header's columns, Staged, page name filled."""
    if "ScrapePageName" not in rows.columns:
        rows = rows.withColumn("ScrapePageName", F.lit(""))
    ready = rows.withColumns(
        {"Status": F.lit("Staged"), "ScrapePageName": F.coalesce(blank_to_null(text("ScrapePageName")), F.lit(page_name))}
    )
    return schema.align(ready, header)


def validate_stage(stage: DataFrame) -> DataFrame:
    """All-or-nothing Staged → Approved; every row carries the first bad row number, null if none."""
    status = trim("Status")
    bad = stage.agg(F.min(F.when(~status.isin("Staged", "Approved"), F.col(SEQ))).alias("first_bad")).scalar()
    checked = stage.withColumn("first_bad", bad)
    go = F.col("first_bad").isNull() & (status == "Staged")
    return checked.withColumn("Status", F.when(go, "Approved").otherwise(F.col("Status")))


def stage_split(stage: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``part``: new, duplicate or untouched (not approved)."""
    keyed = joins.with_job_key(stage)
    approved = trim("Status") == "Approved"
    fresh = joins.fresh_rows(keyed.filter(approved).select(SEQ, "job_key"), history)
    marked = mark(keyed, fresh, "_new")
    part = (
        F.when(~approved, "untouched")
        .when(F.col("_new") | F.col("job_key").isNull(), "new")
        .otherwise("duplicate")
    )
    return marked.withColumn("part", part).drop("_new")


def increment_load(stage: DataFrame, *tables: DataFrame, as_of: Column) -> DataFrame:
    """New approved rows as Loaded; ``tables`` are the new, archived and deleted rows so far."""
    approved = stage.filter(trim("Status") == "Approved")
    fresh = joins.increment_rows(approved, joins.history_keys(*tables))
    return fresh.withColumns({"Status": F.lit("Loaded"), "LoadDttm": as_of}).drop("job_key")


def scrape_to_stage(jobs: DataFrame, details: DataFrame, *tables: DataFrame, header) -> DataFrame:
    """Scraped postings of all sources to staging rows.

    Repeats inside a source fill each other's blanks, the session key removes
    repeats across sources, history removes known ones, details overwrite. The
    batch is written once before it meets the history, since three joins read it.
    """
    keyed = jobs.withColumn("session_key", blank_to_null(K.session_key("JobId", "JobUrl"))).filter(
        F.col("session_key").isNotNull()
    )
    fields = [c for c in jobs.columns if c not in (SEQ, "ScrapePageName")]
    firsts = [F.min_by(c, F.when(text(c) != "", F.col(SEQ))).alias(c) for c in fields]
    merged = keyed.groupBy("ScrapePageName", "session_key").agg(F.min(SEQ).alias(SEQ), *firsts)
    filled = merged.select(SEQ, "session_key", "ScrapePageName", *[text(c).alias(c) for c in fields])
    once = written(keep_first(filled, "session_key"), "scraped-once")
    mask = joins.keep_mask(once, *tables)
    kept = once.join(mask.filter("keep"), SEQ, "left_semi")
    detail_fields = [c for c in details.columns if c not in (SEQ, "session_key") and c in fields]
    whole = joins.merge_overwrite(kept, details, "session_key", detail_fields)
    return append_stage(whole, header)


def logged_load(
    checked: DataFrame, *tables: DataFrame, folder: str, as_of: Column, started: Column, ended: Column, target: str = "NewJobs"
) -> DataFrame:
    """Load a stage from ``validate_stage`` into ``folder``; returns the load's audit row.

    The counts are observed by the job that writes the new rows, so the stage isn't read again for
    them. A stage with a row that isn't valid loads nothing: the row says so, counts nothing as
    loaded, and names the first such row.
    """
    seen = Observation("load")
    new, valid = F.col("part") == "new", F.col("first_bad").isNull()
    split = stage_split(checked, joins.history_keys(*tables))
    split = split.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(new & valid & (trim("Status") == "Approved")).alias("new"),
        F.count_if((F.col("part") == "duplicate") & valid).alias("double"),
        F.min("first_bad").alias("first_bad"),
    )
    loaded = split.filter(new & valid & (trim("Status") == "Approved")).withColumns({"Status": F.lit("Loaded"), "LoadDttm": as_of})
    loaded.drop("part", "first_bad", "job_key").write.mode("append").parquet(folder)
    counts = seen.get
    bad = counts["first_bad"]
    one = checked.sparkSession.range(1)
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return one.select(
        F.lit(target).alias("HistSheetName"),
        stamp(started).alias("StartDttm"),
        stamp(ended).alias("EndDttm"),
        F.lit(counts["total"]).alias("StageRowsTotal"),
        F.lit(counts["new"]).alias("NewCount"),
        F.lit(counts["double"]).alias("DoubleCount"),
        F.lit(counts["new"]).alias("LoadedCount"),
        F.lit(bad is None).alias("SuccessFlag"),
        F.lit("" if bad is None else str(bad)).alias("FailAtRowNum"),
    )
