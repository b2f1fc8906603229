"""Header work: alignment, widening, validation, defaults and fixed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import blank_to_null, collapse, first_filled, text, trim
from rolemill.operators.winners import attach_group

# The posting contract, the mart and the application table.
POSTING = (
    "JobId", "JobTitle", "JobCompany", "JobLocation", "JobSeniority", "JobModality", "JobSalary", "JobTags",
    "JobDescription", "JobUrl", "JobApplyUrl", "JobEasyApplyFlg", "JobPostedDttm", "JobRateNum",
    "JobRateDesc", "JobRateShortDesc", "JobRateDttm", "RatedModelName", "Status", "ScrapePageName",
    "LoadDttm", "JobTop3Stack", "JobTop3Want", "JobWorkMode",
)
MART = (
    "JobTitle", "JobCompany", "JobLocation", "JobTags", "JobDescription", "JobId", "JobApplyUrl",
    "ScrapePageName", "JobRateDttm", "JobRateNum", "JobRateDesc", "JobRateShortDesc", "RatedModelName",
    "Status", "LoadDttm", "JobTop3Stack", "JobTop3Want", "JobWorkMode",
)
APPLICATION = (
    "ApplicationDate", "LastContactDate", "JobCompany", "JobUrl", "JobTitle", "JobDescription", "JobTop3Want",
    "JobTop3Stack", "JobRateDesc", "JobRateShortDesc", "ApplicationText", "HRResponseText",
)
DEFAULTS = {"Status": "Staged"}


def read_header(df: DataFrame) -> DataFrame:
    """Trim column names and drop columns without a name."""
    named = [(c, c.strip()) for c in df.columns]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in named if n])


def align(df: DataFrame, header) -> DataFrame:
    """The target header in its order; missing columns blank, extra ones dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in header])


def widen_union(target: DataFrame, source: DataFrame) -> DataFrame:
    """Append rows; columns only one side has are blank on the other."""
    return target.unionByName(source, allowMissingColumns=True).fillna("")


def validate_header(df: DataFrame, expected, actual=None) -> DataFrame:
    """One row: is the header as expected, and every way in which it is not."""
    have, want = list(actual if actual is not None else df.columns), list(expected)
    missing = [c for c in want if c not in have]
    extra = [c for c in have if c not in want]
    errors = []
    if missing:
        errors.append("Missing columns: " + ", ".join(missing))
    if extra:
        errors.append("Extra columns: " + ", ".join(extra))
    if len(have) != len(want):
        errors.append(f"Column count mismatch: expected {len(want)}, got {len(have)}")
    elif have != want:
        errors.append("Column order mismatch")
    report = df.agg(F.count(F.lit(1)).alias("row_count"))
    return report.select(F.lit(not errors).alias("valid"), F.lit("; ".join(errors)).alias("errors"), "row_count")


def normalize_job(df: DataFrame, fields=POSTING) -> DataFrame:
    """Canonical fields collapsed and never null; other columns as they are."""
    known = set(fields)
    kept = [collapse(c).alias(c) if c in known else F.col(c) for c in df.columns]
    return df.select(*kept, *[F.lit("").alias(c) for c in fields if c not in df.columns])


def default_job(df: DataFrame, defaults=None, fields=POSTING) -> DataFrame:
    """The empty template below the row's own values."""
    given = DEFAULTS if defaults is None else defaults
    out = []
    for c in fields:
        blank = F.lit(given.get(c, ""))
        out.append(F.coalesce(F.col(c), blank).alias(c) if c in df.columns else blank.alias(c))
    return df.select(*[c for c in df.columns if c not in fields], *out)


def source_defaults(df: DataFrame, defaults: DataFrame, fields) -> DataFrame:
    """Fill blanks from per-source defaults; the configuration has one row per source."""
    renamed = defaults.select("source_id", *[F.col(c).alias(f"_d_{c}") for c in fields])
    joined = attach_group(df, renamed, "source_id")
    filled = {c: F.coalesce(blank_to_null(F.col(c)), F.col(f"_d_{c}"), F.lit("")) for c in fields}
    return joined.withColumns(filled).select(*df.columns)


def cloud_job(df: DataFrame) -> DataFrame:
    """A posting as ingest input; postings without an address are dropped."""
    address = first_filled("JobUrl", "JobApplyUrl")
    return df.select(
        *[c for c in ("row_seq",) if c in df.columns],
        trim("JobId").alias("external_job_id"),
        address.alias("job_url"),
        first_filled("JobApplyUrl", "JobUrl").alias("job_apply_url"),
        trim("JobTitle").alias("job_title"),
        trim("JobCompany").alias("job_company"),
        trim("JobLocation").alias("job_location"),
        text("JobTags").alias("job_tags"),
        text("JobDescription").alias("job_description"),
    ).filter(F.col("job_url") != "")


def application_rows(df: DataFrame, as_of) -> DataFrame:
    """The twelve columns of the application table."""
    made = {
        "ApplicationDate": as_of,
        "LastContactDate": as_of,
        "JobUrl": first_filled("JobUrl", "JobApplyUrl"),
        "ApplicationText": F.lit(""),
        "HRResponseText": F.lit(""),
    }
    out = [(made[c] if c in made else text(c) if c in df.columns else F.lit("")).alias(c) for c in APPLICATION]
    return df.select(*[c for c in ("row_seq",) if c in df.columns], *out)


def good_job_items(df: DataFrame) -> DataFrame:
    """List entry of a rated job with the address to apply at."""
    return df.select(
        "job_id",
        text("title").alias("title"),
        text("company").alias("company"),
        text("location").alias("location"),
        F.coalesce("rate_num", F.lit(0)).alias("rate_num"),
        text("rate_reason").alias("rate_reason"),
        text("status").alias("status"),
        F.coalesce(blank_to_null(text("apply_url")), text("canonical_url")).alias("apply_url"),
    )


def stage_rows(jobs: DataFrame) -> DataFrame:
    """New jobs of a run under their sheet names."""
    return jobs.filter("is_new").select(
        "scrape_run_id",
        trim("external_job_id").alias("JobId"),
        trim("title").alias("JobTitle"),
        trim("company").alias("JobCompany"),
        trim("location").alias("JobLocation"),
        F.array_join("tags", ", ").alias("JobTags"),
        trim("description").alias("JobDescription"),
        trim("canonical_url").alias("JobUrl"),
        trim("apply_url").alias("JobApplyUrl"),
        F.col("source_id").alias("ScrapePageName"),
    )


def job_state_rows(jobs: DataFrame) -> DataFrame:
    """Outward state of rated jobs: identity, text, rate, status."""
    return jobs.select(
        trim("external_job_id").alias("JobId"),
        trim("canonical_url").alias("JobUrl"),
        trim("apply_url").alias("JobApplyUrl"),
        trim("title").alias("JobTitle"),
        trim("company").alias("JobCompany"),
        trim("location").alias("JobLocation"),
        F.col("rate_num").alias("JobRateNum"),
        F.col("rate_reason").alias("JobRateDesc"),
        F.col("rate_reason").alias("JobRateShortDesc"),
        F.col("rate_provider").alias("RatedModelName"),
        F.col("status").alias("Status"),
    )
