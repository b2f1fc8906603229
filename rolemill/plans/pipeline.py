"""The whole run: validate, load, rate in stages, archive; each step a no-op where nothing waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions import text
from rolemill.operators import filters, moves, schema
from rolemill.operators.settings import Settings
from rolemill.plans import answers as A
from rolemill.plans import load, rate


def run_all(
    stage: DataFrame,
    new_jobs: DataFrame,
    history: DataFrame,
    deleted: DataFrame,
    settings: Settings,
    as_of: Column,
    extracted: DataFrame | None = None,
    funnel: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One pass over the tables; ``extracted`` holds the answers of the extraction model.

    The result names the tables after the pass. Every rated row is told its table and written
    once, partitioned by it; a table then reads its own part. The sources whose approved rows were
    looked at are Loaded in ``funnel`` (source_id, status, jobs). The caller writes the tables themselves.
    """
    checked = load.validate_stage(stage).drop("first_bad")
    fresh = load.increment_load(checked, new_jobs, history, deleted, as_of=as_of)
    rows = schema.widen_union(new_jobs, fresh)
    rows = rate.simple_rate(rows, settings.title_deny, as_of)
    rows = rate.medium_a_rate(rows)
    if extracted is not None:
        rows = A.medium_b_rate(rows, extracted, as_of)
    rows = rate.medium_c_rate(rows, settings.stack_negative, settings.company_negative, as_of)
    old = F.coalesce(filters.is_older("LoadDttm", as_of, settings.archive_days), F.lit(False))
    place = F.when(text.trim("Status") == "2Delete", "deleted").when(old, "history").otherwise("new_jobs")
    part = moves.dealt(rows, place, "rated-rows")
    out = {
        "new_jobs": part("new_jobs"),
        "history": history.unionByName(part("history"), allowMissingColumns=True),
        "deleted": schema.widen_union(deleted, part("deleted")),
    }
    if funnel is not None:
        seen = checked.filter(text.trim("Status") == "Approved")
        out["funnel"] = moves.set_source_status(funnel, seen, "Loaded")
    return out


def stage_chain(jobs: DataFrame, version: int, rater) -> DataFrame:
    """normalise → enrich → rate as one projection over stored jobs."""
    return rate.rate_stage(rate.enrich_stage(rate.normalize_stage(jobs, version), version), version, rater)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and status after a run."""
    parts = [
        df.groupBy(F.lit(name).alias("table_name"), F.trim("Status" if "Status" in df.columns else "status").alias("Status")).agg(F.count(F.lit(1)).alias("n"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
