"""Quotas, scrape plans, rating leases and task states."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, StructField, StructType

from rolemill.functions.keys import row_key, snapshot_hash, stable_key
from rolemill.functions.text import trim
from rolemill.functions.values import instant
from rolemill.operators import filters, joins, order
from rolemill.operators.winners import RANGE_ROWS, SEQ
from rolemill.session import ship_package


def daily_quota(asked: DataFrame, cap: int, counter: str = "counter", day: str = "day", amount: str | None = None) -> DataFrame:
    """Add ``granted``: requests per counter and day in arrival order while the cap lasts; below 1 no limit.

    A request takes 1, or ``amount`` (at least 1). One that doesn't fit is refused and takes nothing,
    so a smaller one after it may still be granted. Rows are dealt by ranges of row numbers, so no task
    holds a whole group, and only the sums of ranges are added up along a group. Where every
    request takes 1, that is the answer.
    """
    if cap < 1:
        return asked.withColumn("granted", F.lit(True))
    size = F.lit(1) if amount is None else F.greatest(F.coalesce(F.col(amount).cast("long"), F.lit(1)), F.lit(1))
    # a struct is never null itself, so rows without a counter or day are a group too
    ranged = asked.withColumns({"_key": F.struct(F.col(counter).alias("counter"), F.col(day).alias("day")), "_range": F.floor(F.col(SEQ) / RANGE_ROWS), "_size": size})
    if amount is not None:
        return _sized_quota(asked, ranged, cap)
    sums = ranged.groupBy("_key", "_range").agg(F.sum("_size").alias("_sum"))
    along = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_key", "_range", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_key", "_range").orderBy(SEQ)
    placed = ranged.withColumn("_at", F.row_number().over(inside)).join(before, ["_key", "_range"])
    return placed.select(*asked.columns, (F.col("_before") + F.col("_at") <= cap).alias("granted"))


def _sized_quota(asked: DataFrame, ranged: DataFrame, cap: int) -> DataFrame:
    """Requests of different sizes: those that stay open after ``_placed`` are walked in order."""
    placed = _placed(ranged, cap)
    sure = placed.filter("NOT _open").select(*asked.columns, (F.col("_whole") & (F.col("_size") <= cap)).alias("granted"))
    walked = placed.filter("_open").select("_key", F.col(SEQ).alias("_seq"), "_size", "_edge", F.struct(*asked.columns).alias("_row"))
    ship_package(asked.sparkSession)
    kind = StructType([StructField("_row", walked.schema["_row"].dataType), StructField("granted", BooleanType())])
    granted = walked.groupBy("_key").applyInArrow(_walk, kind)
    return sure.unionByName(granted.select("_row.*", "granted"))


def _placed(ranged: DataFrame, cap: int) -> DataFrame:
    """Requests with ``_whole`` (their range is granted as a whole), ``_edge`` (what is left there) and ``_open``.

    A range whose requests all fit behind those before it is granted as a whole. From the first
    one that doesn't fit (the edge) on, rows are walked in order, but few can matter:

    - If all sizes below t before a range add up to more than the cap, less than t is left there:
      were t left, each of them would have fitted. So larger requests are refused unseen.
    - Of requests of one size, later ones are granted only if earlier ones are. So a range offers
      no more of a size than fit into what may be left.

    What is walked depends on the cap and the number of ranges, not on the number of rows.
    """
    classes = range(1, cap.bit_length() + 1)
    below = {f"_c{k}": F.sum(F.when(F.col("_size") < 2**k, F.col("_size")).otherwise(0)) for k in classes}
    fitting = F.sum(F.when(F.col("_size") <= cap, F.col("_size")).otherwise(0))
    sums = ranged.groupBy("_key", "_range").agg(fitting.alias("_sum"), *[c.alias(n) for n, c in below.items()])
    along = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"_b{c}") for c in ["_sum", *below]]
    known = sums.select("_key", "_range", "_sum", *before)
    whole = F.col("_b_sum") + F.col("_sum") <= cap
    exact = F.when(F.col("_b_sum") <= cap, cap - F.col("_b_sum")).otherwise(cap)
    left = F.least(exact, F.lit(cap), *[F.when(F.col(f"_b_c{k}") > cap, 2**k - 2).otherwise(cap) for k in classes])
    group = W.partitionBy("_key")
    # at the edge ``left`` is exact, and it is the most that any later range can have
    limits = known.select("_key", "_range", whole.alias("_whole"), left.alias("_left"), F.max(F.when(~whole, cap - F.col("_b_sum"))).over(group).alias("_edge"))
    inside = W.partitionBy("_key", "_range", "_size").orderBy(SEQ)
    # after the join rows lie together by range, and counting inside takes no further shuffle
    placed = ranged.join(limits, ["_key", "_range"]).withColumn("_nth", F.row_number().over(inside))
    most = F.least("_left", F.coalesce("_edge", F.lit(cap)))
    return placed.withColumn("_open", ~F.col("_whole") & (F.col("_size") * F.col("_nth") <= most))


def _walk(rows: pa.Table) -> pa.Table:
    """One group's open requests in order."""
    rows = rows.sort_by("_seq")
    left = rows["_edge"][0].as_py()
    granted = []
    for size in rows["_size"].to_pylist():
        granted.append(size <= left)
        if size <= left:
            left -= size
    return pa.table({"_row": rows["_row"], "granted": pa.array(granted, pa.bool_())})


def claim_plan(
    sources: DataFrame,
    runs: DataFrame,
    as_of: Column,
    lease_minutes: int,
    addon: str,
    supported=(),
    limit: int = 1,
    day_left: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lease commands for the best due sources, and the configuration rows they change.

    ``day_left`` is what remains of the day's plan quota; None means no quota.
    """
    able = filters.due_sources(filters.enabled_sources(sources, supported), as_of)
    able = joins.below_daily_cap(able, runs, as_of)
    wanted = limit if day_left is None else min(limit, day_left)
    chosen = order.plan_order(able, wanted) if wanted > 0 else able.limit(0)
    until = as_of + F.make_dt_interval(mins=F.lit(lease_minutes))
    commands = chosen.select(
        F.sha2(F.concat_ws("|", "source_id", F.lit(addon), as_of.cast("string")), 256).alias("lease_id"),
        "source_id",
        F.lit(addon).alias("addon_instance_id"),
        F.lit("leased").alias("status"),
        as_of.alias("issued_at"),
        until.alias("leased_until"),
        F.col("scrape_page_url"),
        F.lit("list").alias("mode"),
    )
    changed = commands.select("source_id", "leased_until", F.col("issued_at").alias("last_started_at"))
    return commands, changed


def issue_leases(df: DataFrame, leases: DataFrame, run_id: str, table_name: str, as_of: Column, limit: int = 0) -> DataFrame:
    """Lease rows in final rating that are unique and not leased yet, in table order."""
    rows = candidates(df)
    whole = F.min_by(F.struct(*rows.columns), SEQ).alias("_row")
    once = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("_n"), whole).filter("_n = 1")
    unique = once.select("_row.*")
    free = joins.unleased(unique, leases, table_name)
    picked = order.first_in_order(free, limit)
    parts = [c for c in ("JobCompany", "JobTitle", "JobLocation", "JobModality", "JobSeniority") if c in df.columns]
    return picked.select(
        SEQ,
        F.sha2(F.concat_ws("|", F.lit(run_id), "stable_key", "snapshot_hash"), 256).alias("lease_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(table_name).alias("table_name"),
        "stable_key",
        "snapshot_hash",
        row_key("JobId", "JobUrl", parts, SEQ).alias("row_key"),
        F.lit("leased").alias("state"),
        as_of.alias("issued_at"),
    )


def candidates(df: DataFrame) -> DataFrame:
    """Rows in final rating with their identity; rows without a key are left out."""
    keyed = df.filter(trim("Status") == "2LRate").withColumns(
        {"stable_key": stable_key("JobId", "JobUrl"), "snapshot_hash": snapshot_hash(df.columns)}
    )
    named = keyed.filter(F.col("stable_key") != "")
    return named.withColumn("identity", F.concat_ws("|", "stable_key", "snapshot_hash"))


def lease_skips(df: DataFrame, leases: DataFrame, table_name: str) -> DataFrame:
    """One row: how many rows were passed over, and why."""
    asked = df.filter(trim("Status") == "2LRate").select(stable_key("JobId", "JobUrl").alias("stable_key"), snapshot_hash(df.columns).alias("snapshot_hash"))
    named = F.col("stable_key") != ""
    counts = asked.groupBy("stable_key", F.when(named, F.col("snapshot_hash")).alias("snapshot_hash")).agg(F.count(F.lit(1)).alias("n"))
    judged = joins.mark_leased(counts, leases, table_name)
    once = named & (F.col("n") == 1)
    total = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0))
    return judged.agg(
        total(~named).alias("skipped_missing"),
        total(named & (F.col("n") > 1)).alias("skipped_duplicate"),
        F.count_if(once & F.col("leased")).alias("skipped_leased"),
        F.count_if(once & ~F.col("leased")).alias("issued"),
    )


def expire_leases(leases: DataFrame, as_of: Column, minutes: int = 240, keep_hours: int = 72) -> DataFrame:
    """Open leases past their time (or without a readable one) expire; finished ones are dropped after a while."""
    issued, updated = instant("issued_at"), instant("updated_at")
    now = as_of.cast("timestamp")
    open_lease = F.col("state") == "leased"
    stale = open_lease & ~F.coalesce(issued > now - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))
    old = ~open_lease & F.coalesce(updated <= now - F.make_dt_interval(hours=F.lit(keep_hours)), F.lit(False))
    return leases.filter(~old).withColumns(
        {
            "error": F.when(stale, f"Lease expired after {minutes} minutes").otherwise(F.col("error")),
            "updated_at": F.when(stale, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("updated_at")),
            "state": F.when(stale, "expired").otherwise(F.col("state")),
        }
    )


def requeue(jobs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known jobs to rate again with the next version; returns (jobs, tasks)."""
    ids = wanted.select(F.col("job_id")).distinct().withColumn("_again", F.lit(True))
    joined = jobs.join(ids, "job_id", "left")
    again = F.coalesce("_again", F.lit(False))
    version = F.coalesce("pipeline_version", F.lit(0)) + 1
    out = joined.withColumns(
        {
            "rate_status": F.when(again, "pending").otherwise(F.col("rate_status")),
            "pipeline_version": F.when(again, version).otherwise(F.col("pipeline_version")),
        }
    )
    tasks = out.filter(again).select("job_id", F.lit("queued").alias("status"), F.col("pipeline_version").alias("version"))
    return out.drop("_again"), tasks


def task_states(events: DataFrame) -> DataFrame:
    """State per job from its task events: last status, runs so far, last error."""
    return events.groupBy("job_id").agg(
        F.max_by("status", SEQ).alias("status"),
        F.count_if(F.col("status") == "running").alias("attempt"),
        F.max_by("error", SEQ).alias("error"),
    )
