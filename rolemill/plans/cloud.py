"""The job store: ingest, stage chain, actions, notifications, state sync, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions import keys as K
from rolemill.functions.text import blank_to_null, first_filled, normalize_key, normalize_tag_array, text, trim
from rolemill.operators import filters, joins
from rolemill.operators.settings import notify_message
from rolemill.operators.winners import SEQ, attach_group, first_rows
from rolemill.plans.leases import daily_quota
from rolemill.session import written

CAP_ERROR = "Daily task enqueue cap reached"
NOTIFY_ERROR = "Daily notify cap reached"

# The state of a job that was never seen before.
INITIAL = {
    "pipeline_stage": "ingested",
    "pipeline_version": 1,
    "normalize_version": 0,
    "enrich_version": 0,
    "rate_version": 0,
    "sheet_sync_version": 0,
    "enrich_summary": "",
    "work_mode_hint": "Unknown",
    "rate_status": "pending",
    "rate_num": 0,
    "rate_reason": "",
    "rate_provider": "",
    "rated_model": "",
    "status": "new",
    "notified_at": "",
}
SEEN = ["source_id", "external_job_id", "canonical_url", "apply_url", "title", "company", "location", "tags", "description", "scrape_run_id"]


def result_jobs(results: DataFrame) -> DataFrame:
    """Scrape results to job rows: one per job id and run, the first by position.

    ``results``: row_seq, source_id, run_id, external_job_id, job_url, job_apply_url,
    job_title, job_company, job_location, job_tags (array), job_description.
    """
    url = trim("job_url")
    rows = results.select(
        SEQ,
        K.job_id_hash(trim("source_id"), "external_job_id", "job_url").alias("job_id"),
        trim("source_id").alias("source_id"),
        trim("external_job_id").alias("external_job_id"),
        url.alias("canonical_url"),
        first_filled("job_apply_url", url).alias("apply_url"),
        trim("job_title").alias("title"),
        trim("job_company").alias("company"),
        trim("job_location").alias("location"),
        normalize_tag_array("job_tags").alias("tags"),
        trim("job_description").alias("description"),
        F.col("run_id").alias("scrape_run_id"),
    )
    firsts = first_rows(rows.select(SEQ, "job_id", "scrape_run_id"), "scrape_run_id", "job_id")
    return rows.join(firsts.select(SEQ), SEQ, "left_semi")


def upsert_jobs(jobs: DataFrame, batch: DataFrame, as_of: Column, once: bool = False) -> DataFrame:
    """New ids enter in their initial state, known ones refresh text and sight, the rest stay.

    ``batch`` holds an id once (the latest run of a micro-batch), with ``runs`` if several of its
    runs may have seen it. With ``once`` a row that the same run has written stays as it is.
    """
    runs = F.col("runs") if "runs" in batch.columns else F.lit(1)
    fresh = batch.select("job_id", runs.alias("_n_runs"), *[F.col(c).alias(f"_n_{c}") for c in SEEN])
    joined = jobs.join(fresh, "job_id", "full_outer")
    known = F.col("first_seen_at").isNotNull()
    applied = F.coalesce(known & (F.col("scrape_run_id") == F.col("_n_scrape_run_id")), F.lit(False))
    seen = F.col("_n_source_id").isNotNull() & (~applied if once else F.lit(True))
    new = seen & ~known
    out = {c: F.when(seen, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in SEEN}
    out["last_seen_at"] = F.when(seen, as_of).otherwise(F.col("last_seen_at"))
    out["first_seen_at"] = F.when(new, as_of).otherwise(F.col("first_seen_at"))
    out["is_new"] = F.when(seen, new & (F.col("_n_runs") == 1)).otherwise(F.col("is_new"))
    for name, value in INITIAL.items():
        if name in jobs.columns:
            out[name] = F.when(new, F.lit(value)).otherwise(F.col(name))
    made = {
        "normalized_title": normalize_key("_n_title"),
        "normalized_company": normalize_key("_n_company"),
        "normalized_location": normalize_key("_n_location"),
        "normalized_apply_url": normalize_key("_n_apply_url"),
        "dedupe_key": K.dedupe_key("_n_title", "_n_company", "_n_location", "_n_apply_url"),
        "enrich_keywords": F.array().cast("array<string>"),
    }
    for name, value in made.items():
        if name in jobs.columns:
            out[name] = F.when(new, value).otherwise(F.col(name))
    return joined.select("job_id", *[out.get(c, F.col(c)).alias(c) for c in jobs.columns if c != "job_id"])


def mark_known(batch: DataFrame, jobs: DataFrame) -> DataFrame:
    """The batch with ``_known``, true for ids of the store and null for new ones; run rows and events derive from it."""
    return batch.join(jobs.select("job_id", F.lit(True).alias("_known")), "job_id", "left")


def run_rows(runs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row per run with jobs received and jobs new to the store."""
    counts = marked.groupBy(F.col("scrape_run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("jobs_received"), F.count_if(F.col("_known").isNull()).alias("jobs_new")
    )
    joined = runs.join(counts, "run_id", "left")
    return joined.select(
        *runs.columns,
        F.coalesce("jobs_received", F.lit(0)).alias("jobs_received"),
        F.coalesce("jobs_new", F.lit(0)).alias("jobs_new"),
    )


def source_runtime(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Runtime columns after the runs of a batch: lease freed, last success or failure, failure count.

    A failure writes its time, a success clears it; failures count on from the
    stored value unless a success came in between.
    """
    ok = F.col("success")
    last = runs.groupBy("source_id").agg(
        F.max(F.when(ok, F.col(SEQ))).alias("_last_ok"),
        F.max_by("finished_at", F.when(ok, F.col(SEQ))).alias("_ok_at"),
        F.max_by(F.struct(ok.alias("ok"), "finished_at"), SEQ).alias("_latest"),
    )
    trailing = attach_group(runs, last.select("source_id", "_last_ok"), "source_id").filter(
        ~ok & (F.col("_last_ok").isNull() | (F.col(SEQ) > F.col("_last_ok")))
    )
    tail = trailing.groupBy("source_id").agg(F.count(F.lit(1)).alias("_tail"))
    joined = sources.join(last, "source_id", "left").join(tail, "source_id", "left")
    ran = F.col("_latest").isNotNull()
    before = F.when(F.col("_last_ok").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)
    return joined.withColumns(
        {
            "leased_until": F.when(ran, None).otherwise(F.col("leased_until")),
            "last_success_at": F.coalesce("_ok_at", "last_success_at"),
            "last_failure_at": F.when(ran & F.col("_latest.ok"), None)
            .when(ran, F.col("_latest.finished_at"))
            .otherwise(F.col("last_failure_at")),
            "consecutive_failures": F.when(ran, before + F.coalesce("_tail", F.lit(0))).otherwise(F.col("consecutive_failures")),
        }
    ).select(*sources.columns)


def not_replayed(results: DataFrame, commands: DataFrame) -> DataFrame:
    """Results whose lease was not completed before; a repeat is answered from the stored run."""
    done = commands.filter((F.col("status") == "completed") & (text("run_id") != "")).select("lease_id")
    return results.join(done, "lease_id", "left_anti")


# --- events -----------------------------------------------------------------------


def event_rows(df: DataFrame, event_type, payload: dict, created_at: Column, salt: str = "") -> DataFrame:
    """One event per row; the id is a hash of what happened, so a retry writes the same id."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    body = F.to_json(F.struct(*[c.alias(n) for n, c in payload.items()]))
    run = text("scrape_run_id") if "scrape_run_id" in df.columns else F.lit("")
    source = text("source_id") if "source_id" in df.columns else F.lit("")
    return df.select(
        F.sha2(F.concat_ws("|", "job_id", kind, run, body, F.lit(salt)), 256).alias("event_id"),
        "job_id",
        source.alias("source_id"),
        run.alias("run_id"),
        kind.alias("event_type"),
        created_at.alias("created_at"),
        body.alias("payload"),
    )


def ingest_events(marked: DataFrame, as_of: Column) -> DataFrame:
    """ingested for new ids, reseen for known ones."""
    new = F.col("_known").isNull()
    kind = F.when(new, "ingested").otherwise("reseen")
    return event_rows(marked, kind, {"is_new": new, "title": F.col("title")}, as_of)


def all_events(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- queues -------------------------------------------------------------------------


def enqueue(tasks: DataFrame, cap: int, day: Column) -> DataFrame:
    """Queue rows in order while the day's cap lasts, the rest blocked with the reason."""
    asked = tasks.withColumns({"counter": F.lit("task_enqueue"), "day": day})
    ok = F.col("granted")
    return daily_quota(asked, cap).select(
        *tasks.columns,
        F.when(ok, "queued").otherwise("blocked").alias("status"),
        F.when(ok, "").otherwise(CAP_ERROR).alias("error"),
    )


def notify_batch(jobs: DataFrame, notifications: DataFrame, chat: str, cap: int, as_of: Column, min_rate: int = 4) -> DataFrame:
    """Messages for good jobs nobody was told about, in row_seq order; over the day's cap they are blocked."""
    wanted = filters.notify_candidates(jobs, notifications, chat, min_rate)
    asked = wanted.withColumns({"counter": F.lit("notify_sends"), "day": F.to_date(as_of)})
    ok = F.col("granted")
    address = F.coalesce(blank_to_null(text("apply_url")), text("canonical_url"))
    message = notify_message("title", "company", "location", F.col("rate_num"), "rate_reason", address)
    return daily_quota(asked, cap).select(
        F.concat_ws("_", F.col("job_id"), F.lit(chat)).alias("notification_id"),
        "job_id",
        F.lit(chat).alias("target_chat_id"),
        F.when(ok, "queued").otherwise("blocked").alias("status"),
        F.when(ok, message).alias("message"),
        F.when(ok, "").otherwise(NOTIFY_ERROR).alias("error"),
    )


# --- actions and state --------------------------------------------------------------


def apply_actions(jobs: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs after user actions (the last one per job counts), the action log, the users seen."""
    log = joins.apply_actions(actions, jobs)
    last = log.filter("error = ''").groupBy("job_id").agg(
        F.max_by(F.struct("next_status", "next_stage"), SEQ).alias("_a"),
        F.bool_or(F.col("action") == "apply").alias("_applied"),
    )
    joined = jobs.join(last, "job_id", "left")
    acted = F.col("_a").isNotNull()
    out = joined.withColumns(
        {
            "status": F.when(acted, F.col("_a.next_status")).otherwise(F.col("status")),
            "pipeline_stage": F.when(F.col("_applied"), "applied").otherwise(F.col("pipeline_stage")),
        }
    ).select(*jobs.columns)
    users = actions.groupBy("telegram_user_id").agg(F.max("created_at").alias("last_seen_at"), F.lit(True).alias("is_active"))
    return out, log, users


def sync_job_states(table: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Write rate and status of each update into the first matching row; a blank status keeps the old one.

    When two updates meet one row the later one wins.
    """
    # a few numbers a match: what follows reads both sides once more, not the matching
    matched = written(joins.update_match(updates, table).filter(F.col("row_num").isNotNull()), "matched")
    fields = ["JobRateNum", "JobRateDesc", "JobRateShortDesc", "RatedModelName", "Status"]
    carried = matched.join(updates.select(SEQ, *fields), SEQ).groupBy(F.col("row_num").alias("_row")).agg(
        F.max_by(F.struct(*fields), SEQ).alias("_u")
    )
    joined = table.join(carried, F.col(SEQ) == F.col("_row"), "left")
    hit = F.col("_u").isNotNull()
    short = F.coalesce(blank_to_null(text("_u.JobRateShortDesc")), text("_u.JobRateDesc"))
    made = {
        "JobRateNum": F.col("_u.JobRateNum"),
        "JobRateDesc": text("_u.JobRateDesc"),
        "JobRateShortDesc": short,
        "RatedModelName": text("_u.RatedModelName"),
        "Status": F.coalesce(blank_to_null(text("_u.Status")), F.col("Status")),
        "JobRateDttm": as_of,
    }
    changed = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in made.items() if c in table.columns}
    return joined.withColumns(changed).select(*table.columns)
