"""Counts per status, day, source, load and label, and the funnel built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import first_filled, text, trim
from rolemill.functions.values import number_or_zero
from rolemill.operators.filters import is_older
from rolemill.operators.winners import SEQ, attach_group, positions


def status_counts(df: DataFrame) -> DataFrame:
    status = trim("Status")
    return df.filter(status != "").groupBy(status.alias("Status")).agg(F.count(F.lit(1)).alias("n"))


def work_flags(df: DataFrame, as_of, days: int) -> DataFrame:
    """One row: which stages have work to do."""
    status = trim("Status")
    unrated = (status == "Loaded") & (trim("JobRateNum") == "") & (trim("RatedModelName") == "")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        any_of(status == "Staged").alias("has_staged"),
        any_of(status == "Approved").alias("has_approved"),
        any_of(unrated).alias("has_loaded_unrated"),
        any_of(is_older("LoadDttm", as_of, days)).alias("has_old_rows"),
    )


def _day(name) -> Column:
    return F.to_date(F.col(name))


def daily_totals(jobs: DataFrame, notifications: DataFrame, actions: DataFrame) -> DataFrame:
    """Six totals per UTC day.

    The three tables are turned into (day, counter) increments, so one shuffle of
    partial sums serves all counters and no join on the day is needed.
    """
    seen = F.col("last_seen_at")
    jobs_part = jobs.select(
        F.inline(
            F.array(
                _entry(F.col("first_seen_at"), "new_jobs", F.lit(True)),
                _entry(seen, "rated_jobs", F.col("rate_num") > 0),
                _entry(seen, "apply_jobs", F.col("status") == "2Apply"),
                _entry(seen, "delete_jobs", F.col("status") == "2Delete"),
            )
        )
    )
    sent = notifications.select(F.inline(F.array(_entry(F.col("sent_at"), "notifications_sent", F.col("status") == "sent"))))
    acted = actions.select(F.inline(F.array(_entry(F.col("created_at"), "apply_actions", F.lit(True)))))
    counters = ["new_jobs", "rated_jobs", "apply_jobs", "delete_jobs", "notifications_sent", "apply_actions"]
    entries = jobs_part.union(sent).union(acted).filter(F.col("day").isNotNull())
    return entries.groupBy("day").agg(
        *[F.count_if((F.col("counter") == c) & F.col("hit")).alias(c) for c in counters]
    ).filter(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counters]))


def _entry(moment: Column, counter: str, hit: Column) -> Column:
    return F.struct(F.to_date(moment).alias("day"), F.lit(counter).alias("counter"), F.coalesce(hit, F.lit(False)).alias("hit"))


def daily_by_source(jobs: DataFrame) -> DataFrame:
    """New, apply and delete counts per day and source; a blank source is 'unknown'."""
    seen = F.col("last_seen_at")
    entries = jobs.select(
        first_filled("source_id", F.lit("unknown")).alias("source_id"),
        F.inline(
            F.array(
                _entry(F.col("first_seen_at"), "new_jobs", F.lit(True)),
                _entry(seen, "apply_jobs", F.col("status") == "2Apply"),
                _entry(seen, "delete_jobs", F.col("status") == "2Delete"),
            )
        ),
    ).filter(F.col("hit") & F.col("day").isNotNull())
    counters = ["new_jobs", "apply_jobs", "delete_jobs"]
    return entries.groupBy("day", "source_id").agg(
        *[F.count_if(F.col("counter") == c).alias(c) for c in counters]
    )


def deleted_reasons(*tables: DataFrame, top_rate: int = 1) -> DataFrame:
    """Deleted rows per load day and stage; a row may count in more than one stage.

    ``top_rate`` is the highest final rate that counts as deleted by the final stage.
    """
    rates = "|".join(str(r) for r in range(top_rate + 1))
    rows = reduce(DataFrame.union, [t.select("Status", "LoadDttm", "JobRateDesc") for t in tables])
    desc = F.lower(trim("JobRateDesc"))
    final = desc.rlike(rf"jobratenum\s*[:=|]\s*(?:{rates})(?!\w)")
    medium = desc.rlike("medium brate|medium crate|location dbl")
    return (
        rows.filter((trim("Status") == "2Delete") & F.col("LoadDttm").isNotNull())
        .groupBy(_day("LoadDttm").alias("day"))
        .agg(
            F.count_if(F.contains(desc, F.lit("title matched deny regex"))).alias("s_deleted"),
            F.count_if(medium).alias("m_deleted"),
            F.count_if(final).alias("l_deleted"),
        )
    )


def funnel_derived(totals: DataFrame, deleted: DataFrame) -> DataFrame:
    """What is left behind each stage per day, never below zero."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    after_s = F.greatest(F.lit(0), F.col("total") - none("s_deleted"))
    after_m = F.greatest(F.lit(0), after_s - none("m_deleted"))
    after_l = F.greatest(F.lit(0), after_m - none("l_deleted"))
    return totals.join(deleted, "day", "left").select(
        "day", "total", after_s.alias("after_s"), after_m.alias("after_m"), after_l.alias("after_l")
    )


def funnel_totals(counts: DataFrame) -> DataFrame:
    """Sum per day over loosely written counts, null unless positive."""
    total = F.sum(number_or_zero("count_text"))
    return counts.groupBy("day").agg(F.when(total > 0, total).alias("total"))


def funnel_accumulate(updates: DataFrame) -> DataFrame:
    """State per source after its updates: count since the last clear, last status given.

    ``updates``: row_seq, source_id, status, jobs_count (text), clear. The last
    clear is an aggregate per source, so no source is walked in one task.
    """
    cleared = updates.groupBy("source_id").agg(F.max(F.when(F.col("clear"), F.col(SEQ))).alias("_last_clear"))
    counted = updates.filter(text("jobs_count") != "")
    value = number_or_zero("jobs_count")
    joined = attach_group(counted, cleared, "source_id")
    live = joined.filter(~F.col("clear") & (F.col("_last_clear").isNull() | (F.col(SEQ) > F.col("_last_clear"))))
    sums = live.groupBy("source_id").agg(F.sum(value).alias("jobs"))
    states = updates.groupBy("source_id").agg(F.max_by("status", F.when(text("status") != "", F.col(SEQ))).alias("status"))
    return states.join(sums, "source_id", "left").select("source_id", "status", F.coalesce("jobs", F.lit(0.0)).alias("jobs"))


def mart_stats(df: DataFrame) -> DataFrame:
    """Rows per rate 5, 4 and 3, and in total."""
    return (
        df.filter((trim("Status") == "2Apply") & F.col("rate").isin(5, 4, 3))
        .rollup("rate")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce(F.col("rate").cast("int").cast("string"), F.lit("total")).alias("rate"), "n")
    )


def group_addresses(entries: DataFrame) -> DataFrame:
    """Addresses per group (id, else name, else the address), with their place in the group.

    A row per address instead of one array per group: a group has no size limit.
    """
    group = first_filled("id", "name", "url")
    return positions(entries.select(SEQ, group.alias("group_key"), "url"), ["group_key"])


def run_summary(df: DataFrame) -> DataFrame:
    """Received and new jobs per run; a run failed when any of its rows says so."""
    return df.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs_received"),
        F.count_if("is_new").alias("jobs_new"),
        F.bool_and("success").alias("success"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("finished_at"),
    )


# Both spellings of the applications label.
APPLICATION_LABELS = ("ОТКЛИКИ", "ОТКЛИКОВ")


def canonical_label(value) -> Column:
    """Label in one spelling: dashes, blanks, letter yo, case; applications under one name."""
    from rolemill.functions.text import collapse

    flat = F.regexp_replace(collapse(value), "[–—]", "-")
    flat = F.upper(F.replace(F.replace(flat, F.lit("ё"), F.lit("е")), F.lit("Ё"), F.lit("Е")))
    return F.when(flat.isin(*APPLICATION_LABELS), "Откликов").otherwise(flat)


def label_counter(events: DataFrame) -> DataFrame:
    return events.groupBy(canonical_label("label").alias("label")).agg(F.sum(number_or_zero("delta")).alias("total"))


def oldest_posting(df: DataFrame, date: str, as_of, batch: str) -> DataFrame:
    """Per batch: is any posting older than a month, and the oldest date."""
    old = F.col(date) < F.add_months(F.to_date(as_of), -1)
    return df.groupBy(batch).agg(F.coalesce(F.bool_or(old), F.lit(False)).alias("has_old"), F.min(date).alias("oldest"))


def pages_until_old(pages: DataFrame, feed: str, page: str, has_old: str) -> DataFrame:
    """Pages of each feed up to and including the first that holds an old posting."""
    first_old = pages.groupBy(feed).agg(F.min(F.when(F.col(has_old), F.col(page))).alias("_stop"))
    joined = attach_group(pages, first_old, feed)
    return joined.filter(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")


def pivot_days(counts: DataFrame, label: str, days: list[str], value: str) -> DataFrame:
    """One column per day, newest first; ``days`` names the days to show."""
    wide = counts.groupBy(label).pivot("day", days).agg(F.sum(value))
    return wide.select(label, *[F.col(d) for d in sorted(days, reverse=True)])


def load_counts(stage: DataFrame, loaded: DataFrame) -> DataFrame:
    """One audit row of a load: rows staged, new, double, loaded."""
    total = stage.agg(F.count(F.lit(1)).alias("stage_total"), F.count_if(trim("Status") == "Approved").alias("approved"))
    kept = loaded.agg(F.count(F.lit(1)).alias("loaded"))
    rows = total.withColumn("loaded", kept.scalar())
    return rows.select(
        F.col("stage_total"),
        F.col("loaded").alias("new_count"),
        (F.col("approved") - F.col("loaded")).alias("double_count"),
        F.col("loaded").alias("loaded_count"),
    )


def duplicate_rate(jobs: DataFrame, history: DataFrame, failed: Column, shell: Column) -> DataFrame:
    """Counts of one scrape: staged, repeated in the session, known to history, failed, shell pages.

    ``jobs`` has row_seq, session_key and job_key; ``history`` distinct job keys.
    Groups are counted, rows are not compared.
    """
    flagged = jobs.select(SEQ, "session_key", "job_key", failed.alias("failed"), shell.alias("shell"))
    usable = flagged.filter(~F.col("failed") & ~F.col("shell"))
    groups = usable.filter(F.col("session_key").isNotNull()).groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("job_key", SEQ).alias("job_key")
    )
    known = groups.join(history.withColumn("_known", F.lit(True)), "job_key", "left")
    lone = usable.filter(F.col("session_key").isNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = known.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("session_duplicates"),
        F.count_if("_known").alias("history_duplicates"),
        F.count_if(F.col("_known").isNull()).alias("_new"),
    ).withColumns(
        {
            "_lone": lone,
            "failed": flagged.agg(F.count_if("failed").alias("n")).scalar(),
            "shell_dropped": flagged.agg(F.count_if(F.col("shell") & ~F.col("failed")).alias("n")).scalar(),
        }
    )
    staged = (F.col("_new") + F.col("_lone")).alias("staged")
    return counts.select(staged, "session_duplicates", "history_duplicates", "failed", "shell_dropped")


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """Failures per source since its last success, by run order; two aggregates, no walk."""
    last = runs.groupBy("source_id").agg(F.max(F.when(F.col("success"), F.col(SEQ))).alias("_last"))
    joined = attach_group(runs, last, "source_id")
    after = F.col("_last").isNull() | (F.col(SEQ) > F.col("_last"))
    return joined.groupBy("source_id").agg(F.count_if(~F.col("success") & after).alias("consecutive_failures"))
