"""Matching rows by composite and alternative keys.

Alternative keys are exploded into (kind, key) pairs and joined by equality, so
no plan needs an OR condition. The side that is looked up is reduced to one row
per key first; what remains is a lookup with at most one partner per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions import keys as K
from rolemill.functions.text import blank_to_null, first_filled, normalize_key, text, trim
from rolemill.operators.winners import SEQ, attach_group, first_rows, mark, unique_rows


def with_job_key(df: DataFrame, out: str = "job_key") -> DataFrame:
    """Add the composite key; a blank key becomes null, which matches nothing."""
    return df.withColumn(out, blank_to_null(K.job_key("JobId", "JobUrl")))


def history_keys(*tables: DataFrame) -> DataFrame:
    """Distinct keys of several tables."""
    parts = [with_job_key(t).select("job_key") for t in tables]
    return reduce(DataFrame.union, parts).filter(F.col("job_key").isNotNull()).distinct()


def three_keys(df: DataFrame) -> DataFrame:
    """(row_seq, key) for the job, address and id key of each row, blanks left out."""
    kinds = F.array_distinct(K.all_keys("JobId", "JobUrl"))
    return df.select(SEQ, F.explode(kinds).alias("key")).filter(F.col("key") != "")


def fresh_rows(stage: DataFrame, history: DataFrame) -> DataFrame:
    """Row numbers that are first in the batch and unknown to history.

    The batch is reduced to one row per key before it meets the history, so both
    sides of the anti-join hold a key once.
    """
    return first_rows(stage, "job_key").join(history, "job_key", "left_anti").select(SEQ)


def increment_rows(stage: DataFrame, history: DataFrame) -> DataFrame:
    """Approved rows to load: new by key, plus all rows without a key."""
    keyed = with_job_key(stage)
    marked = mark(keyed, fresh_rows(keyed, history), "_new")
    return marked.filter(F.col("_new") | F.col("job_key").isNull()).drop("_new")


def keep_mask(jobs: DataFrame, *tables: DataFrame) -> DataFrame:
    """Per row: false if any of its three keys is among the history's keys of any kind."""
    exploded = jobs.select(SEQ, F.explode_outer(F.array_distinct(K.all_keys("JobId", "JobUrl"))).alias("key"))
    exploded = exploded.withColumn("key", blank_to_null("key"))
    known = reduce(DataFrame.union, [three_keys(t).select("key") for t in tables]).distinct()
    met = attach_group(exploded, known.withColumn("hit", F.lit(True)), "key")
    return met.groupBy(SEQ).agg((~F.coalesce(F.bool_or("hit"), F.lit(False))).alias("keep"))


def _either(*values):
    return F.coalesce(*[blank_to_null(trim(v)) for v in values], F.lit(""))


def update_keys(df: DataFrame) -> DataFrame:
    """(row_seq, key) pairs under which a state update and a table row can meet; a row without keys has a null."""
    main, side = _either("JobUrl", "JobApplyUrl"), _either("JobApplyUrl", "JobUrl")
    sig = K.signature("JobCompany", "JobTitle", "JobLocation")
    kinds = F.array(
        F.concat(F.lit("job:"), blank_to_null(K.job_key("JobId", main))),
        F.concat(F.lit("url:"), blank_to_null(K.url_key(side))),
        F.concat(F.lit("id:"), blank_to_null(K.id_key("JobId", main))),
        F.concat(F.lit("sig:"), blank_to_null(sig)),
    )
    return df.select(SEQ, F.explode_outer(F.array_compact(kinds)).alias("key"))


def first_match(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Per wanted row number the lowest row number in ``rows`` that shares any key, null if none does."""
    firsts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(SEQ).alias("row_num"))
    return attach_group(wanted, firsts, "key").groupBy(SEQ).agg(F.min("row_num").alias("row_num"))


def update_match(updates: DataFrame, table: DataFrame) -> DataFrame:
    """Per update the first table row that matches by any of the four keys, null if none."""
    return first_match(update_keys(updates), update_keys(table))


def _application_keys(df: DataFrame, address) -> DataFrame:
    url = blank_to_null(K.normalize_url(address))
    sig = F.concat_ws("|", *[normalize_key(c) for c in ("JobCompany", "JobTitle", "JobLocation")])
    ident = blank_to_null(trim("JobId"))
    return df.select(SEQ, ident.alias("_id"), url.alias("_url"), sig.alias("_sig"))


def application_match(items: DataFrame, table: DataFrame) -> DataFrame:
    """Per selected item its table row, null if none.

    With an id: the first row that agrees on id and address or id and signature,
    else the first with the id. Without: the first with the address, else the
    first with the signature.
    """
    want = _application_keys(items, first_filled("JobUrl", "JobApplyUrl"))
    have = _application_keys(table, first_filled("JobApplyUrl", "JobUrl"))

    def tag(name, *parts):
        return F.concat(F.lit(name + ":"), F.concat_ws("\x01", *parts))

    filled = lambda *c: reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c])
    strong = [F.when(filled("_id", "_url"), tag("iu", "_id", "_url")), F.when(filled("_id"), tag("is", "_id", "_sig"))]
    with_id = [*strong, F.when(filled("_id"), tag("i", "_id"))]
    table_keys = F.array_compact(F.array(*with_id, F.when(filled("_url"), tag("u", "_url")), tag("s", "_sig")))
    rows = have.select(SEQ, F.explode(table_keys).alias("key"))
    firsts = rows.groupBy("key").agg(F.min(SEQ).alias("row_num"))
    no_id = F.col("_id").isNull()
    item_keys = F.array_compact(
        F.array(*with_id, F.when(no_id & filled("_url"), tag("u", "_url")), F.when(no_id, tag("s", "_sig")))
    )
    asked = want.select(SEQ, F.explode_outer(item_keys).alias("key"))
    found = attach_group(asked, firsts, "key")
    kind = F.substring_index("key", ":", 1)
    rank = F.when(kind.isin("iu", "is", "u"), 0).otherwise(1)
    hit = F.when(F.col("row_num").isNotNull(), F.struct(rank.alias("rank"), F.col("row_num")))
    return found.groupBy(SEQ).agg(F.min(hit).alias("best")).select(SEQ, F.col("best.row_num").alias("row_num"))


def fail_closed(updates: DataFrame, table: DataFrame) -> DataFrame:
    """Per lease the number of rows in final rating with its key and snapshot, and the row if it is one.

    ``updates``: lease_id, stable_key, snapshot_hash. ``table``: row_seq, Status and
    the two identity columns.
    """
    identity = ["stable_key", "snapshot_hash"]
    active = table.filter(trim("Status") == "2LRate").groupBy(*identity).agg(
        F.count(F.lit(1)).alias("matches"), F.min(SEQ).alias("row_num")
    )
    joined = updates.join(active, identity, "left")
    matches = F.coalesce("matches", F.lit(0))
    return joined.select(
        "lease_id",
        matches.alias("matches"),
        F.when(matches == 1, F.col("row_num")).alias("row_num"),
        F.when(matches == 1, "saved").otherwise("conflict").alias("state"),
        F.when(matches == 1, "")
        .otherwise(F.concat(F.lit("Expected exactly 1 matching active row, got "), matches.cast("string")))
        .alias("error"),
    )


def resolve_source_id(df: DataFrame, sources: DataFrame, name: str = "ScrapePageName") -> DataFrame:
    """Source id of a page name: exact id, else the first source of that name, else the name.

    Names repeat without bound in the rows, not in the configuration; both
    lookups are reduced to one row per key and left to the optimizer.
    """
    wanted = df.withColumn("_name", trim(name))
    ids = sources.select(trim("source_id").alias("_name"), F.col("source_id").alias("_by_id")).dropDuplicates(["_name"])
    names = sources.groupBy(trim("name").alias("_name")).agg(F.min_by("source_id", SEQ).alias("_by_name"))
    groups = ids.join(names, "_name", "full").select("_name", F.coalesce("_by_id", "_by_name").alias("_found"))
    out = attach_group(wanted, groups, "_name")
    return out.select(*df.columns, F.coalesce("_found", F.col(name)).alias("resolved_id"))


def source_gate(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each row's source may be used: a known id decides, else a known name, else yes."""
    last = lambda key: sources.filter(trim(key) != "").groupBy(trim(key).alias(f"_{key}")).agg(
        F.max_by("enabled", SEQ).alias(f"_on_{key}")
    )
    asked = df.groupBy("source_id", "name").agg(F.count(F.lit(1)).alias("n"))
    joined = asked.join(last("source_id"), trim("source_id") == F.col("_source_id"), "left").join(
        last("name"), trim("name") == F.col("_name"), "left"
    )
    return joined.select(
        "source_id", "name", "n", F.coalesce("_on_source_id", "_on_name", F.lit(True)).alias("allowed")
    )


def below_daily_cap(sources: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """Sources that have not reached their successful runs of the day."""
    day = F.to_date(F.coalesce("finished_at", "started_at"))
    done = runs.filter(F.col("success") & (day == F.to_date(as_of))).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("_done")
    )
    cap = F.coalesce(F.col("daily_success_cap"), F.lit(0))
    joined = sources.join(done, "source_id", "left")
    return joined.filter((cap < 1) | (F.coalesce("_done", F.lit(0)) < cap)).drop("_done")


def _one_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.join(first_rows(df, key).select(SEQ), SEQ, "left_semi")


def merge_fill_blank(existing: DataFrame, incoming: DataFrame, key: str, fields) -> DataFrame:
    """Existing rows win and take only their blanks from the incoming side; new keys are added.

    Both sides hold a key once per table: repeats of a key inside one side fill
    its first row's blanks in row order, as if they came one after the other.
    """
    old, new = fold_blanks(existing, key, fields), fold_blanks(incoming, key, fields)
    renamed = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = old.join(renamed, F.col(key) == F.col("_key"), "full_outer")
    merged = [F.coalesce(blank_to_null(text(c)), text(f"_n_{c}")).alias(c) for c in fields]
    return joined.select(F.coalesce(key, "_key").alias(key), *merged)


def fold_blanks(df: DataFrame, key: str, fields) -> DataFrame:
    """One row per key: each field's first non-blank value in row order."""
    keyed = df.filter(F.col(key).isNotNull())
    firsts = [
        F.min_by(c, F.when(text(c) != "", F.col(SEQ))).alias(c) for c in fields
    ]
    folded = keyed.groupBy(key).agg(*firsts)
    return folded.select(key, *[text(c).alias(c) for c in fields])


def merge_overwrite(target: DataFrame, incoming: DataFrame, key: str, fields) -> DataFrame:
    """Incoming values overwrite unless they are blank; ``incoming`` holds a key once."""
    renamed = incoming.filter(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = attach_group(target, renamed, key)
    filled = {c: F.when(trim(f"_n_{c}") != "", F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(filled).select(*target.columns)


def _active(leases: DataFrame, table_name: str) -> DataFrame:
    """Identities in active leases of a table."""
    return leases.filter(
        (F.col("state") == "leased")
        & (F.col("table_name") == table_name)
        & (F.col("stable_key") != "")
        & (F.col("snapshot_hash") != "")
    ).select("stable_key", "snapshot_hash")


def unleased(rows: DataFrame, leases: DataFrame, table_name: str) -> DataFrame:
    """Rows whose identity is not in an active lease of the table."""
    return rows.join(_active(leases, table_name), ["stable_key", "snapshot_hash"], "left_anti")


def mark_leased(rows: DataFrame, leases: DataFrame, table_name: str) -> DataFrame:
    """Rows with ``leased``: whether their identity is in an active lease of the table."""
    active = _active(leases, table_name).distinct().withColumn("leased", F.lit(True))
    return rows.join(active, ["stable_key", "snapshot_hash"], "left").withColumn("leased", F.coalesce("leased", F.lit(False)))


def apply_actions(actions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Actions with the status they lead to; an unknown job is an error row."""
    joined = attach_group(actions, jobs.select("job_id", "status", "pipeline_stage"), "job_id")
    known = F.col("status").isNotNull()
    next_status = (
        F.when(~known, None)
        .when(F.col("action") == "apply", "Applied")
        .when(F.col("action") == "delete", "2Delete")
        .when(F.col("action") == "later", "2Apply")
        .otherwise(F.col("status"))
    )
    stage = F.when(F.col("action") == "apply", "applied").otherwise(F.coalesce("pipeline_stage", F.lit("rated")))
    return joined.select(
        *actions.columns,
        next_status.alias("next_status"),
        F.when(known, stage).alias("next_stage"),
        F.when(known, "").otherwise(F.concat(F.lit("Job not found: "), F.col("job_id").cast("string"))).alias("error"),
    )


def unique_identity(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; repeated ones are all skipped."""
    return df.join(unique_rows(df, key), SEQ, "left_semi")
