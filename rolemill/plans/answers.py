"""Jobs around model answers: prompts out, answers in, first success per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.keys import stable_key
from rolemill.functions.responses import parse_extract, parse_final
from rolemill.functions.text import fill_template, labelled_lines, text, trim
from rolemill.operators.joins import fail_closed
from rolemill.operators.winners import SEQ

# The lines of the final rating contract.
FINAL_FIELDS = ("JobTitle", "JobCompany", "JobLocation", "JobSeniority", "JobModality", "JobEasyApplyFlg", "JobSalary", "JobTags")
# Labels of a posting inside a prompt.
PROMPT_LABELS = (
    ("Title", "JobTitle"),
    ("Company", "JobCompany"),
    ("Location", "JobLocation"),
    ("Modality", "JobModality"),
    ("Salary", "JobSalary"),
    ("Tags", "JobTags"),
    ("Description", "JobDescription"),
    ("URL", "JobUrl"),
)


def prompts(df: DataFrame, template: str, cv: str, goal: str) -> DataFrame:
    """One prompt per row in 2MBrate."""
    labels = [(label, name) for label, name in PROMPT_LABELS if name in df.columns]
    body = {"CV": F.lit(cv), "Goal": F.lit(goal), "JobText": labelled_lines(labels)}
    return df.filter(trim("Status") == "2MBrate").select(SEQ, fill_template(F.lit(template), body).alias("prompt"))


def final_prompt(columns, lease_id: Column) -> Column:
    """The contract lines and the posting for a final rating."""
    known = lambda name: trim(name) if name in columns else F.lit("")
    lines = [
        F.lit("TechnicalContract:"),
        F.concat(F.lit("LRateLeaseId: "), lease_id),
        F.concat(F.lit("Return first line exactly: LRateLeaseId="), lease_id),
        F.lit("Return rating line exactly: JobRateNum=<0..5>"),
        F.concat(F.lit("Return final line exactly: LRateResponseComplete="), lease_id),
        F.lit(""),
        *[F.concat(F.lit(f"{name}: "), known(name)) for name in FINAL_FIELDS],
        F.lit("JobDescription:"),
        known("JobDescription"),
    ]
    return F.concat_ws("\n", *lines)


def first_success(attempts: DataFrame) -> DataFrame:
    """Per row the first successful attempt by (attempt, model order), else FAILED_ALL."""
    best = F.min(F.when(F.col("ok"), F.struct("attempt", "model_pos", "response"))).alias("best")
    grouped = attempts.groupBy("row_num").agg(best, F.count(F.lit(1)).alias("tries"))
    return grouped.select(
        "row_num",
        F.when(F.col("best").isNotNull(), "ok").otherwise("FAILED_ALL").alias("outcome"),
        F.col("best.response").alias("response"),
        F.col("best.attempt").alias("attempt"),
        "tries",
    )


def medium_b_rate(df: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """Rows in 2MBrate take the fields of their answer; failures keep the status and say why.

    ``answers``: row_seq, outcome ('ok' or 'FAILED_ALL'), response, model.
    """
    parsed = answers.select(SEQ, "outcome", "model", parse_extract("response").alias("a"))
    joined = df.join(parsed, SEQ, "left")
    mine = (trim("Status") == "2MBrate") & F.col("outcome").isNotNull()
    done = mine & (F.col("outcome") == "ok") & F.col("a.success")
    failed = mine & ~done
    why = F.when(F.col("outcome") != "ok", "FAILED_ALL").otherwise("FAILED_PARSE")
    return joined.withColumns(
        {
            "JobTop3Stack": F.when(done, F.array_join("a.top3_stack", " | ")).otherwise(F.col("JobTop3Stack")),
            "JobTop3Want": F.when(done, F.array_join("a.top3_want", " | ")).otherwise(F.col("JobTop3Want")),
            "JobWorkMode": F.when(done, F.col("a.work_mode")).otherwise(F.col("JobWorkMode")),
            "JobRateDttm": F.when(done, as_of).otherwise(F.col("JobRateDttm")),
            "RatedModelName": F.when(done, F.col("model")).when(failed, why).otherwise(F.col("RatedModelName")),
            "JobRateDesc": F.when(failed, text("a.error")).otherwise(F.col("JobRateDesc")),
            "Status": F.when(done, "2MCRate").otherwise(F.col("Status")),
        }
    ).select(*df.columns)


def final_status(rate: Column) -> Column:
    return F.when(rate > 2, "2Apply").otherwise("2Delete")


def l_rate_apply(
    df: DataFrame, leases: DataFrame, answers: DataFrame, as_of: Column, reset_load_time: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Apply final ratings to exactly one matching row each; returns (rows, lease states).

    ``leases``: lease_id, stable_key, snapshot_hash. ``answers``: lease_id, response. With
    ``reset_load_time`` a rated row counts as loaded at ``as_of``.
    """
    parsed = answers.withColumn("p", parse_final("response", "lease_id")).select(
        "lease_id", F.col("p.rate_num"), F.col("p.rate_desc"), F.col("p.short_desc"), F.col("p.top3_want"), F.col("p.error").alias("parse_error")
    )
    asked = leases.join(parsed.select("lease_id", "parse_error"), "lease_id").filter("parse_error = ''").drop("parse_error")
    outcome = fail_closed(asked, df)
    states = parsed.select("lease_id", "parse_error").join(outcome, "lease_id", "left").select(
        "lease_id",
        F.when(F.col("parse_error") != "", "failed").otherwise(F.col("state")).alias("state"),
        "row_num",
        F.when(F.col("parse_error") != "", F.col("parse_error")).otherwise(F.col("error")).alias("error"),
    )
    saved = outcome.filter("state = 'saved'").join(parsed, "lease_id").select(
        F.col("row_num").alias(SEQ), "rate_num", "rate_desc", "short_desc", "top3_want"
    )
    one = saved.groupBy(SEQ).agg(F.max(F.struct("rate_num", "rate_desc", "short_desc", "top3_want")).alias("s"))
    joined = df.join(one, SEQ, "left")
    hit = F.col("s").isNotNull()
    rows = joined.withColumns(
        {
            "JobRateNum": F.when(hit, F.col("s.rate_num").cast("double")).otherwise(F.col("JobRateNum")),
            "JobRateDesc": F.when(hit, F.col("s.rate_desc")).otherwise(F.col("JobRateDesc")),
            "JobRateShortDesc": F.when(hit, F.col("s.short_desc")).otherwise(F.col("JobRateShortDesc")),
            "JobTop3Want": F.when(hit & (F.col("s.top3_want") != ""), F.col("s.top3_want")).otherwise(F.col("JobTop3Want")),
            "Status": F.when(hit, final_status(F.col("s.rate_num"))).otherwise(F.col("Status")),
            "LoadDttm": F.when(hit & F.lit(reset_load_time), as_of).otherwise(F.col("LoadDttm")),
        }
    ).select(*df.columns)
    return rows, states


def identity(df: DataFrame, hash_column: Column) -> DataFrame:
    return df.withColumns({"stable_key": stable_key("JobId", "JobUrl"), "snapshot_hash": hash_column})
