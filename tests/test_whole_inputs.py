"""Long runs, long texts and many rows come through whole: no cap, no cut, no deep recursion."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rolemill.functions import posting_text as P
from rolemill.functions.responses import parse_final
from rolemill.operators import order
from rolemill.plans import extract as E
from rolemill.plans import leases, load
from rolemill.streaming import jobs

LONG = 'Builds "data" jobs\\and tables.\n' * 3200  # above 100,000 characters


def test_a_run_of_150_000_jobs_stays_apart_from_the_next(spark):
    many = spark.range(150_000).select(F.lit(1).cast("long").alias("run_seq"), F.col("id").cast("int").alias("job_pos"), F.col("id").cast("string").alias("external_job_id"))
    one = spark.createDataFrame([(2, 0, "100000")], "run_seq long, job_pos int, external_job_id string")
    run = F.col("run_seq").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)")
    rows = many.unionByName(one).withColumn("row_seq", (run + F.col("job_pos")).cast("decimal(31,0)")).withColumn("job_id", F.col("external_job_id"))
    last = jobs.latest_per_job(rows)
    assert last.count() == 150_000
    assert last.filter("job_id = '100000'").first().run_seq == 2


def test_long_descriptions_are_not_cut(spark):
    posting = json.dumps({"@type": "JobPosting", "title": "Dev", "description": LONG})
    html = f'<script type="application/ld+json">{posting}</script>'
    df = spark.createDataFrame([(1, html)], "row_seq long, html string")
    found = E.jsonld(df).first().JobDescription
    assert len(found) > 90_000 and not found.endswith("...")


def test_rehydration_reads_long_texts(spark):
    items = ["x", "1:" + json.dumps({"@type": "JobPosting", "title": 'Dev "x"', "description": LONG, "hiringOrganization": {"name": "Acme"}})]
    html = "<script>window.__como_rehydration__ = " + json.dumps(items).replace("</", "<\\/") + ";</script>"
    row = E.rehydration(spark.createDataFrame([(1, html)], "row_seq long, html string")).first()
    assert (row.JobTitle, row.JobCompany, row.JobDescription.strip()) == ('Dev "x"', "Acme", LONG.strip())


def test_long_marks_do_not_recurse(spark):
    answer = "LRateLeaseId: a1\nJobRateNum: 4\n" + "-" * 100_000 + " fits\nLRateResponseComplete: a1"
    df = spark.createDataFrame([(answer, "START" + " -" * 50_000 + " body")], "a string, b string")
    row = df.select(parse_final("a", F.lit("a1")).alias("p"), P.trim_between("b", ("START",), ("END",)).alias("t")).first()
    assert row.p.rate_num == 4 and row.t == "body"


def test_limits_are_taken_as_given(spark):
    df = spark.range(200).select(F.lit(1).alias("priority"), F.col("id").cast("string").alias("source_id"), F.current_timestamp().alias("last_seen_at"), F.col("id").alias("job_id"))
    assert order.plan_order(df, 20).count() == 20
    assert order.top_good_jobs(df, 120).count() == 120


def test_quota_above_a_thousand_on_one_hot_counter(spark):
    asked = spark.range(0, 300_000, 1, 12).select(F.col("id").alias("row_seq"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("counter"), F.lit("d").alias("day"))
    granted = leases.daily_quota(asked, 2500).filter("granted").groupBy("counter").agg(F.count("*").alias("n"), F.max("row_seq").alias("last")).collect()
    assert {r.counter: (r.n, r["last"]) for r in granted} == {"hot": (2500, 2525), "rare": (2500, 249_900)}


def test_a_failed_load_is_logged_as_failed(spark, tmp_path):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stage = spark.createDataFrame([(1, "a", "", "Staged"), (2, "b", "", "Broken"), (3, "c", "", "Staged"), (4, "c", "", "Staged")], "row_seq long, JobId string, JobUrl string, Status string")
    known = spark.createDataFrame([("a", "")], "JobId string, JobUrl string")
    log = lambda rows, folder: load.logged_load(load.validate_stage(rows), known, folder=folder, as_of=at, started=at, ended=at).first()
    bad, good = str(tmp_path / "bad"), str(tmp_path / "good")
    row = log(stage, bad)
    assert (row.SuccessFlag, row.FailAtRowNum, row.NewCount, row.DoubleCount, row.LoadedCount, row.StageRowsTotal) == (False, "2", 0, 0, 0, 4)
    assert spark.read.parquet(bad).count() == 0
    row = log(stage.filter("row_seq <> 2"), good)
    assert (row.SuccessFlag, row.FailAtRowNum, row.NewCount, row.DoubleCount, row.LoadedCount, row.StageRowsTotal) == (True, "", 1, 2, 1, 3)
    assert [(r.row_seq, r.Status) for r in spark.read.parquet(good).collect()] == [(3, "Loaded")]
