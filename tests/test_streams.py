"""Keyed state over many micro-batches with restarts, and the partitioned job store."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rolemill.plans import cloud, store
from rolemill.streaming import jobs as S

DAY = "2024-01-01"


class Arrivals:
    """A folder that grows, and a keyed query that starts again after each arrival."""

    def __init__(self, spark, root, schema, job, mode="update"):
        self.spark, self.root, self.schema, self.job, self.mode = spark, str(root), schema, job, mode

    def add(self, rows):
        # times are given as text, as they stand in the files
        text = self.spark.createDataFrame(rows, self.schema.replace("timestamp", "string"))
        text.coalesce(1).write.mode("append").json(f"{self.root}/in")
        stream = S.read_folder(self.spark, f"{self.root}/in", self.schema, "json")
        changes = self.job(stream)
        S.write_changes(changes, f"{self.root}/out", f"{self.root}/check", self.mode)
        return S.read_changes(self.spark, f"{self.root}/out", changes.schema)

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.root}/check")


def at(hours, day=DAY):
    return f"{day}T{int(hours):02d}:{round(hours % 1 * 60):02d}:00Z"


def test_job_states_over_five_arrivals(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"j{rng.randrange(5)}", v, f"s{v % 7}") for v in range(200)]
    rng.shuffle(rows)
    work = Arrivals(spark, tmp_path, "job_id string, version long, status string", S.job_states)
    for part in range(5):
        out = S.latest(work.add(rows[part::5]), "job_id", "version")
    want = {}
    for job, version, status in rows:
        want[job] = max(want.get(job, (-1, "")), (version, status))
    assert {r.job_id: (r.version, r.status) for r in out.collect()} == want
    assert S.latest(work.add([]), "job_id", "version").count() == len(want)


def test_quota_with_sizes_and_closed_days_hold_no_state(spark, tmp_path):
    kind = "row_seq long, counter string, day string, amount long, at timestamp"
    work = Arrivals(spark, tmp_path, kind, lambda s: S.quota(s, "at", "1 hour", 10), "append")
    work.add([(2, "a", DAY, 4, at(2)), (1, "a", DAY, 5, at(1)), (3, "b", DAY, 11, at(2)), (4, "b", DAY, None, at(2))])
    work.add([(5, "a", DAY, 2, at(3)), (6, "a", DAY, 1, at(3)), (7, "a", DAY, 1, at(4))] + [(100 + i, "b", DAY, 1, at(5)) for i in range(30)])
    assert work.state("used").count() == 2
    out = work.add([(200, "a", "2024-01-02", 10, at(1, "2024-01-02")), (201, "a", "2024-01-02", 1, at(1, "2024-01-02"))])
    granted = sorted(r.row_seq for r in out.collect())
    assert granted == [1, 2, 4, 6, *range(100, 109), 200]
    assert [(r.key.counter, r.key.day) for r in work.state("used").collect()] == [("a", "2024-01-02")]


def test_leases_expire_when_the_watermark_passes(spark, tmp_path):
    work = Arrivals(spark, tmp_path, "lease_id string, state string, at timestamp", lambda s: S.lease_outcomes(s, 240, "1 hour", 20))
    read = lambda out: {r.lease_id: r.state for r in S.latest(out, "lease_id", "ended_at").collect()}
    assert read(work.add([("a", "leased", at(0)), ("b", "leased", at(1)), ("c", "leased", at(6)), ("e", "saved", at(5.5))])) == {"a": "expired", "b": "expired", "e": "saved"}
    second = work.add([("c", "saved", at(8)), ("a", "saved", at(9)), ("d", "leased", at(9)), ("d", "leased", at(8.5))])
    assert read(second) == {"a": "expired", "b": "expired", "c": "saved", "e": "saved"}
    # d gets no further event of its own
    assert read(work.add([("z", "leased", at(14))]))["d"] == "expired"
    assert work.state("lease").count() == 6
    work.add([("y", "leased", at(12, "2024-01-02"))])
    assert {r.key.lease_id for r in work.state("lease").collect()} == {"z", "y"}  # d has left its 20 hours behind


def test_failures_when_runs_arrive_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    runs = [(f"s{rng.randrange(3)}", i, rng.random() < 0.3, at(i / 10)) for i in range(150)]
    # within the watermark: each run is at most two hours late
    order = sorted(runs, key=lambda r: r[1] + rng.randrange(20))
    work = Arrivals(spark, tmp_path, "source_id string, row_seq long, success boolean, finished_at timestamp", lambda s: S.source_failures(s, "3 hours"))
    for part in range(3):
        out = work.add(order[part * 50 : part * 50 + 50])
    newest = out.withColumn("seen", F.greatest("last_success_at", "last_failure_at")).withColumn("rank", F.struct("seen", F.input_file_name()))
    got = {}
    for r in out.withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int")).orderBy("batch").collect():
        got[r.source_id] = r.consecutive_failures
    want = {}
    for source, _, ok, _ in runs:
        want[source] = 0 if ok else want.get(source, 0) + 1
    assert got == want and newest.count() > 0
    assert work.state("open").count() < 60


@pytest.fixture
def stored(spark, tmp_path):
    empty = "job_id string, source_id string, external_job_id string, canonical_url string, apply_url string, title string, company string, location string, tags array<string>, description string, scrape_run_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, is_new boolean, status string"
    kind = spark.createDataFrame([], empty).schema
    return str(tmp_path / "jobs"), kind


def batch_of(spark, ids, run, title="t"):
    rows = [(i, "s", i, "u", "u", title, "c", "l", ["x"], "d", run) for i in ids]
    return spark.createDataFrame(rows, "job_id string, source_id string, external_job_id string, canonical_url string, apply_url string, title string, company string, location string, tags array<string>, description string, scrape_run_id string")


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_only_the_partitions_it_touches(spark, stored):
    folder, kind = stored
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    first = cloud.upsert_jobs(spark.createDataFrame([], kind), batch_of(spark, [f"j{i}" for i in range(200)], "r1"), now)
    store.write(first, folder, 16)
    before = files(folder)
    some = batch_of(spark, ["j1", "j2", "new"], "r2", "other")
    numbers = store.touched(some, 16)
    store.upsert(folder, kind, some, now, 16)
    changed = before ^ files(folder)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in changed} == set(numbers) and len(numbers) <= 3
    rows = {r.job_id: r for r in store.read(spark, folder, kind).collect()}
    assert len(rows) == 201 and rows["j1"].title == "other" and rows["j3"].title == "t"
    assert rows["new"].is_new and not rows["j1"].is_new and rows["j3"].is_new
    # the same batch again changes nothing
    store.upsert(folder, kind, some, now, 16)
    assert {r.job_id: r for r in store.read(spark, folder, kind).collect()} == rows
    store.upsert(folder, kind, some.limit(0), now, 16)
    assert store.read(spark, folder, kind).count() == 201


def test_runs_are_ingested_once(spark, stored, tmp_path):
    _, kind = stored
    root = str(tmp_path)
    schema = "run_seq long, run_id string, source_id string, success boolean, jobs array<struct<external_job_id string, job_url string, job_apply_url string, job_title string, job_company string, job_location string, job_tags array<string>, job_description string>>"
    job = lambda i, title: (str(i), f"https://x.co/{i}", "", title, "c", "l", [], "d")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{root}/in")
        S.ingest(S.read_folder(spark, f"{root}/in", schema, "json"), f"{root}/store", f"{root}/check", kind, now, 4)
        return {r.external_job_id: (r.title, r.scrape_run_id, r.is_new) for r in store.read(spark, f"{root}/store/jobs", kind).collect()}

    arrive([(1, "r1", "s", True, [job(1, "a"), job(2, "a")])])
    second = arrive([(2, "r2", "s", True, [job(1, "b"), job(3, "b")])])
    assert second == {"1": ("b", "r2", False), "2": ("a", "r1", True), "3": ("b", "r2", True)}
    # r1 is sent once more, after r2
    assert arrive([(1, "r1", "s", True, [job(1, "a"), job(2, "a")])]) == second
