"""Properties on skewed, random and repeated input; hot groups against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from rolemill.operators import joins, moves, winners
from rolemill.plans import cloud, leases, load, rate


def skewed(spark, rows=3000, keys=40, seed=7):
    """Row numbers with keys of which one holds a third of the rows; some keys are null."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = "hot" if rng.random() < 0.34 else (None if rng.random() < 0.05 else f"k{rng.randrange(keys)}")
        data.append((i * 37 % rows * 50, key, rng.randrange(5)))
    return data, spark.createDataFrame(data, "row_seq long, key string, score int")


def test_keep_first(spark):
    data, df = skewed(spark)
    firsts = {}
    for seq, key, _ in sorted(data):
        firsts.setdefault(key, seq)
    want = {s for k, s in firsts.items() if k is not None} | {s for s, k, _ in data if k is None}
    got = [r["row_seq"] for r in winners.keep_first(df, "key").collect()]
    assert sorted(got) == sorted(want)
    only = [r["row_seq"] for r in winners.keep_first(df, "key", keep_blank=False).collect()]
    assert sorted(only) == sorted(s for k, s in firsts.items() if k is not None)


def test_best_rows(spark):
    data, df = skewed(spark)
    best = {}
    for seq, key, score in data:
        if key is not None and (key not in best or (score, -seq) > best[key]):
            best[key] = (score, -seq)
    got = {r["key"]: r["row_seq"] for r in winners.best_rows(df.filter("key is not null"), ["key"], "score").collect()}
    assert got == {k: -v[1] for k, v in best.items()}


def test_positions_cross_ranges(spark):
    rng = random.Random(3)
    seqs = sorted(rng.sample(range(400_000), 1500))
    data = [(s, "hot" if i % 3 else f"k{i % 7}") for i, s in enumerate(seqs)]
    counts, want = defaultdict(int), {}
    for s, k in data:
        counts[k] += 1
        want[s] = counts[k]
    df = spark.createDataFrame(data, "row_seq long, key string")
    got = {r["row_seq"]: r["pos"] for r in winners.positions(df, ["key"]).collect()}
    assert got == want


def test_attach_group_hot_and_cold(spark):
    data, df = skewed(spark)
    tops = df.filter("key is not null").groupBy("key").agg(F.max("score").alias("top"))
    want = defaultdict(lambda: None)
    for _, key, score in data:
        if key is not None:
            want[key] = max(want[key] or 0, score)
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        rows = winners.attach_group(df, tops, "key").collect()
        assert len(rows) == len(data)
        assert all(r["top"] == want[r["key"]] for r in rows)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attach_group_splits_a_hot_key(spark):
    """99 % of the rows have one key; its rows are read by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    df = spark.range(0, 200_000, 1, 16).select(F.col("id").alias("row_seq"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).cast("string").alias("key"))
    tops = df.groupBy("key").agg(F.max("row_seq").alias("top"))
    joined = winners.attach_group(df, tops, "key").withColumn("task", F.spark_partition_id())
    tasks = joined.filter("key = '7'").groupBy("task").count().collect()
    for k in settings:
        spark.conf.unset(k)
    assert len(tasks) > 3 and sum(r["count"] for r in tasks) == 198_000


def test_quota_paths_agree(spark):
    data = [(i, "c" if i % 3 else "d", "2024-01-01" if i % 2 else "2024-01-02") for i in range(4000)]
    df = spark.createDataFrame(data, "row_seq long, counter string, day string")
    for cap in (0, 7, 1000, 1200):
        seen, want = defaultdict(int), set()
        for seq, counter, day in data:
            seen[counter, day] += 1
            if cap < 1 or seen[counter, day] <= cap:
                want.add(seq)
        got = {r["row_seq"] for r in leases.daily_quota(df, cap).filter("granted").collect()}
        assert got == want


def postings(spark, rows):
    return spark.createDataFrame(rows, "row_seq long, JobId string, JobUrl string, Status string")


def test_increment_load_is_idempotent(spark):
    rows = [
        (1, "1", "https://a.com/1", "Approved"), (2, "1", "https://www.a.com/x", "Approved"), (3, "", "https://a.com/1/", "Approved"),
        (4, "", "", "Approved"), (5, "", "", "Approved"), (6, "9", "https://a.com/9", "Approved"), (7, "8", "https://a.com/8", "Staged"),
    ]
    old = postings(spark, [(100, "9", "http://m.a.com/zzz", "Loaded")])
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    first = load.increment_load(postings(spark, rows), old, as_of=now)
    assert sorted(r["row_seq"] for r in first.collect()) == [1, 3, 4, 5]
    again = load.increment_load(postings(spark, rows), old, first.select("row_seq", "JobId", "JobUrl", "Status"), as_of=now)
    assert sorted(r["row_seq"] for r in again.collect()) == [4, 5]


def test_split_is_a_partition(spark):
    _, df = skewed(spark)
    moved, stay = moves.split(df, F.col("key") == "hot")
    assert moved.count() + stay.count() == df.count()
    assert moved.join(stay, "row_seq").count() == 0


def brute_update_match(updates, rows):
    out = {}
    for u, wanted in updates:
        out[u] = next((n for n, keys in rows if set(keys) & set(wanted)), None)
    return out


def test_update_match_against_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: [
        (i, rng.choice(["", "1", "2", "3"]), rng.choice(["", "https://a.com/1", "https://b.com/2"]), rng.choice(["", "https://c.com/3"]),
         rng.choice(["", "T", "t "]), rng.choice(["", "Acme"]), rng.choice(["", "Lima"]))
        for i in range(n)
    ]
    schema = "row_seq long, JobId string, JobUrl string, JobApplyUrl string, JobTitle string, JobCompany string, JobLocation string"
    updates, table = spark.createDataFrame(make(60), schema), spark.createDataFrame(make(80), schema)

    def keyed(df):
        grouped = joins.update_keys(df).groupBy("row_seq").agg(F.collect_set("key").alias("k"))
        found = {r["row_seq"]: r["k"] for r in grouped.collect()}
        return sorted((r["row_seq"], found.get(r["row_seq"], [])) for r in df.collect())

    got = {r["row_seq"]: r["row_num"] for r in joins.update_match(updates, table).collect()}
    assert got == brute_update_match(keyed(updates), keyed(table))


def job_store(spark, rows):
    schema = "row_seq long, source_id string, run_id string, external_job_id string, job_url string, job_apply_url string, job_title string, job_company string, job_location string, job_tags array<string>, job_description string"
    return cloud.result_jobs(spark.createDataFrame(rows, schema))


def test_smoke_posting_through_all_stages(spark):
    row = (1, "linkedin", "run-1", "li-1", "https://l.com/1", "", "Senior Backend Node Engineer Remote", "Acme", "Remote EU", ["node", "typescript", "gcp"], "GCP backend role")
    batch = job_store(spark, [row])
    extra = {"first_seen_at": "timestamp_ntz", "last_seen_at": "timestamp_ntz", "is_new": "boolean", "status": "string", "rate_num": "int", "rate_reason": "string", "rate_provider": "string",
             "rated_model": "string", "normalize_version": "int", "enrich_version": "int", "rate_version": "int", "pipeline_stage": "string", "enrich_summary": "string", "work_mode_hint": "string", "notified_at": "string"}
    empty = batch.drop("row_seq").limit(0).withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    now = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    jobs = cloud.upsert_jobs(empty, batch, now)
    assert jobs.first()["is_new"] and jobs.first()["status"] == "new"
    rater = lambda df: rate.keyword_rate(df, ("intern", "frontend"), ("backend", "node", "typescript", "gcp", "remote"))
    from rolemill.plans import pipeline

    done = pipeline.stage_chain(jobs, 1, rater)
    rated = done.first()
    assert (rated["status"], rated["rate_num"], rated["pipeline_stage"], rated["work_mode_hint"]) == ("2Apply", 4, "rated", "Remote")
    assert rated["rate_reason"] == "Target keywords: backend, node, typescript, gcp, remote"
    again = pipeline.stage_chain(done, 1, rater)
    assert again.collect() == done.collect()
    seen = cloud.upsert_jobs(done, batch, F.lit("2024-01-02").cast("timestamp_ntz")).first()
    assert not seen["is_new"] and seen["status"] == "2Apply" and str(seen["first_seen_at"]).startswith("2024-01-01")
    none = spark.createDataFrame([], "job_id string, status string, target_chat_id string")
    told = cloud.notify_batch(done.withColumn("row_seq", F.lit(1)), none, "7", 20, now).first()
    assert told["status"] == "queued" and told["message"].startswith("New good job\nSenior Backend")


def test_final_rating_needs_exactly_one_row(spark):
    rows = spark.createDataFrame([(1, "2LRate", "a", "h"), (2, "2LRate", "b", "h"), (3, "2LRate", "b", "h"), (4, "2Apply", "c", "h")], "row_seq long, Status string, stable_key string, snapshot_hash string")
    asks = spark.createDataFrame([("L1", "a", "h"), ("L2", "b", "h"), ("L3", "c", "h"), ("L4", "a", "other")], "lease_id string, stable_key string, snapshot_hash string")
    got = {r["lease_id"]: (r["matches"], r["row_num"], r["state"]) for r in joins.fail_closed(asks, rows).collect()}
    assert got == {"L1": (1, 1, "saved"), "L2": (2, None, "conflict"), "L3": (0, None, "conflict"), "L4": (0, None, "conflict")}


def test_source_runtime(spark):
    sources = spark.createDataFrame([("a", 2), ("b", 1), ("c", 5)], "source_id string, consecutive_failures int").selectExpr(
        "source_id", "cast('2024-01-01' as timestamp_ntz) leased_until", "cast(null as timestamp_ntz) last_success_at", "cast('2023-12-31' as timestamp_ntz) last_failure_at", "consecutive_failures"
    )
    runs = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False), (4, "b", False)], "row_seq long, source_id string, success boolean").selectExpr(
        "*", "cast('2024-01-01' as timestamp_ntz) + make_dt_interval(0, row_seq) finished_at"
    )
    got = {r["source_id"]: r for r in cloud.source_runtime(sources, runs).collect()}
    assert [got[k]["consecutive_failures"] for k in "abc"] == [2, 2, 5]
    assert got["a"]["leased_until"] is None and got["c"]["leased_until"] is not None
    assert str(got["a"]["last_success_at"]).endswith("01:00:00") and str(got["a"]["last_failure_at"]).endswith("03:00:00")
