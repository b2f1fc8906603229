"""Streaming jobs: a stateless projection, a built-in aggregate, or keyed state with event-time timers.

State is Structured Streaming's own: Spark keeps it by key in its state store, writes only what a
micro-batch changes, and brings it back when a task or the query starts again. Results that change
over time are written as changes, one folder per micro-batch, which a retried batch overwrites.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rolemill.operators.winners import SEQ
from rolemill.plans import cloud, store
from rolemill.session import ship_package
from rolemill.sources.readers import envelope_rows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Requests of one day that a quota looks through at a time.
KEPT_REQUESTS = 10_000


def run_available(writer, checkpoint: str) -> None:
    """Process what is there, then stop."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def read_folder(spark: SparkSession, folder: str, schema, kind: str = "parquet", **options) -> DataFrame:
    """A streaming read of a folder of files."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(folder)


def write_changes(changes: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> None:
    """Write each micro-batch's rows to a folder of its own."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    run_available(changes.writeStream.outputMode(mode).foreachBatch(step), checkpoint)


def read_changes(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).parquet(folder).select(*schema.names)


def latest(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The last change of each key."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), version).alias("_last")).select("_last.*")


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, kind: str, mode: str = "update") -> DataFrame:
    """Rows of a stream with a watermark through a processor that keeps state by key."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy(*keys).transformWithState(processor, kind, mode, "EventTime")


_EPOCH = dt.datetime(1970, 1, 1)


def _millis(time: dt.datetime) -> int:
    """Milliseconds since 1970, rounded up."""
    if time.tzinfo is None:  # as Spark hands times over: in the worker's zone
        time = time.astimezone(dt.UTC)
    return -((_EPOCH - time.replace(tzinfo=None)) // dt.timedelta(milliseconds=1))


def _time(millis: int | None) -> dt.datetime | None:
    """The same, as Spark takes times."""
    if millis is None:
        return None
    return (_EPOCH + dt.timedelta(milliseconds=millis)).replace(tzinfo=dt.UTC).astimezone().replace(tzinfo=None)


# --- ingest -----------------------------------------------------------------------


def latest_per_job(batch: DataFrame) -> DataFrame:
    """One row per job of a micro-batch: the last run's, with the number of runs that saw it."""
    seen = batch.groupBy("job_id").agg(F.max(SEQ).alias(SEQ), F.count(F.lit(1)).alias("runs"))
    return batch.join(seen.select(SEQ, "runs"), SEQ)


def envelope_jobs(envelopes: DataFrame) -> DataFrame:
    """The jobs of a micro-batch's envelopes, each once.

    ``envelopes`` carries run_seq, a unique number that orders the runs.
    """
    rows = envelope_rows(envelopes).filter(F.col("job_pos").isNotNull())
    # job_pos is a 32-bit number, so runs of any length stay apart
    run = F.col("run_seq").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)")
    numbered = rows.withColumn(SEQ, (run + F.col("job_pos")).cast("decimal(31,0)"))
    return latest_per_job(cloud.result_jobs(numbered))


def ingest(stream: DataFrame, folder: str, checkpoint: str, schema, as_of: Column, buckets: int = store.BUCKETS) -> None:
    """Fold result envelopes into the partitioned job store below ``folder``.

    Each run is ingested once: runs of earlier micro-batches are left out, and a micro-batch that is
    tried again meets its own rows, which stay. ``schema`` is that of the store's jobs.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = spark.read.schema("run_id string, batch long").option("basePath", f"{folder}/runs").parquet(f"{folder}/runs")
        done = runs.filter(F.col("batch") != batch_id).select("run_id")
        fresh = batch.join(done, "run_id", "left_anti")
        # one folder for the batch at hand: read by the list of partitions and by the store
        jobs = envelope_jobs(fresh)
        jobs.write.mode("overwrite").parquet(f"{folder}/incoming")
        store.upsert(f"{folder}/jobs", schema, spark.read.schema(jobs.schema).parquet(f"{folder}/incoming"), as_of, buckets)
        fresh.select("run_id").distinct().write.mode("overwrite").parquet(f"{folder}/runs/batch={batch_id}")

    spark = stream.sparkSession
    spark.createDataFrame([], schema).withColumn(store.BUCKET, F.lit(0)).limit(0).write.mode("append").partitionBy(store.BUCKET).parquet(f"{folder}/jobs")
    spark.createDataFrame([], "run_id string, batch long").write.mode("append").partitionBy("batch").parquet(f"{folder}/runs")
    run_available(stream.writeStream.foreachBatch(step), checkpoint)


# --- dedup, daily counts, chain ----------------------------------------------------


def dedup(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First arrival per key while its state lives, bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, label: str, delay: str) -> DataFrame:
    """Rows per UTC day and label; a day is final once the watermark has passed it."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), label)
    counted = windowed.agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), label, "n")


def job_states(stream: DataFrame) -> DataFrame:
    """Highest version per job wins; older versions are skipped, whenever they come."""
    return stream.groupBy("job_id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version"))


# --- quota --------------------------------------------------------------------------


class DailyQuota(StatefulProcessor):
    """Grants requests of a (counter, day) in row order while the cap lasts, across micro-batches.

    The state is what the day has used. It goes when the watermark has passed the day.
    """

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.used.exists()
        left = self.cap - (self.used.get()[0] if known else 0)
        kept: list[tuple[int, int]] = []
        for row in rows:
            kept.append((row[SEQ], max(1, row["amount"] or 1)))
            if len(kept) >= 2 * KEPT_REQUESTS:
                kept = self._fitting(kept, left)
        granted = []
        for seq, size in sorted(kept):
            if size <= left:
                left -= size
                granted.append(Row(**{SEQ: seq, "counter": key[0], "day": key[1]}))
        self.used.update((self.cap - left,))
        if not known:
            day = dt.datetime.strptime(key[1], "%Y-%m-%d").replace(tzinfo=dt.UTC)
            self.handle.registerTimer(_millis(day + dt.timedelta(days=1)))
        yield from granted

    def _fitting(self, asked: list[tuple[int, int]], left: int) -> list[tuple[int, int]]:
        """Of requests of one size only as many as may fit, so a busy day stays small."""
        seen: Counter[int] = Counter()
        out = []
        for seq, size in sorted(asked):
            seen[size] += 1
            if size * seen[size] <= left:
                out.append((seq, size))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def quota(stream: DataFrame, time: str, delay: str, cap: int) -> DataFrame:
    """Granted requests (row_seq, counter, day) of a stream with row_seq, counter, day, amount and a time.

    ``day`` is the UTC day of the time as text; requests later than the watermark are not answered.
    """
    asked = stream.withWatermark(time, delay).filter("counter IS NOT NULL AND day IS NOT NULL")
    return keyed(asked, ["counter", "day"], DailyQuota(cap), f"{SEQ} long, counter string, day string", "append")


# --- leases with a time limit --------------------------------------------------------


class LeaseTtl(StatefulProcessor):
    """A lease's outcome: how it ended in time, or expired once the watermark has passed its limit.

    The first issue and the first end count, in whatever order they arrive. The state stays
    for a while after the limit, so that a late end can't open a lease again, and goes then.
    """

    def __init__(self, minutes: int, keep_hours: int):
        self.limit, self.keep = minutes * 60_000, keep_hours * 3_600_000

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "issued long, ended long, how string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        issued, ended, how, timer = self.lease.get() if self.lease.exists() else (None, None, None, None)
        before = self._outcome(issued, ended, how)
        for row in rows:
            at, state = _millis(row["at"]), row["state"]
            if state == "leased":
                issued = at if issued is None else min(issued, at)
            elif ended is None or (at, state) < (ended, how):
                ended, how = at, state
        outcome = self._outcome(issued, ended, how)
        due = self._due(issued, ended)
        then = due + self.keep if outcome else max(due, timerValues.getCurrentWatermarkInMs() + 1)
        if timer != then:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(then)
        self.lease.update((issued, ended, how, then))
        if outcome and outcome != before:
            yield Row(lease_id=key[0], state=outcome, ended_at=_time(ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        issued, ended, how, _ = self.lease.get()
        due = self._due(issued, ended)
        if expiredTimerInfo.getExpiryTimeInMs() >= due + self.keep:
            self.lease.clear()
        else:
            self.handle.registerTimer(due + self.keep)
            self.lease.update((issued, ended, how, due + self.keep))
            yield Row(lease_id=key[0], state="expired", ended_at=_time(due))

    def _due(self, issued, ended) -> int:
        return (issued if issued is not None else ended) + self.limit

    def _outcome(self, issued, ended, how) -> str | None:
        return how if ended is not None and (issued is None or ended <= issued + self.limit) else None

    def close(self) -> None:
        pass


def lease_outcomes(stream: DataFrame, minutes: int = 240, delay: str = "1 hour", keep_hours: int = 72) -> DataFrame:
    """Changes of outcomes (lease_id, state, ended_at) of a stream of lease events (lease_id, state, at).

    Each lease costs some calls between Python and the state store; ``fold_leases`` is for millions of them.
    """
    events = stream.withWatermark("at", delay).filter("lease_id IS NOT NULL AND state IS NOT NULL AND at IS NOT NULL")
    return keyed(events, ["lease_id"], LeaseTtl(minutes, keep_hours), "lease_id string, state string, ended_at timestamp")


OUTCOME = "lease_id string, state string, ended_at timestamp"


def fold_leases(stream: DataFrame, folder: str, checkpoint: str, minutes: int = 240, delay: str = "1 hour", keep_hours: int = 72) -> None:
    """The rule of ``LeaseTtl`` for many leases at a time: their changes of outcome go below ``folder``/changes.

    A micro-batch joins its events to the table of the leases that are kept and writes the next one. Two
    tables take turns, so a batch that is tried again finds the one it began with. The time that the
    watermark has reached lies beside each table; events at or before it are late and left out.
    """
    limit, keep, lag = (F.expr(f"INTERVAL {x}") for x in (f"{minutes} MINUTE", f"{keep_hours} HOUR", delay))
    held = "lease_id string, issued timestamp, end struct<at:timestamp,state:string>, told string, due timestamp, changed boolean"
    reached = "reached timestamp"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        read = lambda name, kind, back: spark.read.schema(kind).parquet(f"{folder}/{name}-{(batch_id - back) % 2}")
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}-{batch_id % 2}")
        before = read("reached", reached, 1).agg(F.max("reached").alias("reached"))
        write(batch.agg((F.max("at") - lag).alias("reached")).union(before).agg(F.max("reached").alias("reached")), "reached")

        events = batch.filter("lease_id IS NOT NULL AND state IS NOT NULL AND at IS NOT NULL").crossJoin(F.broadcast(before))
        issue = F.col("state") == "leased"
        seen = events.filter("reached IS NULL OR at > reached").select(
            "lease_id", F.when(issue, F.col("at")).alias("issued"), F.when(~issue, F.struct("at", "state")).alias("end"), F.lit(None).cast("string").alias("told")
        )
        kept = read("leases", held, 1).crossJoin(F.broadcast(before)).filter(F.col("due") + keep > F.col("reached")).select(*seen.columns)
        leases = kept.unionByName(seen).groupBy("lease_id").agg(*[f(c).alias(c) for f, c in ((F.min, "issued"), (F.min, "end"), (F.max, "told"))])
        due = F.coalesce("issued", "end.at") + limit
        in_time = F.col("end").isNotNull() & (F.col("issued").isNull() | (F.col("end.at") <= F.col("issued") + limit))
        now = F.when(in_time, F.col("end.state")).when(due <= F.col("reached"), "expired")
        judged = leases.crossJoin(F.broadcast(read("reached", reached, 0))).withColumns({"due": due, "now": now})
        write(judged.select("lease_id", "issued", "end", F.coalesce("now", "told").alias("told"), "due", (F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("told"))).alias("changed")), "leases")

        ended_at = F.when(in_time, F.col("end.at")).otherwise(F.col("due"))
        changes = read("leases", held, 0).filter("changed").select("lease_id", F.col("told").alias("state"), ended_at.alias("ended_at"))
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    for name, kind in (("leases", held), ("reached", reached)):
        for turn in (0, 1):
            stream.sparkSession.createDataFrame([], kind).write.mode("append").parquet(f"{folder}/{name}-{turn}")
    run_available(stream.writeStream.foreachBatch(step), checkpoint)


# --- failures of sources ----------------------------------------------------------------


class SourceFailures(StatefulProcessor):
    """Failures of a source since its last success, in the order of the runs, not of their arrival.

    Failures that the watermark has not passed are kept one by one, since a late success may come
    between them; older ones are only a count.
    """

    def init(self, handle) -> None:
        self.base = handle.getValueState("base", "ok_at long, ok_seq long, settled long, failed_at long")
        self.open = handle.getListState("open", "at long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ok_at, ok_seq, settled, failed_at = self.base.get() if self.base.exists() else (None, None, 0, None)
        last = None if ok_at is None else (ok_at, ok_seq)
        waiting = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for row in rows:
            run = (_millis(row["finished_at"]), row[SEQ])
            if not row["success"]:
                waiting.append(run)
            elif last is None or run > last:
                # a success that isn't late is newer than all failures that are only counted
                last, settled = run, 0
        waiting = sorted(w for w in waiting if last is None or w > last)
        if waiting:
            failed_at = max(failed_at or 0, waiting[-1][0])
        if last is not None and failed_at is not None and failed_at < last[0]:
            failed_at = None
        passed = timerValues.getCurrentWatermarkInMs()
        later = [w for w in waiting if w[0] >= passed]
        count = settled + len(waiting)
        settled += len(waiting) - len(later)
        self.base.update((*(last or (None, None)), settled, failed_at))
        if later:
            self.open.put(later)
        else:
            self.open.clear()
        yield Row(source_id=key[0], consecutive_failures=count, last_success_at=_time(last and last[0]), last_failure_at=_time(failed_at))

    def close(self) -> None:
        pass


def source_failures(stream: DataFrame, delay: str) -> DataFrame:
    """Changes (source_id, consecutive_failures, last_success_at, last_failure_at) of a stream of runs.

    Runs: source_id, row_seq, success, finished_at; ordered by time, then row number.
    """
    runs = stream.withWatermark("finished_at", delay).filter("source_id IS NOT NULL AND finished_at IS NOT NULL")
    kind = "source_id string, consecutive_failures long, last_success_at timestamp, last_failure_at timestamp"
    return keyed(runs, ["source_id"], SourceFailures(), kind)
