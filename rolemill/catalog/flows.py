"""Readers, sinks and streaming jobs over data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolemill.catalog import sqltext as q
from rolemill.catalog.extraction import escaped, page_texts
from rolemill.catalog.pipelines import _hash, scrape_results
from rolemill.catalog.registry import query
from rolemill.catalog.relational import _interval, _priority, at, sql_stamp, stamp
from rolemill.catalog.views import table, v_events, v_jobs, v_pages, v_postings, v_sources, with_views
from rolemill.operators import aggregates, plugins
from rolemill.plans import cloud, pipeline, rate, store
from rolemill.session import new_folder
from rolemill.sources import config, readers, sinks
from rolemill.streaming import jobs as S

# --- readers ------------------------------------------------------------------


@query("scan_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_table(spark, sf):
    """A table whose header carries blanks and a nameless column, written by Spark."""
    folder = new_folder(spark, "scan-table")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), F.col("o_orderstatus").alias("o_orderstatus "), F.lit("x").alias(" "))
    rows.write.parquet(folder)
    return readers.scan_table(spark, folder)


@query(
    "scan_csv",
    "SELECT doc_id, replace(text, chr(13), '') || '\"quoted\", x' AS text, '' AS blank FROM documents",
)
def scan_csv(spark, sf):
    """Documents with quotes, commas and line breaks, written as CSV and read back."""
    folder = new_folder(spark, "scan-csv")
    rows = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit('"quoted", x')).alias("text"), F.lit("").alias("blank"))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return readers.scan_csv(spark, folder, ["doc_id", "text", "blank"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("scan_scrape_list", with_views("v_postings") + "SELECT row_seq, source_id AS id, trim('page ' || JobId) AS name, JobUrl AS url FROM v_postings WHERE JobUrl <> ''")
def scan_scrape_list(spark, sf):
    entries = v_postings(spark, sf).select("row_seq", F.col("source_id").alias("ID"), F.concat(F.lit(" page "), "JobId").alias("Name "), F.col("JobUrl").alias("URL"))
    return readers.scrape_list(entries)


@query(
    "scan_rss_items",
    with_views("v_texts")
    + """SELECT row_seq, 0 AS item_pos, 'https://jobspresso.co/job/dev-' || CAST(row_seq AS VARCHAR) AS JobUrl, '' AS JobId, trim('Dev & Co ' || head) AS JobTitle, 'Acme' AS JobCompany, body AS JobLocation FROM v_texts
      UNION ALL SELECT row_seq, 2, url, coalesce(nullif(regexp_extract(url, '/([0-9]+)(?:/|$|[?])', 1), ''), ''), coalesce(nullif(head, ''), 'Untitled'), '', '' FROM v_texts""",
)
def scan_rss_items(spark, sf):
    """A feed of three items made of each page's title, text and address; one has no address."""
    feed = F.concat(
        F.lit("<rss><channel><title>t</title><item><title> Dev &amp; Co "),
        escaped("head"),
        F.lit("</title><link>https://jobspresso.co/job/dev-"),
        F.col("row_seq").cast("string"),
        F.lit("/?utm=1</link><job_listing:company>Acme</job_listing:company><job_listing:location>"),
        escaped("body"),
        F.lit("</job_listing:location></item><item><title>no link</title></item><item><title>"),
        escaped("head"),
        F.lit("</title><link>"),
        F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit("</link></item></channel></rss>"),
    )
    return readers.rss_items(page_texts(spark, sf).select("row_seq", feed.alias("xml")), "xml")


@query("scan_pages", "SELECT page_id, url, length(html) AS size FROM pages")
def scan_pages(spark, sf):
    return readers.scan_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("size"))


RUN_ROWS = 100


def envelopes(spark, sf):
    """Result envelopes: one run per source and hundred postings."""
    rows = scrape_results(spark, sf).withColumn("hundred", F.floor(F.col("row_seq") / RUN_ROWS))
    job = F.struct("row_seq", "external_job_id", "job_url", "job_apply_url", "job_title", "job_company", "job_location", "job_tags", "job_description")
    packed = rows.groupBy("source_id", "hundred").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    bare = F.transform("jobs", lambda j: j.dropFields("row_seq"))
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("long")
    return packed.select(
        (F.col("hundred") * 1000 + number).alias("run_seq"),
        F.concat_ws("-", "source_id", "hundred").alias("run_id"),
        "source_id",
        F.lit("L1").alias("lease_id"),
        (F.col("hundred") % 4 != 0).alias("success"),
        bare.alias("jobs"),
    )


@query(
    "ingest_envelope",
    with_views("v_postings")
    + """SELECT source_id || '-' || CAST(row_seq // 100 AS VARCHAR) AS run_id, CAST(row_number() OVER (PARTITION BY source_id, row_seq // 100 ORDER BY row_seq) - 1 AS INTEGER) AS job_pos, JobId AS external_job_id, JobUrl AS job_url, JobTitle AS job_title, JobDescription AS job_description, 4 AS tags FROM v_postings""",
)
def ingest_envelope(spark, sf):
    packed = envelopes(spark, sf)
    texts = packed.select(F.to_json(F.struct(*packed.columns)).alias("body"))
    rows = readers.parse_envelopes(texts, "body")
    return rows.select("run_id", "job_pos", "external_job_id", "job_url", "job_title", "job_description", (F.size("job_tags") + 1).alias("tags"))


@query(
    "sync_source_config",
    with_views("v_sources")
    + f"""SELECT source_id, name, enabled <> 'No' AS enabled, scrapePageUrl AS scrape_page_url, {_priority} AS priority, {_interval} AS min_interval_min, coalesce(CASE WHEN row_seq % 2 = 0 THEN consecutive_failures END, 0) AS consecutive_failures,
      CASE WHEN row_seq % 2 = 0 THEN {sql_stamp('last_started_at')} END AS started FROM v_sources
      UNION ALL SELECT 'gone' || CAST(row_seq AS VARCHAR), 'old', true, 'u', 1, 2, 3, NULL FROM v_sources""",
)
def sync_source_config(spark, sf):
    sheet = v_sources(spark, sf)
    when = F.lit(None).cast("timestamp_ntz")

    def stored(df, ident, name, started, failures):
        return df.select(
            ident.alias("source_id"), name.alias("name"), F.lit(True).alias("enabled"), F.lit("u").alias("scrape_page_url"), F.lit(1).alias("priority"), F.lit(2).alias("min_interval_min"),
            F.lit(2).alias("retry_limit"), F.lit(2).alias("retry_backoff_min"), F.lit(0).alias("daily_success_cap"), F.lit(0).alias("max_tabs_per_site"), when.alias("leased_until"),
            started.alias("last_started_at"), when.alias("last_success_at"), when.alias("last_failure_at"), failures.alias("consecutive_failures"),
        )

    half = stored(sheet.filter(F.col("row_seq") % 2 == 0), F.col("source_id"), F.lit("old"), F.col("last_started_at"), F.col("consecutive_failures"))
    gone = stored(sheet, F.concat(F.lit("gone"), F.col("row_seq").cast("string")), F.lit("old"), when, F.lit(3))
    out = config.sync_source_config(half.union(gone), sheet)
    return out.select("source_id", "name", "enabled", "scrape_page_url", "priority", "min_interval_min", "consecutive_failures", stamp("last_started_at").alias("started"))


# --- sinks ----------------------------------------------------------------------


@query(
    "write_events_jsonl",
    f"SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, CAST(user_id AS VARCHAR) AS job, count(*) AS n FROM events GROUP BY ALL",
)
def write_events_jsonl(spark, sf):
    folder = new_folder(spark, "events-jsonl")
    rows = v_events(spark, sf)
    payload = F.struct(F.col("job_id").cast("string").alias("job_id"), F.col("payload").alias("props"))
    sinks.write_events_jsonl(sinks.analytics_events(rows, F.col("event_type"), payload, F.col("created_at")), folder)
    back = spark.read.schema("event_type string, created_at string, payload struct<job_id string, props string>").json(folder)
    return back.groupBy("event_type", F.substring("created_at", 1, 19).alias("created"), F.col("payload.job_id").alias("job")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_marts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS jobs FROM events GROUP BY 1, 2",
)
def write_marts(spark, sf):
    root = new_folder(spark, "marts")
    events = v_events(spark, sf).select(F.col("event_id").cast("string"), F.col("job_id").cast("string"), "event_type", "created_at", F.col("run_id").cast("string"), "payload")
    sinks.write_mart(events, "job_events", root)
    back = spark.read.parquet(f"{root}/job_events")
    return back.groupBy(F.date_format("event_day", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"))


@query("scrape_log", f"SELECT {sql_stamp('ts')} AS timestamp, CAST(user_id AS VARCHAR) AS source, event_type AS stage, 'value=' || props AS details FROM events")
def scrape_log(spark, sf):
    folder = new_folder(spark, "scrape-log")
    rows = v_events(spark, sf)
    sinks.append_log(sinks.scrape_log(rows, F.col("job_id"), F.col("event_type"), F.concat(F.lit("value="), "payload"), F.col("created_at")), folder)
    return spark.read.parquet(folder)


# --- streams ----------------------------------------------------------------------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return S.read_folder(spark, sf, schema, pathGlobFilter="events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def in_arrivals(spark, rows, order: str, merge, kind: str = "parquet", schema=None, parts: int = 5):
    """Let the rows arrive in parts, in order; after each part the query starts again, takes what is new and stops.

    ``merge`` gets the stream and a folder for its checkpoint.
    """
    folder, check = new_folder(spark, "arriving"), new_folder(spark, "arriving-checkpoint")
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("cuts")).first().cuts
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(F.col(order) > low)
        part = part if high is None else part.filter(F.col(order) <= high)
        part.write.mode("append").format(kind).save(folder)
        merge(S.read_folder(spark, folder, schema or rows.schema, kind), check)


def changes_in_arrivals(spark, rows, order: str, job, mode: str = "update", parts: int = 5):
    """All changes that a keyed stream writes while the rows arrive in parts."""
    folder = new_folder(spark, "changes")
    kinds = []

    def merge(stream, check):
        out = job(stream)
        kinds.append(out.schema)
        S.write_changes(out, folder, check, mode)

    in_arrivals(spark, rows, order, merge, parts=parts)
    return S.read_changes(spark, folder, kinds[0])


def events_to_merge(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query(
    "stream_ingest",
    with_views("v_postings")
    + f""", r AS (SELECT {_hash} AS job_id, source_id, row_seq, row_seq // 100 AS run, JobTitle FROM v_postings),
      f AS (SELECT job_id, run, min(row_seq) AS row_seq FROM r GROUP BY 1, 2), l AS (SELECT job_id, max(row_seq) AS row_seq, count(*) AS runs FROM f GROUP BY 1)
      SELECT l.job_id, {q.trim('r.JobTitle')} AS title, r.source_id || '-' || CAST(r.run AS VARCHAR) AS run, runs = 1 AS is_new, 'new' AS status FROM l JOIN r ON l.row_seq = r.row_seq""",
)
def stream_ingest(spark, sf):
    folder = new_folder(spark, "jobs-store")
    schema = "run_seq long, run_id string, source_id string, lease_id string, success boolean, " + readers.ENVELOPE["jobs"].simpleString().replace("jobs:", "jobs ", 1)
    kind = cloud.result_jobs(scrape_results(spark, sf)).drop("row_seq").limit(0).withColumns(
        {"first_seen_at": at("2024-01-01"), "last_seen_at": at("2024-01-01"), "is_new": F.lit(True), "status": F.lit("new"), "rate_num": F.lit(0)}
    ).schema
    in_arrivals(spark, envelopes(spark, sf), "run_seq", lambda stream, check: S.ingest(stream, folder, check, kind, at("2024-05-01"), 8), "json", schema)
    out = store.read(spark, f"{folder}/jobs", kind)
    return out.select("job_id", "title", F.col("scrape_run_id").alias("run"), "is_new", "status")


@query("stream_dedup", "SELECT DISTINCT CAST(user_id AS VARCHAR) || '|' || event_type AS session_key FROM events")
def stream_dedup(spark, sf):
    folder, check = new_folder(spark, "dedup"), new_folder(spark, "dedup-checkpoint")
    keyed = event_stream(spark, sf).select("at", F.concat_ws("|", "user_id", "event_type").alias("session_key"))
    S.run_available(S.dedup(keyed, "session_key", "at", "60 days").writeStream.format("parquet").option("path", folder), check)
    return spark.read.parquet(folder).select("session_key")


@query(
    "stream_daily_stats",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
)
def stream_daily_stats(spark, sf):
    folder, check = new_folder(spark, "daily"), new_folder(spark, "daily-checkpoint")
    counts = S.daily_counts(event_stream(spark, sf), "at", "event_type", "1 hour")
    S.run_available(counts.writeStream.format("parquet").option("path", folder), check)
    return spark.read.parquet(folder)


@query(
    "stream_stage_pipeline",
    with_views("v_jobs")
    + f"""SELECT job_id, {q.key('title')} AS normalized_title, {q.infer_work_mode('location', 'description')} AS work_mode_hint, 'rated' AS pipeline_stage,
      CASE WHEN contains(lower(title || description), 'deny') THEN 1 WHEN contains(lower(location), 'remote') THEN 4 ELSE 3 END AS rate_num FROM v_jobs""",
)
def stream_stage_pipeline(spark, sf):
    source, folder, check = (new_folder(spark, n) for n in ("stored-jobs", "rated-jobs", "chain-checkpoint"))
    jobs = v_jobs(spark, sf).withColumns({"normalize_version": F.lit(0), "enrich_version": F.lit(0), "rate_version": F.lit(0)})
    jobs.write.parquet(source)
    stream = S.read_folder(spark, source, jobs.schema)
    chain = pipeline.stage_chain(stream, 1, lambda df: rate.keyword_rate(df, ("deny",), ("remote",)))
    S.run_available(chain.select("job_id", "normalized_title", "work_mode_hint", "pipeline_stage", "rate_num").writeStream.format("parquet").option("path", folder), check)
    return spark.read.parquet(folder)


@query("stream_job_state", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS version FROM events GROUP BY 1")
def stream_job_state(spark, sf):
    rows = events_to_merge(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"))
    return S.latest(changes_in_arrivals(spark, rows, "version", S.job_states), "job_id", "version")


@query(
    "stream_quota",
    "SELECT event_id AS row_seq, event_type AS counter, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS rn FROM events) WHERE rn <= 20",
)
def stream_quota(spark, sf):
    rows = events_to_merge(spark, sf).select(
        F.col("event_id").alias("row_seq"), F.col("event_type").alias("counter"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).cast("long").alias("amount"), "at"
    )
    return changes_in_arrivals(spark, rows, "row_seq", lambda stream: S.quota(stream, "at", "1 hour", 20), "append", parts=3)


@query(
    "stream_lease_ttl",
    """SELECT CAST(event_id AS VARCHAR) AS lease_id, CASE WHEN event_type = 'error' THEN 'saved' ELSE 'expired' END AS state FROM events
      WHERE event_type = 'error' OR ts + INTERVAL 240 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_lease_ttl(spark, sf):
    """Lease events arrive in the order of their times."""
    events = events_to_merge(spark, sf).select(F.unix_micros("at").alias("micros"), F.col("event_id").cast("string").alias("lease_id"), F.when(F.col("event_type") == "error", "saved").otherwise("leased").alias("state"), "at")
    folder = new_folder(spark, "lease-book")
    in_arrivals(spark, events, "micros", lambda stream, check: S.fold_leases(stream, folder, check, 240, "1 hour"), parts=3)
    return S.latest(S.read_changes(spark, f"{folder}/changes", StructType.fromDDL(S.OUTCOME)), "lease_id", "ended_at").select("lease_id", "state")


@query("stream_events_sink", "SELECT event_type, CAST(user_id AS VARCHAR) AS job_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_events_sink(spark, sf):
    folder, check = new_folder(spark, "event-log"), new_folder(spark, "event-log-checkpoint")
    rows = event_stream(spark, sf).withColumn("job_id", F.col("user_id").cast("string"))
    out = cloud.event_rows(rows, F.col("event_type"), {"props": F.col("props")}, F.col("ts"), "stream")
    S.run_available(out.writeStream.format("json").option("path", folder), check)
    back = spark.read.schema("event_id string, job_id string, event_type string").json(folder)
    return back.groupBy("event_type", "job_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_source_failures",
    """WITH l AS (SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY 1)
      SELECT 'src' || CAST(e.user_id AS VARCHAR) AS source_id, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR event_id > ok)) AS consecutive_failures FROM events e JOIN l ON e.user_id = l.user_id GROUP BY 1""",
)
def stream_source_failures(spark, sf):
    rows = events_to_merge(spark, sf).select(
        F.col("event_id").alias("row_seq"), F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("source_id"), (F.col("event_type") != "error").alias("success"), F.col("at").alias("finished_at")
    )
    failures = changes_in_arrivals(spark, rows, "row_seq", lambda stream: S.source_failures(stream, "1 hour"), parts=3)
    newest = failures.withColumn("at", F.greatest("last_success_at", "last_failure_at"))
    return S.latest(newest, "source_id", "at").select("source_id", "consecutive_failures")


@query(
    "source_failures",
    """WITH l AS (SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY 1)
      SELECT e.user_id AS source_id, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR event_id > ok)) AS consecutive_failures FROM events e JOIN l ON e.user_id = l.user_id GROUP BY 1""",
)
def source_failures(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("row_seq"), F.col("user_id").alias("source_id"), (F.col("event_type") != "error").alias("success"))
    return aggregates.consecutive_failures(runs)
