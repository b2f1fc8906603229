"""Posting-shaped views over the given tables, in Spark and in DuckDB SQL.

Each view is one projection (or one join) of whole tables. The SQL text of a
view has the view's name, so ``with_views`` can build the WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view_sql(name: str, statement: str, needs: tuple[str, ...] = ()) -> None:
    SQL[name] = (needs, statement)


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(name):
        for needed in SQL[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order) + "\n"


# --- pages ------------------------------------------------------------------


def v_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_seq"), "url", "html")


view_sql("v_pages", "SELECT page_id AS row_seq, url, html FROM pages")

# --- postings ---------------------------------------------------------------

PLACES = {"es": "Montevideo, Uruguay", "fr": "Remote - Latin America", "de": "Hybrid Berlin"}


def v_postings(spark, sf_dir):
    """Documents as postings; ids repeat every second round over the pages, some ids and addresses are blank."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = table(spark, sf_dir, "documents")
    total = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.lit("Remote EU")
    for lang, name in PLACES.items():
        place = F.when(F.col("lang") == lang, name).otherwise(place)
    posts = docs.withColumn("n_pages", total)
    url = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.coalesce(F.col("url"), F.lit("")))
    joined = posts.join(pages, posts["doc_id"] % posts["n_pages"] == pages["page_id"], "left")
    return joined.select(
        F.col("doc_id").alias("row_seq"),
        F.when(F.col("doc_id") % 11 == 0, "")
        .otherwise((F.col("doc_id") % (2 * F.col("n_pages"))).cast("string"))
        .alias("JobId"),
        url.alias("JobUrl"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(url, F.lit("/apply"))).alias("JobApplyUrl"),
        F.substring_index("text", "\n", 1).alias("JobTitle"),
        F.col("source").alias("JobCompany"),
        place.alias("JobLocation"),
        F.concat_ws(", ", "lang", "source", F.lit("")).alias("JobTags"),
        F.col("text").alias("JobDescription"),
        F.col("source").alias("source_id"),
    )


_place = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLACES.items())
_url = "CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(url, '') END"
view_sql(
    "v_postings",
    f"""SELECT doc_id AS row_seq,
      CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(doc_id % (2 * (SELECT count(*) FROM pages)) AS VARCHAR) END AS JobId,
      {_url} AS JobUrl,
      CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_url} || '/apply' END AS JobApplyUrl,
      split_part(text, chr(10), 1) AS JobTitle, source AS JobCompany,
      CASE lang {_place} ELSE 'Remote EU' END AS JobLocation,
      lang || ', ' || source || ', ' AS JobTags,
      text AS JobDescription, source AS source_id
    FROM documents LEFT JOIN pages ON doc_id % (SELECT count(*) FROM pages) = page_id""",
)


def v_history(spark, sf_dir):
    """Postings that were reviewed before: those whose document carries a label."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_seq"))
    return v_postings(spark, sf_dir).join(labels, "row_seq", "left_semi")


view_sql(
    "v_history",
    "SELECT * FROM v_postings WHERE row_seq IN (SELECT doc_id FROM labels)",
    ("v_postings",),
)

# --- status rows ------------------------------------------------------------

REASONS = {
    "1-URGENT": "Title matched deny regex",
    "2-HIGH": "Medium CRate: JobWorkMode=Onsite",
    "3-MEDIUM": "JobRateNum = 1",
    "4-NOT SPECIFIED": "JobRateNum: 3; Location DBL",
}
STATES = {"F": "2Apply", "O": " 2Delete", "P": "Loaded"}


def v_status(spark, sf_dir):
    """Orders as rated rows."""
    orders = table(spark, sf_dir, "orders")
    status, desc = F.lit(""), F.lit("")
    for code, name in STATES.items():
        status = F.when(F.col("o_orderstatus") == code, name).otherwise(status)
    for code, name in REASONS.items():
        desc = F.when(F.col("o_orderpriority") == code, name).otherwise(desc)
    return orders.select(
        F.col("o_orderkey").alias("row_seq"),
        F.col("o_orderkey").cast("string").alias("JobId"),
        status.alias("Status"),
        F.substring("o_orderpriority", 1, 1).alias("JobRateNum"),
        desc.alias("JobRateDesc"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("RatedModelName"),
        F.col("o_orderdate").alias("LoadDttm"),
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source_id"),
        F.col("o_totalprice").alias("price"),
    )


view_sql(
    "v_status",
    """SELECT o_orderkey AS row_seq, CAST(o_orderkey AS VARCHAR) AS JobId,
      CASE o_orderstatus WHEN 'F' THEN '2Apply' WHEN 'O' THEN ' 2Delete' WHEN 'P' THEN 'Loaded' ELSE '' END AS Status,
      substr(o_orderpriority, 1, 1) AS JobRateNum,
      CASE o_orderpriority """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items())
    + """ ELSE '' END AS JobRateDesc,
      CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS RatedModelName,
      o_orderdate AS LoadDttm, 'src' || CAST(o_custkey % 20 AS VARCHAR) AS source_id, o_totalprice AS price
    FROM orders""",
)

# --- events -----------------------------------------------------------------


def v_events(spark, sf_dir):
    """Events as pipeline events; one hundred in a row share a run."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        "event_type",
        F.col("ts").alias("created_at"),
        F.col("props").alias("payload"),
        F.floor(F.col("event_id") / 100).alias("run_id"),
        "value",
    )


view_sql(
    "v_events",
    """SELECT event_id, user_id AS job_id, event_type, ts AS created_at, props AS payload,
      event_id // 100 AS run_id, value FROM events""",
)

# --- stack rows -------------------------------------------------------------


def v_stack(spark, sf_dir):
    """Parts as rated postings with a technology list."""
    where = (
        F.when(F.col("p_type") == "ECONOMY", "Uruguay")
        .when(F.col("p_type") == "SMALL", "Montevideo")
        .when(F.col("p_type") == "PROMO", "Latin America")
        .otherwise(F.col("p_type"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_seq"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit(" | "), F.col("p_type")).alias("JobTop3Stack"),
        F.col("p_brand").alias("JobCompany"),
        F.col("p_name").alias("JobTitle"),
        where.alias("JobLocation"),
        F.col("p_size").alias("size"),
    )


view_sql(
    "v_stack",
    """SELECT p_partkey AS row_seq, replace(p_name, ' ', ' | ') || ' | ' || p_type AS JobTop3Stack,
      p_brand AS JobCompany, p_name AS JobTitle,
      CASE p_type WHEN 'ECONOMY' THEN 'Uruguay' WHEN 'SMALL' THEN 'Montevideo' WHEN 'PROMO' THEN 'Latin America'
        ELSE p_type END AS JobLocation, p_size AS size FROM part""",
)

# --- sources ----------------------------------------------------------------


def v_sources(spark, sf_dir):
    """Suppliers as scrape sources, with their nation as page name."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("src"), key.cast("string")).alias("source_id"),
        F.concat(F.col("n_name"), F.lit(" "), key.cast("string")).alias("name"),
        F.when(key % 7 == 0, "No").when(key % 5 == 0, "").otherwise("yes").alias("enabled"),
        F.when(key % 3 == 0, "").otherwise(F.round("s_acctbal", 0).cast("int").cast("string")).alias("priority"),
        F.when(key % 4 == 0, "abc").otherwise((key % 50 * 10).cast("string")).alias("minIntervalMin"),
        F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("https://jobs.example.com/"), key.cast("string"))).alias(
            "scrapePageUrl"
        ),
        key.alias("row_seq"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 31).cast("int")).cast("timestamp_ntz").alias("last_started_at"),
        (key % 4).cast("int").alias("consecutive_failures"),
        F.col("s_acctbal").alias("balance"),
    )


view_sql(
    "v_sources",
    """SELECT 'src' || CAST(s_suppkey AS VARCHAR) AS source_id, n_name || ' ' || CAST(s_suppkey AS VARCHAR) AS name,
      CASE WHEN s_suppkey % 7 = 0 THEN 'No' WHEN s_suppkey % 5 = 0 THEN '' ELSE 'yes' END AS enabled,
      CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(CAST(round(s_acctbal, 0) AS INTEGER) AS VARCHAR) END AS priority,
      CASE WHEN s_suppkey % 4 = 0 THEN 'abc' ELSE CAST(s_suppkey % 50 * 10 AS VARCHAR) END AS minIntervalMin,
      CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'https://jobs.example.com/' || CAST(s_suppkey AS VARCHAR) END AS scrapePageUrl,
      s_suppkey AS row_seq,
      CAST(DATE '2024-01-01' + CAST(s_suppkey % 31 AS INTEGER) AS TIMESTAMP) AS last_started_at,
      CAST(s_suppkey % 4 AS INTEGER) AS consecutive_failures, s_acctbal AS balance
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)

# --- addresses as the boards write them ---------------------------------------

# site, text before the number, text behind it
LINK_SHAPES = (
    ("linkedin", "https://www.linkedin.com/jobs/view/", "/?refId=ab&trk=x"),
    ("hh", "https://hh.ru/vacancy/", "?from=main#top"),
    ("habr", "https://career.habr.com/vacancies/", ""),
    ("lever", "https://jobs.lever.co/acme/d0c-", "/#apply"),
    ("computrabajo", "https://uy.computrabajo.com/ofertas-de-trabajo/oferta-de-dev-ABCDEF0123456789", "?x=1"),
    ("getonbrd", "https://www.getonbrd.com/jobs/programming/dev-", "?page=3"),
    ("jobspresso", " https://jobspresso.co/job/dev-", "/?x=1"),
    ("torc", "https://platform.torc.dev/?a=1#/jobs/matches/deadbeef-", ""),
    ("workatastartup", "https://www.workatastartup.com/jobs/", "?page=0&z=2"),
    ("wellfound", "https://wellfound.com/company/acme/jobs/", "-dev?utm=1#x"),
    ("revelo", "https://careers.revelo.com/jobs/", "/"),
)


def v_links(spark, sf_dir):
    """Pages under the address shapes of the job boards, next to their own address."""
    pages = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % (len(LINK_SHAPES) + 1)
    site, href = F.lit("other"), F.col("url")
    for i, (name, before, after) in enumerate(LINK_SHAPES):
        site = F.when(kind == i, name).otherwise(site)
        made = F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(after))
        href = F.when(kind == i, made).otherwise(href)
    return pages.select(F.col("page_id").alias("row_seq"), "url", site.alias("site"), href.alias("href"), "html")


_kind = f"page_id % {len(LINK_SHAPES) + 1}"
_sites = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(LINK_SHAPES))
_hrefs = " ".join(
    f"WHEN {i} THEN '{b}' || CAST(page_id AS VARCHAR) || '{a}'" for i, (_, b, a) in enumerate(LINK_SHAPES)
)
view_sql(
    "v_links",
    f"""SELECT page_id AS row_seq, url, CASE {_kind} {_sites} ELSE 'other' END AS site,
      CASE {_kind} {_hrefs} ELSE url END AS href, html FROM pages""",
)

# --- phrases composed from event numbers ---------------------------------------


def v_phrases(spark, sf_dir):
    """Short posting phrases built from the event columns."""
    n = F.col("user_id").cast("string")
    kind = F.col("event_id") % 12
    age = F.concat(n, F.lit(" days ago"))
    shapes = [
        F.concat(F.lit("Posted "), n, F.lit(" Days  ago")),
        F.concat(n, F.lit(" weeks ago")),
        F.concat(n, F.lit(" months ago")),
        F.concat(n, F.lit(" yrs ago")),
        F.concat((F.col("user_id") % 12).cast("string"), F.lit("wks ago")),
        F.lit("a moment ago"),
        F.date_format("ts", "yyyy-MM-dd"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")),
        F.concat(F.lit("December "), (F.col("user_id") % 31 + 1).cast("string"), F.lit(", 2023")),
        F.concat((F.col("user_id") % 31).cast("string"), F.lit("/"), (F.col("event_id") % 13).cast("string"), F.lit("/2023")),
        F.lit("not a date"),
        F.lit(""),
    ]
    for i, shape in enumerate(shapes):
        age = F.when(kind == i, shape).otherwise(age)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_seq"),
        F.col("user_id").alias("num"),
        F.col("event_type").alias("word"),
        F.col("value").alias("amount"),
        F.col("ts").alias("ts"),
        age.alias("posted"),
    )


view_sql(
    "v_phrases",
    """SELECT event_id AS row_seq, user_id AS num, event_type AS word, value AS amount, ts,
      CASE event_id % 12
        WHEN 0 THEN 'Posted ' || CAST(user_id AS VARCHAR) || ' Days  ago'
        WHEN 1 THEN CAST(user_id AS VARCHAR) || ' weeks ago'
        WHEN 2 THEN CAST(user_id AS VARCHAR) || ' months ago'
        WHEN 3 THEN CAST(user_id AS VARCHAR) || ' yrs ago'
        WHEN 4 THEN CAST(user_id % 12 AS VARCHAR) || 'wks ago'
        WHEN 5 THEN 'a moment ago'
        WHEN 6 THEN strftime(ts, '%Y-%m-%d')
        WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z'
        WHEN 8 THEN 'December ' || CAST(user_id % 31 + 1 AS VARCHAR) || ', 2023'
        WHEN 9 THEN CAST(user_id % 31 AS VARCHAR) || '/' || CAST(event_id % 13 AS VARCHAR) || '/2023'
        WHEN 10 THEN 'not a date'
        WHEN 11 THEN '' END AS posted FROM events""",
)

# --- stored jobs ----------------------------------------------------------------


def v_jobs(spark, sf_dir):
    """Orders as stored job documents."""
    k = F.col("row_seq")
    return v_status(spark, sf_dir).select(
        "row_seq",
        F.col("JobId").alias("job_id"),
        F.concat(F.lit("x"), F.col("JobId")).alias("external_job_id"),
        F.when(F.col("source_id") == "src0", " ").otherwise(F.col("source_id")).alias("source_id"),
        F.col("JobRateDesc").alias("title"),
        F.col("source_id").alias("company"),
        F.when(k % 4 == 0, "Remote ").otherwise("Lima").alias("location"),
        F.array(F.lit("Go"), F.col("source_id"), F.lit(" ")).alias("tags"),
        F.concat_ws(" ", F.lit("role"), F.col("JobRateDesc")).alias("description"),
        F.concat(F.lit("https://j.example.com/"), F.col("JobId")).alias("canonical_url"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://a.example.com/"), F.col("JobId"))).alias("apply_url"),
        F.floor(k / 100).cast("string").alias("scrape_run_id"),
        (k % 3 == 0).alias("is_new"),
        F.col("LoadDttm").alias("first_seen_at"),
        (F.col("LoadDttm") + F.make_dt_interval((k % 5).cast("int"))).alias("last_seen_at"),
        F.trim("Status").alias("status"),
        (6 - F.col("JobRateNum").cast("int")).alias("rate_num"),
        F.col("JobRateDesc").alias("rate_reason"),
        F.col("RatedModelName").alias("rate_provider"),
        F.when(k % 6 == 0, "2024-01-01").otherwise("").alias("notified_at"),
        F.lit("rated").alias("pipeline_stage"),
        (k % 3).cast("int").alias("normalize_version"),
        (k % 4).cast("int").alias("rate_version"),
    )


view_sql(
    "v_jobs",
    """SELECT row_seq, JobId AS job_id, 'x' || JobId AS external_job_id,
      CASE WHEN source_id = 'src0' THEN ' ' ELSE source_id END AS source_id, JobRateDesc AS title, source_id AS company,
      CASE WHEN row_seq % 4 = 0 THEN 'Remote ' ELSE 'Lima' END AS location, ['Go', source_id, ' '] AS tags,
      'role ' || JobRateDesc AS description, 'https://j.example.com/' || JobId AS canonical_url,
      CASE WHEN row_seq % 3 = 0 THEN '' ELSE 'https://a.example.com/' || JobId END AS apply_url,
      CAST(row_seq // 100 AS VARCHAR) AS scrape_run_id, row_seq % 3 = 0 AS is_new, LoadDttm AS first_seen_at,
      LoadDttm + to_days(CAST(row_seq % 5 AS INTEGER)) AS last_seen_at, trim(Status) AS status,
      6 - CAST(JobRateNum AS INTEGER) AS rate_num, JobRateDesc AS rate_reason, RatedModelName AS rate_provider,
      CASE WHEN row_seq % 6 = 0 THEN '2024-01-01' ELSE '' END AS notified_at, 'rated' AS pipeline_stage,
      CAST(row_seq % 3 AS INTEGER) AS normalize_version, CAST(row_seq % 4 AS INTEGER) AS rate_version
    FROM v_status""",
    ("v_status",),
)


def v_notifications(spark, sf_dir):
    """Events as notifications about jobs."""
    return v_events(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"),
        F.when(F.col("event_type") == "view", "sent").when(F.col("event_type") == "click", "queued").otherwise("blocked").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "chat1").otherwise("chat2").alias("target_chat_id"),
        F.col("created_at").alias("sent_at"),
    )


view_sql(
    "v_notifications",
    """SELECT CAST(job_id AS VARCHAR) AS job_id,
      CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'queued' ELSE 'blocked' END AS status,
      CASE WHEN event_id % 2 = 0 THEN 'chat1' ELSE 'chat2' END AS target_chat_id, created_at AS sent_at FROM v_events""",
    ("v_events",),
)


def v_actions(spark, sf_dir):
    """Reviews as user actions on jobs; some name jobs that do not exist."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_seq"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("gone"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("job_id"),
        F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "apply").otherwise("later").alias("action"),
        (F.col("doc_id") % 7).cast("string").alias("telegram_user_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("created_at"),
    )


view_sql(
    "v_actions",
    """SELECT doc_id AS row_seq, CASE WHEN doc_id % 10 = 0 THEN 'gone' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS job_id,
      CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'apply' ELSE 'later' END AS action,
      CAST(doc_id % 7 AS VARCHAR) AS telegram_user_id,
      TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) AS created_at FROM labels""",
)


def v_runs(spark, sf_dir):
    """Line items as scrape runs of the suppliers."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_seq"),
        F.concat(F.lit("src"), F.col("l_suppkey").cast("string")).alias("source_id"),
        (F.col("l_returnflag") != "R").alias("success"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("finished_at"),
        F.col("l_shipdate").alias("started_at"),
        F.col("l_quantity").alias("quantity"),
    )


view_sql(
    "v_runs",
    """SELECT l_orderkey * 10 + l_linenumber AS row_seq, 'src' || CAST(l_suppkey AS VARCHAR) AS source_id,
      l_returnflag <> 'R' AS success, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS finished_at,
      l_shipdate AS started_at, l_quantity AS quantity FROM lineitem""",
)
