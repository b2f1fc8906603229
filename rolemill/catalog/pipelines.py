"""Rating, routing and pipeline jobs, and the reading of model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemill.catalog import sqltext as q
from rolemill.catalog.registry import query
from rolemill.catalog.relational import (
    COMPANY_TERMS,
    DENY,
    STACK_TERMS,
    UPDATES_SQL,
    _active_sql,
    _app_side,
    _due_sql,
    _hash,
    _keyed,
    _lease_keyed,
    _loc,
    _main,
    _match_keys,
    _priority,
    _session,
    _side,
    _three,
    at,
    leases_view,
    runtime_config,
    sql_stamp,
    stamp,
    updates_view,
)
from rolemill.catalog.views import (
    table,
    v_actions,
    v_events,
    v_history,
    v_jobs,
    v_notifications,
    v_postings,
    v_runs,
    v_stack,
    v_status,
    view_sql,
    with_views,
)
from rolemill.functions import keys as K
from rolemill.functions import responses, text
from rolemill.operators import filters, joins, moves, schema
from rolemill.operators.settings import Settings
from rolemill.operators.winners import mark
from rolemill.plans import answers as A
from rolemill.plans import cloud, leases, load, marts, pipeline, rate, store
from rolemill.session import new_folder, written

NOW = "2024-05-01 09:00:00"

# --- answers -----------------------------------------------------------------


def v_answers(spark, sf):
    """Assistant turns as model answers in the forms a model gives them."""
    k, n = F.col("conv_id") % 6, F.col("conv_id") % 11
    body = F.to_json(F.struct(n.alias("rate"), F.col("text").alias("explanation"), F.lit(" short ").alias("job_short_desc")))
    num = n.cast("string")
    shaped = (
        F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("My take\nRate : "), num, F.lit("\n* first point\n•second")))
        .when(k == 2, F.concat(F.lit(" "), num, F.lit(" \n\n because  of it ")))
        .when(k == 3, F.regexp_replace("text", r"[\d{}:]", ""))
        .when(k == 4, F.lit('{"rate": 11, "explanation": "x"}\nRATE: 4'))
        .otherwise("")
    )
    return table(spark, sf, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_seq"), "conv_id", k.alias("k"), n.alias("n"), "text", shaped.alias("answer")
    )


view_sql(
    "v_answers",
    "SELECT conv_id * 1000 + turn AS row_seq, conv_id, conv_id % 6 AS k, conv_id % 11 AS n, text FROM conversations WHERE role = 'assistant'",
)


@query(
    "parse_rate_response",
    with_views("v_answers")
    + f"""SELECT row_seq, k IN (0, 1, 2, 4) AS success, CASE WHEN k IN (0, 1, 2) THEN n WHEN k = 4 THEN 4 END AS rate_num,
      CASE k WHEN 0 THEN {q.trim('text')} WHEN 1 THEN '- first point' || chr(10) || '- second' WHEN 2 THEN 'because  of it' WHEN 4 THEN 'No description provided' END AS rate_desc,
      CASE k WHEN 0 THEN 'short' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 4 THEN '' END AS short_desc,
      CASE k WHEN 3 THEN 'Could not extract valid rate (0-10) from response. Response: ' || substr(regexp_replace(text, '[0-9{{}}:]', '', 'g'), 1, 100)
        WHEN 5 THEN 'Empty or invalid response' ELSE '' END AS error FROM v_answers""",
)
def parse_rate_response(spark, sf):
    return v_answers(spark, sf).select("row_seq", responses.parse_rate("answer").alias("r")).select("row_seq", "r.*")


def _extract_answers(spark, sf):
    k = F.col("row_seq") % 4
    full = F.to_json(
        F.struct(F.split("JobTitle", " ").alias("JobTop3Stack"), F.array("JobLocation", F.lit(" ")).alias("JobTop3Want"), F.lit(" REMOTE").alias("JobWorkMode"))
    )
    single = F.to_json(F.struct(F.col("JobTitle").alias("JobTop3Stack"), F.lit("x").alias("JobWorkMode")))
    shaped = F.when(k == 0, F.concat(F.lit("```json\n"), full, F.lit("```"))).when(k == 1, F.concat(F.lit("so: "), single, F.lit(" ok"))).when(k == 2, "none").otherwise("{broken}")
    return v_stack(spark, sf).withColumns({"k": k, "answer": shaped})


_words = "array_to_string((list_filter(string_split(JobTitle, ' '), lambda t: t <> '') || ['Unknown', 'Unknown'])[1:3], ' | ')"


@query(
    "parse_extract_response",
    with_views("v_stack")
    + f"""SELECT row_seq, row_seq % 4 < 2 AS success, CASE row_seq % 4 WHEN 0 THEN {_words} WHEN 1 THEN JobTitle || ' | Unknown | Unknown' ELSE 'Unknown | Unknown | Unknown' END AS stack,
      CASE WHEN row_seq % 4 = 0 THEN JobLocation || ' | Unknown | Unknown' ELSE 'Unknown | Unknown | Unknown' END AS want, CASE WHEN row_seq % 4 = 0 THEN 'Remote' ELSE 'Unknown' END AS mode,
      CASE row_seq % 4 WHEN 2 THEN 'No JSON object found' WHEN 3 THEN 'Parse error' ELSE '' END AS error FROM v_stack""",
)
def parse_extract_response(spark, sf):
    parsed = _extract_answers(spark, sf).select("row_seq", responses.parse_extract("answer").alias("r"))
    return parsed.select(
        "row_seq", "r.success", F.array_join("r.top3_stack", " | ").alias("stack"), F.array_join("r.top3_want", " | ").alias("want"), F.col("r.work_mode").alias("mode"), "r.error"
    )


def _final_answers(spark, sf):
    """Final ratings in every form, built around the assistant texts."""
    df = v_answers(spark, sf)
    lease = F.concat(F.lit("L-"), F.col("row_seq").cast("string"))
    k = F.col("row_seq") % 8
    start = F.when(k == 1, "").when(k == 2, "LRateLeaseId=other\n").otherwise(F.concat(F.lit("LRateLeaseId = "), lease, F.lit("\r\n")))
    num = (F.col("conv_id") % 6).cast("string")
    mid = F.when(k == 3, "JobRateNum=4-5\n").when(k == 4, "JobRateNum= nine\n").otherwise(F.concat(F.lit("JobRateNum: "), num, F.lit("\n")))
    flat = text.collapse("text")
    tail = F.concat(F.lit(" — "), flat, F.lit("\n \nЧего на  самом деле ХОТЯТ: людей\n\n"))
    end = F.when(k == 5, "").when(k == 6, "LRateResponseComplete=zzz").otherwise(F.concat(F.lit("LRateResponseComplete: "), lease))
    return df.withColumns({"lease_id": lease, "answer": F.when(k == 7, " \n").otherwise(F.concat(start, mid, tail, end)), "num": (F.col("conv_id") % 6)})


@query(
    "parse_lrate_response",
    with_views("v_answers")
    + f"""SELECT row_seq, CASE WHEN row_seq % 8 = 0 THEN 'L-' || CAST(row_seq AS VARCHAR) END AS lease, CASE WHEN row_seq % 8 = 0 THEN conv_id % 6 END AS rate_num,
      CASE WHEN row_seq % 8 = 0 THEN {q.collapse('text')} END AS short_desc, CASE WHEN row_seq % 8 = 0 THEN 'людей' END AS want,
      CASE row_seq % 8 WHEN 0 THEN '' WHEN 1 THEN 'Could not parse LRateLeaseId in format LRateLeaseId[:|=]<id>' WHEN 2 THEN 'LRateLeaseId mismatch'
        WHEN 3 THEN 'Could not parse JobRateNum in format JobRateNum[:|=]<0..5>' WHEN 4 THEN 'Could not parse JobRateNum in format JobRateNum[:|=]<0..5>'
        WHEN 5 THEN 'Could not parse final LRateResponseComplete line' WHEN 6 THEN 'LRateResponseComplete mismatch' ELSE 'Empty LRate response' END AS error FROM v_answers""",
)
def parse_lrate_response(spark, sf):
    parsed = _final_answers(spark, sf).select("row_seq", responses.parse_final("answer", "lease_id").alias("r"))
    return parsed.select("row_seq", F.col("r.lease_id").alias("lease"), "r.rate_num", "r.short_desc", F.col("r.top3_want").alias("want"), "r.error")


@query(
    "numbered_sections",
    with_views("v_answers")
    + f"""SELECT row_seq, 1 AS num, {q.collapse('text')} AS body FROM v_answers WHERE {q.collapse('text')} <> ''
      UNION ALL SELECT row_seq, 2, 'last' FROM v_answers WHERE k <> 0 UNION ALL SELECT row_seq, 12, 'x y' FROM v_answers WHERE k <> 0""",
)
def numbered_sections(spark, sf):
    plain = text.collapse("text")
    marked = F.concat(F.lit("intro\n **1) "), plain, F.lit("\n# 2. first\n- 12: x y\n2) last"))
    shaped = F.when(F.col("k") == 0, F.concat(F.lit("  "), plain)).otherwise(marked)
    rows = v_answers(spark, sf).select("row_seq", F.explode(responses.numbered_sections(shaped)).alias("s"))
    return rows.select("row_seq", "s.num", "s.body").filter("body <> ''")


# --- staging and load ----------------------------------------------------------


@query(
    "validate_stage",
    with_views("v_postings")
    + """SELECT 'good' AS side, row_seq, 'Approved' AS Status, CAST(NULL AS BIGINT) AS first_bad FROM v_postings
      UNION ALL SELECT 'bad', row_seq, CASE WHEN row_seq % 50 = 7 THEN 'Odd' WHEN row_seq % 2 = 0 THEN 'Staged' ELSE ' Approved' END, 7 FROM v_postings""",
)
def validate_stage(spark, sf):
    rows = v_postings(spark, sf).select("row_seq", F.when(F.col("row_seq") % 2 == 0, "Staged").otherwise("Approved").alias("Status"))
    odd = rows.withColumn("Status", F.when(F.col("row_seq") % 50 == 7, "Odd").when(F.col("row_seq") % 2 == 0, "Staged").otherwise(" Approved"))
    good = load.validate_stage(rows).withColumn("side", F.lit("good"))
    return good.union(load.validate_stage(odd).withColumn("side", F.lit("bad"))).select("side", "row_seq", "Status", "first_bad")


def _fresh(alias: str = "k") -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY row_seq) AS rn FROM ({_keyed} v_postings)) "
        f"WHERE job_key IS NULL OR (rn = 1 AND job_key NOT IN (SELECT job_key FROM ({_keyed} v_history) WHERE job_key IS NOT NULL))) {alias}"
    )


@query(
    "increment_load",
    with_views("v_history", "v_postings") + f"SELECT row_seq, JobId, JobUrl, JobTitle, 'Loaded' AS Status, '{NOW}' AS loaded FROM {_fresh()}",
)
def increment_load(spark, sf):
    stage = v_postings(spark, sf).select("row_seq", "JobId", "JobUrl", "JobTitle", F.lit(" Approved").alias("Status"))
    new = load.increment_load(stage, v_history(spark, sf), as_of=at(NOW))
    return new.select("row_seq", "JobId", "JobUrl", "JobTitle", "Status", stamp("LoadDttm").alias("loaded"))


@query(
    "loads_log",
    with_views("v_history", "v_postings")
    + f"""SELECT 'NewJobs' AS HistSheetName, '{NOW}' AS StartDttm, '{NOW}' AS EndDttm, (SELECT count(*) FROM v_postings) AS StageRowsTotal, count(*) AS NewCount,
      (SELECT count(*) FROM v_postings) - count(*) AS DoubleCount, count(*) AS LoadedCount, true AS SuccessFlag, '' AS FailAtRowNum FROM {_fresh()}
      UNION ALL SELECT 'Broken', '{NOW}', '{NOW}', count(*), 0, 0, 0, false, CAST(min(row_seq) FILTER (WHERE row_seq % 97 = 5) AS VARCHAR) FROM v_postings""",
)
def loads_log(spark, sf):
    """A good load and one of a stage with rows that were rejected."""
    stage = v_postings(spark, sf).select("row_seq", "JobId", "JobUrl", F.lit("Staged").alias("Status"))
    broken = stage.withColumn("Status", F.when(F.col("row_seq") % 97 == 5, "Broken").otherwise("Staged"))
    rows = []
    for rows_in, target in ((stage, "NewJobs"), (broken, "Broken")):
        folder = new_folder(spark, "loaded")
        rows.append(load.logged_load(load.validate_stage(rows_in), v_history(spark, sf), folder=folder, as_of=at(NOW), started=at(NOW), ended=at(NOW), target=target))
    return rows[0].unionByName(rows[1])


@query(
    "append_stage",
    with_views("v_postings") + "SELECT row_seq, JobTitle, JobUrl, '' AS JobSalary, 'Staged' AS Status, CASE WHEN JobId = '' THEN 'main' ELSE source_id END AS ScrapePageName FROM v_postings",
)
def append_stage(spark, sf):
    rows = v_postings(spark, sf).withColumn("ScrapePageName", F.when(F.col("JobId") == "", "").otherwise(F.col("source_id")))
    return load.append_stage(rows, ["row_seq", "JobTitle", "JobUrl", "JobSalary", "Status", "ScrapePageName"], "main")


@query(
    "scrape_to_stage",
    with_views("v_history", "v_postings", "v_pages")
    + f""", j AS (SELECT *, {_session} AS sk FROM v_postings WHERE {_session} IS NOT NULL),
      m AS (SELECT source_id, sk, min(row_seq) AS row_seq, {', '.join(f"coalesce(arg_min({c}, row_seq) FILTER (WHERE {c} <> ''), '') AS {c}" for c in ('JobId', 'JobUrl', 'JobTitle'))} FROM j GROUP BY 1, 2),
      o AS (SELECT * FROM m WHERE row_seq IN (SELECT min(row_seq) FROM m GROUP BY sk)),
      h AS (SELECT DISTINCT key FROM ({_three} v_history) WHERE key <> '')
      SELECT o.row_seq, o.JobId, o.JobUrl, 'Staged' AS Status, o.source_id AS ScrapePageName, CASE WHEN o.row_seq % 2 = 0 THEN 'Detail ' || CAST(o.row_seq AS VARCHAR) ELSE o.JobTitle END AS JobTitle, '' AS JobSalary FROM o
      WHERE NOT EXISTS (SELECT 1 FROM ({_three} o) x WHERE x.row_seq = o.row_seq AND x.key IN (SELECT key FROM h))""",
)
def scrape_to_stage(spark, sf):
    jobs = v_postings(spark, sf).select("row_seq", "JobId", "JobUrl", "JobTitle", F.col("source_id").alias("ScrapePageName"))
    keyed = jobs.withColumn("session_key", K.session_key("JobId", "JobUrl")).groupBy("session_key").agg(F.min("row_seq").alias("n"))
    title = F.when(F.col("n") % 2 == 0, F.concat(F.lit("Detail "), F.col("n").cast("string"))).otherwise(" ")
    details = keyed.select("session_key", title.alias("JobTitle"))
    return load.scrape_to_stage(jobs, details, v_history(spark, sf), header=["row_seq", "JobId", "JobUrl", "Status", "ScrapePageName", "JobTitle", "JobSalary"])


# --- rating ---------------------------------------------------------------------


def _empty_rated(df, status):
    blank = {"JobRateDesc": F.lit(""), "JobRateShortDesc": F.lit("old"), "RatedModelName": F.lit(""), "JobRateNum": F.lit(None).cast("double")}
    return df.withColumns({**blank, "JobRateDttm": F.lit(None).cast("timestamp_ntz"), "Status": status})


@query(
    "simple_rate",
    with_views("v_postings")
    + r"""SELECT row_seq, CASE WHEN NOT mine THEN 'Approved' WHEN denied THEN '2Delete' ELSE '2MARate' END AS Status, CASE WHEN mine THEN CASE WHEN denied THEN 0 ELSE 5 END END AS rate,
      CASE WHEN NOT mine THEN '' WHEN denied THEN 'Title matched deny regex' ELSE 'Title passed deny regex' END AS desc_text, CASE WHEN mine THEN 'TitleRegex' ELSE '' END AS model, CASE WHEN mine THEN '' ELSE 'old' END AS short_desc
      FROM (SELECT row_seq, row_seq % 3 <> 0 AS mine, regexp_matches(JobTitle, '(?i)\b(the|qui|license)\b|^un') AS denied FROM v_postings)""",
)
def simple_rate(spark, sf):
    df = _empty_rated(v_postings(spark, sf), F.when(F.col("row_seq") % 3 != 0, "Loaded").otherwise("Approved"))
    out = rate.simple_rate(df, DENY, at(NOW))
    return out.select("row_seq", "Status", F.col("JobRateNum").alias("rate"), F.col("JobRateDesc").alias("desc_text"), F.col("RatedModelName").alias("model"), F.col("JobRateShortDesc").alias("short_desc"))


@query(
    "medium_a_rate",
    with_views("v_stack")
    + f""", s AS (SELECT *, row_seq % 5 <> 0 AS mine, CASE WHEN row_seq % 4 = 0 THEN 'kept' ELSE '' END AS d FROM v_stack),
      w AS (SELECT row_seq, row_number() OVER (PARTITION BY {q.key('JobCompany')}, {q.key('JobTitle')} ORDER BY {_loc} DESC, row_seq) = 1 AS win FROM s WHERE mine)
      SELECT s.row_seq, CASE WHEN NOT mine THEN 'Other' WHEN win THEN '2MBrate' ELSE '2Delete' END AS Status, CASE WHEN NOT mine OR win THEN d WHEN d = '' THEN 'Location DBL' ELSE d || '; Location DBL' END AS desc_text
      FROM s LEFT JOIN w ON s.row_seq = w.row_seq""",
)
def medium_a_rate(spark, sf):
    k = F.col("row_seq")
    df = v_stack(spark, sf).withColumns({"Status": F.when(k % 5 == 0, "Other").when(k % 5 == 1, "2Mrate").otherwise("2MARate"), "JobRateDesc": F.when(k % 4 == 0, "kept").otherwise("")})
    return rate.medium_a_rate(df).select("row_seq", "Status", F.col("JobRateDesc").alias("desc_text"))


@query(
    "medium_b_rate",
    with_views("v_stack")
    + f"""SELECT row_seq, CASE WHEN done THEN '2MCRate' ELSE '2MBrate' END AS Status, CASE WHEN NOT done THEN 'old' WHEN k = 0 THEN {_words} ELSE JobTitle || ' | Unknown | Unknown' END AS stack,
      CASE WHEN NOT done THEN 'old' WHEN k = 0 THEN 'Remote' ELSE 'Unknown' END AS mode, CASE WHEN row_seq % 7 = 0 THEN 'FAILED_ALL' WHEN done THEN 'm1' ELSE 'FAILED_PARSE' END AS model
      FROM (SELECT *, row_seq % 4 AS k, row_seq % 4 < 2 AND row_seq % 7 <> 0 AS done FROM v_stack)""",
)
def medium_b_rate(spark, sf):
    base = v_stack(spark, sf).drop("JobTop3Stack")
    old = F.lit("old")
    df = _empty_rated(base, F.lit("2MBrate")).withColumns({"JobTop3Stack": old, "JobTop3Want": old, "JobWorkMode": old})
    given = _extract_answers(spark, sf).select(
        "row_seq", F.when(F.col("row_seq") % 7 == 0, "FAILED_ALL").otherwise("ok").alias("outcome"), F.col("answer").alias("response"), F.lit("m1").alias("model")
    )
    out = A.medium_b_rate(df, given, at(NOW))
    return out.select("row_seq", "Status", F.col("JobTop3Stack").alias("stack"), F.col("JobWorkMode").alias("mode"), F.col("RatedModelName").alias("model"))


@query(
    "medium_c_rate",
    with_views("v_stack")
    + f""", i AS (SELECT row_seq, pos, string_split(JobTop3Stack, ' | ')[pos] AS item FROM v_stack, range(1, 10) t(pos) WHERE pos <= len(string_split(JobTop3Stack, ' | '))),
      t AS (SELECT unnest({list(STACK_TERMS)}) AS term, unnest(range({len(STACK_TERMS)})) AS tpos),
      h AS (SELECT row_seq, arg_min(term, rank) AS term, arg_min(item, rank) AS item FROM (SELECT row_seq, item, term, pos * 100 + tpos AS rank FROM (SELECT *, {q.stack('item')} AS si, {q.stack('term')} AS st FROM i, t)
        WHERE CASE WHEN contains(st, ' ') THEN contains(si, st) ELSE list_contains(string_split(si, ' '), st) OR (length(st) <= 3 AND replace(si, ' ', '') = st) END) GROUP BY 1),
      r AS (SELECT v.row_seq, v.size % 4 AS m, list_filter([
          CASE WHEN h.term IS NOT NULL THEN 'StackNegative hit "' || h.term || '" in "' || h.item || '"' END,
          CASE WHEN contains(lower(JobCompany), 'brand 2') OR JobCompany = 'Brand#1' THEN 'CompanyNegative hit "' || CASE WHEN JobCompany = 'Brand#2' OR contains(JobCompany, 'Brand#2') THEN 'brand#2' ELSE '#1' END || '" in "' || JobCompany || '"'
            WHEN contains(JobCompany, 'Brand#2') THEN 'CompanyNegative hit "brand#2" in "' || JobCompany || '"' WHEN contains({q.company('JobCompany')}, 'brand 7') THEN 'CompanyNegative hit "Brand 7" in "' || JobCompany || '"' END,
          CASE WHEN size % 4 = 1 THEN 'JobWorkMode=Onsite' WHEN size % 4 = 2 THEN 'JobWorkMode=Hybrid' END,
          CASE WHEN size BETWEEN 3 AND 9 THEN 'JobPostedDttm rule ago+weeks(3-9) in "' || CAST(size AS VARCHAR) || ' weeks ago"' END], lambda x: x IS NOT NULL) AS reasons
        FROM v_stack v LEFT JOIN h ON v.row_seq = h.row_seq)
      SELECT row_seq, CASE WHEN len(reasons) > 0 THEN '2Delete' ELSE '2LRate' END AS Status, CASE WHEN len(reasons) > 0 THEN 'Medium CRate: ' || array_to_string(reasons, '; ')
        ELSE 'Medium CRate: no StackNegative/CompanyNegative hit; JobWorkMode=' || CASE m WHEN 0 THEN 'Remote' ELSE 'Unknown' END END AS desc_text FROM r""".replace(
        "JobCompany = 'Brand#1'", "false"
    ),
)
def medium_c_rate(spark, sf):
    m = F.col("size") % 4
    df = v_stack(spark, sf).withColumns(
        {
            "Status": F.lit("2MCRate"),
            "JobRateDesc": F.lit(""),
            "JobWorkMode": F.when(m == 0, "remote ").when(m == 1, "Onsite").when(m == 2, "HYBRID").otherwise("any"),
            "JobPostedDttm": F.concat(F.col("size").cast("string"), F.lit(" weeks ago")),
        }
    )
    return rate.medium_c_rate(df, STACK_TERMS, COMPANY_TERMS, at(NOW)).select("row_seq", "Status", F.col("JobRateDesc").alias("desc_text"))


@query(
    "l_rate_apply",
    with_views("v_answers")
    + f"""SELECT row_seq, CASE WHEN row_seq % 8 <> 0 THEN '2LRate' WHEN conv_id % 6 > 2 THEN '2Apply' ELSE '2Delete' END AS Status,
      CASE WHEN row_seq % 8 = 0 THEN conv_id % 6 END AS rate, CASE WHEN row_seq % 8 = 0 THEN {q.collapse('text')} ELSE 'old' END AS short_desc,
      CASE WHEN row_seq % 8 = 0 THEN 'saved' ELSE 'failed' END AS state FROM v_answers""",
)
def l_rate_apply(spark, sf):
    given = _final_answers(spark, sf)
    rows = _empty_rated(given.select("row_seq"), F.lit("2LRate")).withColumns(
        {"stable_key": F.concat(F.lit("id|"), F.col("row_seq").cast("string")), "snapshot_hash": F.sha2(F.col("row_seq").cast("string"), 256), "JobTop3Want": F.lit(""), "LoadDttm": F.lit(None).cast("timestamp_ntz")}
    )
    held = rows.select(F.concat(F.lit("L-"), F.col("row_seq").cast("string")).alias("lease_id"), "stable_key", "snapshot_hash")
    out, states = A.l_rate_apply(rows, held, given.select("lease_id", F.col("answer").alias("response")), at(NOW), reset_load_time=True)
    by_row = states.select(F.substring_index("lease_id", "-", -1).cast("long").alias("row_seq"), "state")
    return out.join(by_row, "row_seq").select("row_seq", "Status", F.col("JobRateNum").alias("rate"), F.col("JobRateShortDesc").alias("short_desc"), "state")


_hay = f"lower(JobTitle || ' ' || JobLocation || ' ' || JobTags || ' ' || JobDescription || ' ')"


@query(
    "keyword_rate",
    with_views("v_postings")
    + f"""SELECT row_seq, CASE WHEN deny <> '' THEN 1 WHEN target <> '' THEN 4 ELSE 3 END AS rate_num, CASE WHEN deny <> '' THEN '2Delete' WHEN target <> '' THEN '2Apply' ELSE 'new' END AS status,
      CASE WHEN deny <> '' THEN 'Deny keywords: ' || deny WHEN target <> '' THEN 'Target keywords: ' || target ELSE 'No target keywords matched' END AS rate_reason
      FROM (SELECT row_seq, array_to_string(list_filter(['license', 'qui'], lambda w: contains({_hay}, w)), ', ') AS deny, array_to_string(list_filter(['with', 'zzz', 'the'], lambda w: contains({_hay}, w)), ', ') AS target FROM v_postings)""",
)
def keyword_rate(spark, sf):
    jobs = v_postings(spark, sf).select(
        "row_seq", F.col("JobTitle").alias("title"), F.col("JobLocation").alias("location"), F.array("JobTags").alias("tags"), F.col("JobDescription").alias("description"), F.lit("").alias("enrich_summary")
    )
    return rate.keyword_rate(jobs, ("license", "qui"), ("with", "zzz", "the")).select("row_seq", "rate_num", "status", "rate_reason")


@query(
    "normalize_stage",
    with_views("v_jobs")
    + f"""SELECT job_id, CASE WHEN normalize_version < 2 THEN {q.key('title')} END AS normalized_title, CASE WHEN normalize_version < 2 THEN {q.key('location')} END AS normalized_location,
      CASE WHEN normalize_version < 2 THEN {q.key("coalesce(nullif(apply_url, ''), canonical_url)")} END AS normalized_apply_url, greatest(normalize_version, 2) AS normalize_version,
      CASE WHEN normalize_version < 2 THEN 'normalized' ELSE 'rated' END AS pipeline_stage,
      CASE WHEN normalize_version < 2 THEN sha256({q.key('title')} || '|' || {q.key('company')} || '|' || {q.key('location')} || '|' || {q.key("coalesce(nullif(apply_url, ''), canonical_url)")}) END AS dedupe_key FROM v_jobs""",
)
def normalize_stage(spark, sf):
    out = rate.normalize_stage(v_jobs(spark, sf), 2)
    return out.select("job_id", "normalized_title", "normalized_location", "normalized_apply_url", "normalize_version", "pipeline_stage", "dedupe_key")


@query(
    "enrich_stage",
    with_views("v_jobs")
    + f"""SELECT job_id, 'go;' || lower(company) AS keywords, {q.infer_work_mode('location', 'description')} AS work_mode_hint,
      'Tags: go, ' || company || CASE WHEN contains(location, 'Remote') THEN ' | WorkMode: Remote' WHEN contains(description, 'Onsite') THEN ' | WorkMode: Onsite' ELSE '' END AS enrich_summary, 'enriched' AS pipeline_stage FROM v_jobs""",
)
def enrich_stage(spark, sf):
    out = rate.enrich_stage(v_jobs(spark, sf).withColumns({"enrich_version": F.lit(0), "tags": F.array(F.lit("Go"), F.col("company"), F.lit(" "))}), 1)
    return out.select("job_id", F.array_join("enrich_keywords", ";").alias("keywords"), "work_mode_hint", "enrich_summary", "pipeline_stage")


# --- job store --------------------------------------------------------------------


def scrape_results(spark, sf, rows=None):
    rows = v_postings(spark, sf) if rows is None else rows
    return rows.select(
        "row_seq", "source_id", F.concat(F.lit("run-"), "source_id").alias("run_id"), F.col("JobId").alias("external_job_id"), F.col("JobUrl").alias("job_url"), F.col("JobApplyUrl").alias("job_apply_url"),
        F.col("JobTitle").alias("job_title"), F.col("JobCompany").alias("job_company"), F.col("JobLocation").alias("job_location"), F.split("JobTags", ",").alias("job_tags"), F.col("JobDescription").alias("job_description"),
    )


def stored_jobs(spark, sf):
    """Labelled postings as the store before a run."""
    old = cloud.result_jobs(scrape_results(spark, sf, v_history(spark, sf)))
    return old.drop("row_seq").withColumns(
        {"first_seen_at": at("2024-01-01"), "last_seen_at": at("2024-01-01"), "is_new": F.lit(True), "status": F.lit("2Apply"), "rate_num": F.lit(4), "scrape_run_id": F.lit("run-0"), "pipeline_version": F.lit(3)}
    )


_stored = f"SELECT DISTINCT {_hash} AS job_id FROM v_history"
_batch = f"SELECT {_hash} AS job_id, min(row_seq) AS row_seq FROM v_postings GROUP BY 1"


@query(
    "upsert_jobs",
    with_views("v_history", "v_postings")
    + f""", o AS ({_stored}), b AS ({_batch})
      SELECT b.job_id, o.job_id IS NULL AS is_new, CASE WHEN o.job_id IS NULL THEN '{NOW}' ELSE '2024-01-01 00:00:00' END AS first_seen, '{NOW}' AS last_seen, CASE WHEN o.job_id IS NULL THEN 'new' ELSE '2Apply' END AS status,
        CASE WHEN o.job_id IS NULL THEN 0 ELSE 4 END AS rate_num, CASE WHEN o.job_id IS NULL THEN 1 ELSE 3 END AS pipeline_version, 'run-' || p.source_id AS run, {q.trim('p.JobTitle')} AS title
      FROM b JOIN v_postings p ON b.row_seq = p.row_seq LEFT JOIN o ON b.job_id = o.job_id""",
)
def upsert_jobs(spark, sf):
    batch = cloud.result_jobs(scrape_results(spark, sf))
    folder, stored = new_folder(spark, "job-store"), stored_jobs(spark, sf)
    store.write(stored, folder, 8)
    store.upsert(folder, stored.schema, batch, at(NOW), 8)
    out = store.read(spark, folder, stored.schema)
    return out.select("job_id", "is_new", stamp("first_seen_at").alias("first_seen"), stamp("last_seen_at").alias("last_seen"), "status", "rate_num", "pipeline_version", F.col("scrape_run_id").alias("run"), "title")


@query(
    "ingest_run",
    with_views("v_history", "v_postings")
    + f""", o AS ({_stored}), b AS ({_batch}) SELECT 'run-' || p.source_id AS run_id, count(*) AS jobs_received, count(*) FILTER (WHERE o.job_id IS NULL) AS jobs_new,
      count(*) FILTER (WHERE o.job_id IS NULL) AS ingested, count(*) FILTER (WHERE o.job_id IS NOT NULL) AS reseen FROM b JOIN v_postings p ON b.row_seq = p.row_seq LEFT JOIN o ON b.job_id = o.job_id GROUP BY 1""",
)
def ingest_run(spark, sf):
    batch, stored = cloud.result_jobs(scrape_results(spark, sf)), stored_jobs(spark, sf)
    marked = written(cloud.mark_known(batch.select("job_id", "source_id", "title", "scrape_run_id"), stored), "ingest")
    runs = marked.select(F.col("scrape_run_id").alias("run_id")).distinct()
    events = cloud.ingest_events(marked, at(NOW)).groupBy("run_id").agg(
        F.count_if(F.col("event_type") == "ingested").alias("ingested"), F.count_if(F.col("event_type") == "reseen").alias("reseen")
    )
    return cloud.run_rows(runs, marked).join(events, "run_id")


@query(
    "requeue_for_rating",
    with_views("v_actions", "v_jobs")
    + "SELECT job_id, CASE WHEN again THEN 'pending' ELSE 'done' END AS rate_status, CASE WHEN again THEN rate_version + 1 ELSE rate_version END AS pipeline_version FROM (SELECT *, job_id IN (SELECT job_id FROM v_actions) AS again FROM v_jobs)",
)
def requeue_for_rating(spark, sf):
    jobs = v_jobs(spark, sf).withColumns({"rate_status": F.lit("done"), "pipeline_version": F.col("rate_version")})
    out, _ = leases.requeue(jobs, v_actions(spark, sf))
    return out.select("job_id", "rate_status", "pipeline_version")


@query(
    "apply_actions",
    with_views("v_actions", "v_jobs")
    + """SELECT j.job_id, coalesce(CASE a.action WHEN 'apply' THEN 'Applied' WHEN 'delete' THEN '2Delete' WHEN 'later' THEN '2Apply' END, j.status) AS status, CASE WHEN a.action = 'apply' THEN 'applied' ELSE 'rated' END AS pipeline_stage
      FROM v_jobs j LEFT JOIN v_actions a ON j.job_id = a.job_id""",
)
def apply_actions(spark, sf):
    out, _, _ = cloud.apply_actions(v_jobs(spark, sf), v_actions(spark, sf))
    return out.select("job_id", "status", "pipeline_stage")


@query(
    "sync_job_states",
    with_views("v_history", "v_postings")
    + f""", u AS ({UPDATES_SQL}), a AS ({_match_keys('u')}), b AS ({_match_keys('v_postings')}),
      m AS (SELECT row_num, max(row_seq) AS u FROM (SELECT a.row_seq, min(b.row_seq) AS row_num FROM a JOIN b ON a.key = b.key GROUP BY 1) GROUP BY 1)
      SELECT p.row_seq, CASE WHEN m.u IS NULL THEN 'old' WHEN m.u % 2 = 0 THEN 'Applied' ELSE 'old' END AS Status, m.u AS JobRateNum, CASE WHEN m.u IS NULL THEN 'd' ELSE 'by ' || CAST(m.u AS VARCHAR) END AS JobRateShortDesc
      FROM v_postings p LEFT JOIN m ON p.row_seq = m.row_num""",
)
def sync_job_states(spark, sf):
    k = F.col("row_seq")
    updates = updates_view(spark, sf).withColumns(
        {"JobRateNum": k, "JobRateDesc": F.concat(F.lit("by "), k.cast("string")), "JobRateShortDesc": F.lit(""), "RatedModelName": F.lit("m"), "Status": F.when(k % 2 == 0, "Applied").otherwise("")}
    )
    rows = v_postings(spark, sf).withColumns({"Status": F.lit("old"), "JobRateNum": F.lit(None).cast("long"), "JobRateDesc": F.lit("d"), "JobRateShortDesc": F.lit("d"), "RatedModelName": F.lit("")})
    return cloud.sync_job_states(rows, updates, at(NOW)).select("row_seq", "Status", "JobRateNum", "JobRateShortDesc")


@query(
    "notify_batch",
    with_views("v_jobs", "v_notifications")
    + f""", c AS (SELECT *, row_number() OVER (ORDER BY row_seq) AS rn FROM v_jobs WHERE rate_num >= 4 AND status = '2Apply' AND notified_at = ''
        AND job_id NOT IN (SELECT job_id FROM v_notifications WHERE status = 'sent' AND target_chat_id = 'chat1'))
      SELECT job_id || '_chat1' AS notification_id, CASE WHEN rn <= 20 THEN 'queued' ELSE 'blocked' END AS status, CASE WHEN rn <= 20 THEN '' ELSE 'Daily notify cap reached' END AS error,
        CASE WHEN rn <= 20 THEN concat_ws(chr(10), 'New good job', nullif(title, ''), company, trim(location), 'Rate: ' || CAST(rate_num AS VARCHAR), nullif(rate_reason, ''), coalesce(nullif(apply_url, ''), canonical_url)) END AS message FROM c""",
)
def notify_batch(spark, sf):
    out = cloud.notify_batch(v_jobs(spark, sf), v_notifications(spark, sf), "chat1", 20, at(NOW))
    return out.select("notification_id", "status", "error", "message")


@query(
    "job_events",
    with_views("v_jobs", "v_actions")
    + """SELECT job_id, 'rated' AS event_type, scrape_run_id AS run_id, CAST(rate_num AS VARCHAR) AS detail FROM v_jobs
      UNION ALL SELECT job_id, 'normalized', scrape_run_id, '2' FROM v_jobs UNION ALL SELECT job_id, 'apply_action', '', action FROM v_actions""",
)
def job_events(spark, sf):
    jobs = v_jobs(spark, sf)
    rated = cloud.event_rows(jobs, "rated", {"version": F.lit(1), "detail": F.col("rate_num"), "status": F.col("status")}, at(NOW))
    normal = cloud.event_rows(jobs, "normalized", {"detail": F.lit(2)}, at(NOW))
    acted = cloud.event_rows(v_actions(spark, sf), "apply_action", {"detail": F.col("action")}, F.col("created_at"))
    events = cloud.all_events(rated, normal, acted)
    return events.select("job_id", "event_type", "run_id", F.get_json_object("payload", "$.detail").alias("detail"))


@query(
    "rate_task_state",
    """SELECT user_id AS job_id, arg_max(st, event_id) AS status, count(*) FILTER (WHERE st = 'running') AS attempt, arg_max(CASE WHEN st = 'blocked' THEN 'Daily task enqueue cap reached' ELSE '' END, event_id) AS error
      FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'blocked' ELSE 'done' END AS st FROM events) GROUP BY 1""",
)
def rate_task_state(spark, sf):
    e = F.col("event_type")
    st = F.when(e == "signup", "queued").when(e == "click", "running").when(e == "error", "blocked").otherwise("done")
    log = table(spark, sf, "events").select(F.col("event_id").alias("row_seq"), F.col("user_id").alias("job_id"), st.alias("status"), F.when(e == "error", cloud.CAP_ERROR).otherwise("").alias("error"))
    return leases.task_states(log)


# --- leases -------------------------------------------------------------------------


@query(
    "claim_plan",
    with_views("v_sources")
    + f"""SELECT source_id, 'leased' AS status, '2024-01-15 01:30:00' AS issued, '2024-01-15 02:00:00' AS until, scrapePageUrl AS url FROM (SELECT source_id, scrapePageUrl, {_priority} AS p FROM v_sources
      WHERE enabled <> 'No' AND scrapePageUrl <> '' AND {_due_sql} ORDER BY p DESC, source_id LIMIT 10)""",
)
def claim_plan(spark, sf):
    commands, _ = leases.claim_plan(runtime_config(spark, sf), v_runs(spark, sf), at("2024-01-15 01:30:00"), 30, "addon", limit=10, day_left=24)
    return commands.select("source_id", "status", stamp("issued_at").alias("issued"), stamp("leased_until").alias("until"), F.col("scrape_page_url").alias("url"))


@query(
    "issue_leases",
    with_views("v_history", "v_postings")
    + f""", c AS ({_lease_keyed} v_postings), f AS (SELECT * FROM c WHERE stable_key <> '' AND (stable_key, snapshot_hash) IN (SELECT (stable_key, snapshot_hash) FROM c GROUP BY stable_key, snapshot_hash HAVING count(*) = 1)
        AND NOT EXISTS (SELECT 1 FROM ({_active_sql}) l WHERE l.stable_key = c.stable_key AND l.snapshot_hash = c.snapshot_hash))
      SELECT row_seq, stable_key AS row_key, sha256('run-9|' || stable_key || '|' || snapshot_hash) AS lease_id FROM f ORDER BY row_seq LIMIT 40""".replace(
        "(stable_key, snapshot_hash) IN (SELECT (stable_key, snapshot_hash) FROM", "stable_key || snapshot_hash IN (SELECT stable_key || snapshot_hash FROM"
    ),
)
def issue_leases(spark, sf):
    rows = v_postings(spark, sf).withColumn("Status", F.lit("2LRate"))
    out = leases.issue_leases(rows, leases_view(spark, sf), "run-9", "NewJobs", at(NOW), limit=40)
    return out.select("row_seq", "row_key", "lease_id")


@query(
    "lease_skips",
    with_views("v_history", "v_postings")
    + f""", c AS ({_lease_keyed} v_postings), g AS (SELECT stable_key, snapshot_hash, count(*) AS n FROM c WHERE stable_key <> '' GROUP BY 1, 2),
      f AS (SELECT * FROM g WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM ({_active_sql}) l WHERE l.stable_key = g.stable_key AND l.snapshot_hash = g.snapshot_hash))
      SELECT (SELECT count(*) FROM c WHERE stable_key = '') AS skipped_missing, CAST((SELECT coalesce(sum(n), 0) FROM g WHERE n > 1) AS BIGINT) AS skipped_duplicate,
        (SELECT count(*) FROM g WHERE n = 1) - (SELECT count(*) FROM f) AS skipped_leased, (SELECT count(*) FROM f) AS issued""",
)
def lease_skips(spark, sf):
    return leases.lease_skips(v_postings(spark, sf).withColumn("Status", F.lit("2LRate")), leases_view(spark, sf), "NewJobs")


_issued = "TIMESTAMP '2024-01-01' + to_hours(CAST(row_seq % 100 AS INTEGER))"


@query(
    "expire_leases",
    with_views("v_history", "v_postings")
    + f"""SELECT lease_id, CASE WHEN leased AND (bad OR issued <= TIMESTAMP '2024-01-04 10:00:00' - INTERVAL 240 MINUTE) THEN 'expired' WHEN leased THEN 'leased' ELSE 'saved' END AS state,
        CASE WHEN leased AND (bad OR issued <= TIMESTAMP '2024-01-04 10:00:00' - INTERVAL 240 MINUTE) THEN 'Lease expired after 240 minutes' ELSE '' END AS error
      FROM (SELECT 'L' || CAST(row_seq AS VARCHAR) AS lease_id, row_seq % 3 <> 0 AS leased, row_seq % 13 = 0 AS bad, {_issued} AS issued FROM v_history)
      WHERE leased OR bad OR issued > TIMESTAMP '2024-01-04 10:00:00' - INTERVAL 72 HOUR""",
)
def expire_leases(spark, sf):
    held = leases_view(spark, sf)
    bad = F.substring("lease_id", 2, 99).cast("long") % 13 == 0
    when = F.when(bad, "never").otherwise(F.col("issued_at"))
    out = leases.expire_leases(held.withColumns({"issued_at": when, "updated_at": when, "error": F.lit("")}), at("2024-01-04 10:00:00"))
    return out.select("lease_id", "state", "error")


# --- mart, applications, selection ---------------------------------------------------


def _mart_source(spark, sf):
    return v_status(spark, sf).withColumns({"JobRateNum": F.concat("JobRateNum", F.lit(",0")), "JobTitle": F.col("JobRateDesc"), "JobRateDttm": F.col("LoadDttm")})


@query(
    "build_mart",
    with_views("v_status")
    + f"""SELECT row_seq, JobRateDesc AS JobTitle, JobId, JobRateNum || ',0' AS JobRateNum, Status, {sql_stamp('LoadDttm')} AS LoadDttm, '' AS JobWorkMode FROM v_status WHERE Status = '2Apply' AND JobRateNum IN ('3', '4', '5')""",
)
def build_mart(spark, sf):
    mart = marts.build_mart(_mart_source(spark, sf))
    return mart.select("row_seq", "JobTitle", "JobId", "JobRateNum", "Status", stamp("LoadDttm").alias("LoadDttm"), "JobWorkMode")


def _selected(spark, sf):
    return updates_view(spark, sf).withColumn("Status", F.when(F.col("row_seq") % 6 == 0, "2Delete").otherwise("2Apply"))


def _app_match(extra: str = "") -> str:
    return f"""u AS ({UPDATES_SQL}), a AS ({_app_side('u', _main)} {extra}), b AS ({_app_side('v_postings', _side)}),
      pairs AS (
        SELECT a.row_seq, b.row_seq AS rn, CASE WHEN a.u = b.u OR a.sig = b.sig THEN 0 ELSE 1 END AS rank FROM a JOIN b ON a.i = b.i
        UNION ALL SELECT a.row_seq, b.row_seq, 0 FROM a JOIN b ON a.u = b.u WHERE a.i IS NULL
        UNION ALL SELECT a.row_seq, b.row_seq, 1 FROM a JOIN b ON a.sig = b.sig WHERE a.i IS NULL),
      m AS (SELECT row_seq, arg_min(rn, rank * 1000000000 + rn) AS row_num FROM pairs GROUP BY 1)"""


@query(
    "register_applications",
    with_views("v_history", "v_postings")
    + f""", {_app_match('WHERE row_seq % 6 <> 0')} SELECT row_seq, CASE WHEN row_seq IN (SELECT row_num FROM m) THEN 'Applied' ELSE '2Apply' END AS Status FROM v_postings""",
)
def register_applications(spark, sf):
    rows = v_postings(spark, sf).withColumn("Status", F.lit("2Apply"))
    _, updated, _ = marts.register_applications(_selected(spark, sf), rows, F.lit(NOW))
    return updated.select("row_seq", "Status")


@query(
    "mark_selected",
    with_views("v_history", "v_postings")
    + f""", {_app_match('WHERE row_seq % 6 <> 0')} SELECT count(DISTINCT row_num) AS updated, (SELECT count(*) FROM u WHERE row_seq % 6 <> 0) - count(*) AS missed, (SELECT count(*) FROM u WHERE row_seq % 6 <> 0) AS marked FROM m""",
)
def mark_selected(spark, sf):
    mart = _selected(spark, sf)
    marked, _, counts = marts.mark_selected(mart, mart.select("row_seq"), v_postings(spark, sf).withColumn("Status", F.lit("2Apply")))
    gone = marked.join(mart.filter("Status = '2Apply'").select("row_seq"), "row_seq", "left_semi").filter("Status = '2Delete'")
    return counts.withColumn("marked", gone.agg(F.count(F.lit(1)).alias("n")).scalar())


@query(
    "promote_stalled",
    with_views("v_status")
    + """SELECT row_seq, CASE WHEN Status = 'Loaded' THEN '2MBrate' ELSE Status END AS Status, CASE WHEN Status <> 'Loaded' THEN JobRateDesc WHEN JobRateDesc = '' THEN 'MA->MB fallback' ELSE JobRateDesc || '; MA->MB fallback' END AS desc_text FROM v_status""",
)
def promote_stalled(spark, sf):
    df = v_status(spark, sf).withColumn("Status", F.when(F.col("Status") == "Loaded", "2MARate").otherwise(F.col("Status")))
    twice = moves.promote_stalled(moves.promote_stalled(df).withColumn("Status", F.when(F.col("Status") == "2MBrate", "2MARate").otherwise(F.col("Status"))))
    return twice.select("row_seq", "Status", F.col("JobRateDesc").alias("desc_text"))


def posting_table(df, status, loaded):
    """A view as a full posting table with typed rate and time columns."""
    out = df.withColumns({c: F.lit("") for c in schema.POSTING if c not in df.columns})
    return out.withColumns(
        {"JobRateNum": F.lit(None).cast("double"), "JobRateDttm": F.lit(None).cast("timestamp_ntz"), "LoadDttm": loaded, "Status": F.lit(status)}
    ).select("row_seq", *schema.POSTING)


@query(
    "run_all",
    with_views("v_history", "v_postings", "v_stack")
    + rf""", f AS (SELECT row_seq, regexp_matches(JobTitle, '(?i)\b(the|qui|license)\b|^un') AS denied, {q.key('JobCompany')} AS c, {q.key('JobTitle')} AS t, {_loc} AS l,
        {q.trim('JobCompany')} <> '' AND {q.trim('JobTitle')} <> '' AS named FROM {_fresh()}),
      w AS (SELECT *, row_number() OVER (PARTITION BY denied, named, c, t ORDER BY l DESC, row_seq) AS rn FROM f)
      SELECT * FROM (SELECT 'new_jobs' AS table_name, CASE WHEN NOT named THEN '2MARate' WHEN row_seq % 3 = 0 THEN '2LRate' ELSE '2MBrate' END AS Status, count(*) AS n FROM w WHERE NOT denied AND (NOT named OR rn = 1) GROUP BY 2
      UNION ALL SELECT 'new_jobs', '2Apply', count(*) FROM v_postings WHERE row_seq % 2 = 0
      UNION ALL SELECT 'history', 'old', count(*) FROM v_history
      UNION ALL SELECT 'history', '2Apply', count(*) FROM v_postings WHERE row_seq % 2 = 1
      UNION ALL SELECT 'funnel', 'Loaded', count(DISTINCT source_id) FROM v_postings
      UNION ALL SELECT 'deleted', '2Delete', (SELECT count(*) FROM w WHERE denied OR (named AND rn > 1)) + (SELECT count(*) FROM v_postings WHERE row_seq % 5 = 0)) WHERE n > 0""",
)
def run_all(spark, sf):
    loaded, k = at("2024-04-30"), F.col("row_seq")
    postings = v_postings(spark, sf)
    stage = posting_table(postings.withColumn("ScrapePageName", F.col("source_id")), "Staged", loaded)
    history = posting_table(v_history(spark, sf), "old", loaded)
    renamed = lambda mark: postings.withColumns({"JobId": F.concat(F.lit(mark), k.cast("string")), "JobUrl": F.concat(F.lit(f"https://{mark}.example/"), k.cast("string")), "row_seq": -k - 1})
    waiting = posting_table(renamed("waiting"), "2Apply", F.when(k % 2 == 0, at("2023-01-01")).otherwise(loaded))
    gone = posting_table(renamed("gone").filter((-k - 1) % 5 == 0), "2Delete", loaded)
    answers = postings.filter(k % 3 < 2).select(
        "row_seq", F.when(k % 3 == 0, "ok").otherwise("FAILED_ALL").alias("outcome"), F.when(k % 3 == 0, '{"JobTop3Stack": "zz", "JobTop3Want": "x", "JobWorkMode": "any"}').alias("response"), F.lit("m1").alias("model")
    )
    funnel = spark.createDataFrame([], "source_id string, status string, jobs long")
    settings = Settings(title_deny=DENY, stack_negative=STACK_TERMS, company_negative=("no such company",))
    tables = pipeline.run_all(stage, waiting, history, gone, settings, at(NOW), answers, funnel)
    return pipeline.summary(tables)


@query(
    "register_rater",
    with_views("v_jobs")
    + """SELECT job_id, 'size-model' AS rated_model, CASE WHEN length(description) > 30 THEN 4 ELSE 2 END AS rate_num, CASE WHEN length(description) > 30 THEN '2Apply' ELSE '2Delete' END AS status FROM v_jobs""",
)
def register_rater(spark, sf):
    """A rater plugged in by name and run inside the stage chain's rating step."""
    from rolemill.operators import plugins

    plugins.register_rater("by-size", plugins.pandas_rater(_by_size))
    out = rate.rate_stage(v_jobs(spark, sf).withColumns({"enrich_summary": F.lit(""), "rate_version": F.lit(0)}), 1, plugins.rater("by-size"))
    return out.select("job_id", "rated_model", "rate_num", "status")


def _by_size(rows):
    big = rows["description"].str.len() > 30
    return rows.assign(rate_provider="by-size", rated_model="size-model", rate_reason="size", rate_num=big.map({True: 4, False: 2}), status=big.map({True: "2Apply", False: "2Delete"}))


@query(
    "settings_params",
    with_views("v_postings")
    + f"""SELECT row_seq, CASE WHEN contains({_hay}, 'the') THEN 1 WHEN contains({_hay}, 'with') THEN 4 ELSE 3 END AS rate_num FROM v_postings""",
)
def settings_params(spark, sf):
    """Keyword lists read from a setting table that Spark derives from the review table."""
    made = table(spark, sf, "labels").groupBy().agg(F.count(F.lit(1)).alias("n"))
    pairs = made.select(F.explode(F.map_from_arrays(F.array(F.lit("Deny_Keywords"), F.lit("target_keywords"), F.lit("archive_days")), F.array(F.lit("the"), F.lit(" With ,zzz"), F.col("n").cast("string")))))
    given = Settings.from_table(pairs.select(F.lit(1).alias("row_seq"), "key", "value"))
    jobs = v_postings(spark, sf).select(
        "row_seq", F.col("JobTitle").alias("title"), F.col("JobLocation").alias("location"), F.array("JobTags").alias("tags"), F.col("JobDescription").alias("description"), F.lit("").alias("enrich_summary")
    )
    return rate.keyword_rate(jobs, given.deny_keywords, given.target_keywords).select("row_seq", "rate_num")


@query(
    "load_report",
    with_views("v_history", "v_postings")
    + f"""SELECT p.source_id, count(*) AS staged, count(f.row_seq) AS new_rows, count(*) - count(f.row_seq) AS duplicates FROM v_postings p LEFT JOIN {_fresh('f')} ON p.row_seq = f.row_seq GROUP BY 1""",
)
def load_report(spark, sf):
    """The flagship: identity keys, history, first in batch; new against duplicate rows per source."""
    stage = v_postings(spark, sf).select("row_seq", "JobId", "JobUrl", "source_id", F.lit("Approved").alias("Status"))
    parts = load.stage_split(stage, joins.history_keys(v_history(spark, sf)))
    return parts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("staged"), F.count_if(F.col("part") == "new").alias("new_rows"), F.count_if(F.col("part") == "duplicate").alias("duplicates")
    )
