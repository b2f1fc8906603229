"""Row-wise functions: keys, addresses, text, numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolemill.catalog import sqltext as q
from rolemill.catalog.registry import projection, query
from rolemill.catalog.views import v_history, v_links, v_pages, v_phrases, v_postings, v_sources, v_stack, with_views
from rolemill.functions import keys, posting_text, text, urls, values
from rolemill.operators import settings

ID = ["row_seq"]
POST_COLUMNS = ("JobId", "JobUrl", "JobApplyUrl", "JobTitle", "JobCompany", "JobLocation", "JobTags", "JobDescription")

# --- keys -------------------------------------------------------------------

projection(
    "normalize_url",
    v_links,
    ID,
    {
        "norm": (lambda: keys.normalize_url("url"), q.norm_url("url")),
        "host": (lambda: keys.url_host("url"), q.url_host("url")),
        "norm_href": (lambda: keys.normalize_url("href"), q.norm_url("href")),
        "norm_loose": (lambda: keys.normalize_url(F.regexp_replace("href", "^ *https?://", "")), q.norm_url("regexp_replace(href, '^ *https?://', '')")),
    },
)
projection(
    "job_key",
    v_postings,
    ID,
    {
        "job_key": (lambda: keys.job_key("JobId", "JobUrl"), q.job_key("JobId", "JobUrl")),
        "url_key": (lambda: keys.url_key("JobUrl"), q.url_key("JobUrl")),
        "id_key": (lambda: keys.id_key("JobId", "JobUrl"), q.id_key("JobId", "JobUrl")),
    },
)
projection(
    "session_key",
    v_postings,
    ID,
    {"session_key": (lambda: keys.session_key("JobId", "JobUrl"), q.session_key("JobId", "JobUrl"))},
)
projection(
    "job_id_hash",
    v_postings,
    ID,
    {
        "job_id": (
            lambda: keys.job_id_hash("source_id", "JobId", "JobUrl"),
            f"sha256(source_id || '|' || CASE WHEN {q.trim('JobId')} <> '' THEN {q.trim('JobId')} ELSE lower({q.trim('JobUrl')}) END)",
        )
    },
)
projection(
    "dedupe_key",
    v_postings,
    ID,
    {
        "dedupe_key": (
            lambda: keys.dedupe_key("JobTitle", "JobCompany", "JobLocation", "JobApplyUrl"),
            "sha256(" + " || '|' || ".join(q.key(c) for c in ("JobTitle", "JobCompany", "JobLocation", "JobApplyUrl")) + ")",
        )
    },
)
projection(
    "snapshot_hash",
    v_postings,
    ID,
    {"snapshot_hash": (lambda: keys.snapshot_hash(POST_COLUMNS), q.snapshot_hash(POST_COLUMNS))},
)
_sig = q.signature("JobCompany", "JobTitle", "JobLocation")
projection(
    "row_key",
    v_postings,
    ID,
    {
        "row_key": (
            lambda: keys.row_key("JobId", "JobUrl", ("JobCompany", "JobTitle", "JobLocation"), "row_seq"),
            f"CASE WHEN ({q.job_key('JobId', 'JobUrl')}) <> '' THEN ({q.job_key('JobId', 'JobUrl')}) "
            f"WHEN {_sig} <> '' THEN 'sig|' || {_sig} ELSE 'row|' || CAST(row_seq AS VARCHAR) END",
        )
    },
)


def _x(pattern: str, source: str = "href", group: int = 1) -> str:
    return f"nullif(regexp_extract({source}, {q.lit(pattern)}, {group}), '')"


projection(
    "extract_job_id",
    v_links,
    ID,
    {
        "job_id": (
            lambda: urls.extract_job_id("href"),
            f"coalesce({_x('/vacancy/([0-9]+)')}, {_x('/vacancies/([0-9]+)')}, "
            f"{_x('(?i)jobs[.]lever[.]co/[^/]+/([^/?]+)')}, "
            f"CASE WHEN contains(href, 'computrabajo.com') THEN coalesce({_x('(?i)[?&]oi=([A-Za-z0-9]+)')}, "
            f"{_x('-([A-Za-z0-9]{16,})(?:$|[/?#])')}) END, "
            f"{_x('/jobs/[^/]+/([^/?]+)')}, {_x('/([0-9]+)(?:/|$|[?])')}, '')",
        )
    },
)
projection(
    "parse_source",
    v_links,
    ID,
    {
        "source": (
            lambda: urls.parse_source("href"),
            f"lower(split_part(regexp_replace(regexp_replace({q.trim('href')}, '^https?://', ''), '^(?i:www[.]|m[.]|jobs[.])', ''), '.', 1))",
        )
    },
)
_site_cases = " ".join(
    f"WHEN {' OR '.join(f'contains(v, {q.lit(m)})' for m in marks)}"
    + (" OR starts_with(v, 'habr')" if name == "habr" else "")
    + f" THEN '{name}'"
    for name, marks in urls.SITE_MARKS
)
projection(
    "site_key",
    v_links,
    ID,
    {"site_key": (lambda: urls.site_key("href"), f"(SELECT CASE {_site_cases} ELSE v END FROM (SELECT lower({q.trim('href')}) AS v))")},
)
_detail = " OR ".join(f"(regexp_matches(href, {q.lit(a)}) AND regexp_matches(href, {q.lit(b)}))" for a, b in urls.DETAIL_RULES)
projection(
    "is_detail_page",
    v_links,
    ID,
    {
        "detail": (
            lambda: urls.is_detail_page("href"),
            f"({_detail} OR (contains(href, 'careers.revelo.com') AND NOT contains(href, '/home') AND regexp_matches(href, '/(jobs?|positions?)/')))",
        )
    },
)
_bare = f"split_part(split_part({q.trim('href')}, '#', 1), '?', 1)"
projection(
    "canonical_job_url",
    v_links,
    ID,
    {
        "canonical": (
            lambda: urls.canonical_job_url("site", "href"),
            f"""CASE site
              WHEN 'linkedin' THEN 'https://www.linkedin.com/jobs/view/' || regexp_extract(href, '/jobs/view/([0-9]+)', 1) || '/'
              WHEN 'lever' THEN rtrim({_bare}, '/') WHEN 'jobspresso' THEN rtrim({_bare}, '/')
              WHEN 'wellfound' THEN {_bare} WHEN 'workatastartup' THEN {_bare}
              WHEN 'torc' THEN 'https://platform.torc.dev/' || regexp_extract(href, '#.*', 0)
              ELSE {q.trim('href')} END""",
        )
    },
)


@query(
    "resolve_redirect",
    with_views("v_links")
    + """SELECT row_seq, CASE WHEN row_seq % 4 = 3 THEN '' WHEN row_seq % 4 = 2 THEN 'https://l.example.com/in/' || CAST(row_seq AS VARCHAR)
      ELSE url END AS target FROM v_links""",
)
def resolve_redirect(spark, sf_dir):
    """Redirect addresses built around the page addresses, encoded once or twice."""
    once = F.url_encode("url")
    kind = F.col("row_seq") % 4
    href = (
        F.when(kind == 0, F.concat(F.lit("https://l.example.com/r?x=1&url="), once))
        .when(kind == 1, F.concat(F.lit("https://l.example.com/r?target="), F.url_encode(once), F.lit("&k=2")))
        .when(kind == 2, F.concat(F.lit("https://l.example.com/r?dest=%2Fin%2F"), F.col("row_seq").cast("string")))
        .otherwise("javascript:void(0)")
    )
    return v_links(spark, sf_dir).select("row_seq", urls.resolve_redirect(href).alias("target"))


def _fold(x: str, start: str, step: str) -> str:
    codes = f"list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS UBIGINT))"
    return f"list_reduce({codes}, lambda a, c: {step}, CAST({start} AS UBIGINT))"


_slug = f"CAST({_fold('url', '0', '(a * 31 + c) % 4294967296')} AS BIGINT)"
projection(
    "prompt_hash",
    v_links,
    ID,
    {
        "fnv": (lambda: keys.fnv_hash("url"), f"lower(to_hex({_fold('url', '2166136261', '(xor(a, c) * 16777619) % 4294967296')}))"),
        "slug": (
            lambda: keys.slug_hash("url"),
            f"lower(to_base(abs(CASE WHEN {_slug} >= 2147483648 THEN {_slug} - 4294967296 ELSE {_slug} END), 36))",
        ),
    },
)
projection(
    "page_number_url",
    v_links,
    ID,
    {
        "page": (
            lambda: urls.page_number("href"),
            "CASE WHEN TRY_CAST(regexp_extract(href, '[?&]page=([0-9]+)', 1) AS BIGINT) >= 1 "
            "THEN TRY_CAST(regexp_extract(href, '[?&]page=([0-9]+)', 1) AS BIGINT) ELSE 1 END",
        ),
        "next_url": (
            lambda: urls.page_number_url("url", urls.page_number("url") + 1),
            """CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, 'page=[^&#]*',
                'page=' || CAST(1 + greatest(1, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT), 1)) AS VARCHAR))
              ELSE split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'page=2'
                || regexp_extract(url, '#.*$', 0) END""",
        ),
        "first_url": (
            lambda: urls.page_number_url("url", F.lit(1)),
            "regexp_replace(regexp_replace(url, '([?&])page=[^&#]*&?', '\\1'), '[?&](#|$)', '\\1')",
        ),
    },
)

# --- text -------------------------------------------------------------------

projection("normalize_text", v_postings, ID, {"flat": (lambda: text.collapse("JobDescription"), q.collapse("JobDescription"))})
projection("normalize_key", v_postings, ID, {"key": (lambda: text.normalize_key("JobDescription"), q.key("JobDescription"))})
projection(
    "normalize_stack",
    v_postings,
    ID,
    {
        "stack": (lambda: text.normalize_stack("JobDescription"), q.stack("JobDescription")),
        "tokens": (lambda: F.size(text.stack_tokens("JobTitle")).cast("long"), f"len(list_filter(string_split({q.stack('JobTitle')}, ' '), lambda t: t <> ''))"),
        "compact": (lambda: text.compact_stack("JobTitle"), f"replace({q.stack('JobTitle')}, ' ', '')"),
    },
)
projection("normalize_company", v_postings, ID, {"company": (lambda: text.normalize_company("JobTitle"), q.company("JobTitle"))})


def _tags(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[,\\n|]'), lambda t: {q.trim('t')}), lambda t: t <> '')"


projection(
    "normalize_tags",
    v_postings,
    ID,
    {"tags": (lambda: F.array_join(text.normalize_tags(F.concat_ws("|", "JobTags", "JobTitle")), ";"), f"array_to_string({_tags(chr(40) + 'JobTags || ' + repr('|') + ' || JobTitle' + chr(41))}, ';')")},
)
projection(
    "top3_pad",
    v_stack,
    ID,
    {
        "three": (
            lambda: F.array_join(text.pad_three(F.split("JobTitle", " ")), " | "),
            f"array_to_string((list_filter(list_transform(string_split(JobTitle, ' '), lambda t: {q.trim('t')}), lambda t: t <> '') || ['Unknown', 'Unknown', 'Unknown'])[1:3], ' | ')",
        )
    },
)
projection(
    "work_mode",
    v_phrases,
    ID,
    {
        "mode": (
            lambda: text.work_mode(F.when(F.col("word") == "view", " Remote ").when(F.col("word") == "click", "ONSITE").when(F.col("word") == "error", "hybrid").otherwise(F.col("word"))),
            "CASE word WHEN 'view' THEN 'Remote' WHEN 'click' THEN 'Onsite' WHEN 'error' THEN 'Hybrid' ELSE 'Unknown' END",
        )
    },
)
projection(
    "infer_work_mode",
    v_postings,
    ID,
    {
        "mode": (lambda: text.infer_work_mode("JobLocation", "JobDescription"), q.infer_work_mode("JobLocation", "JobDescription")),
        "mode_text": (lambda: text.infer_work_mode("JobCompany", "JobDescription"), q.infer_work_mode("JobCompany", "JobDescription")),
    },
)


def _level():
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ["Senior Dev", "junior", "Intern", "internal", "Team Lead", "Dev", "MIDDLE"])), (F.col("row_seq") % 7 + 1).cast("int")), "word")


projection(
    "modality_seniority",
    v_phrases,
    ID,
    {
        "level": (
            lambda: text.modality_seniority(_level(), F.concat((F.col("num") % 4).cast("string"), F.lit(" – "), (F.col("num") % 7).cast("string"), F.lit(" лет"))),
            """CASE row_seq % 7 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Junior' WHEN 2 THEN 'Intern' WHEN 4 THEN 'Lead' WHEN 6 THEN 'Middle'
              ELSE CASE WHEN num % 4 = 1 AND num % 7 = 3 THEN 'Middle' WHEN num % 4 = 3 AND num % 7 = 6 THEN 'Senior' ELSE '' END END""",
        )
    },
)
projection(
    "extract_experience_range",
    v_phrases,
    ID,
    {
        "years": (
            lambda: text.experience_range(F.concat(F.lit("Опыт "), F.col("num").cast("string"), F.lit(" — "), (F.col("num") + 2).cast("string"), F.when(F.col("num") % 2 == 0, " Лет").otherwise(" дней"))),
            "CASE WHEN num % 2 = 0 THEN CAST(num AS VARCHAR) || '–' || CAST(num + 2 AS VARCHAR) || ' года' ELSE '' END",
        )
    },
)


def _published():
    return F.concat(F.lit("x Вакансия опубликована "), (F.col("num") % 31 + 1).cast("string"), F.when(F.col("num") % 2 == 0, " марта 2025").otherwise(" мая"), F.lit(" в Нижний  Новгород "), F.when(F.col("num") % 3 == 0, "• далее").otherwise(""))


projection(
    "extract_published_info",
    v_phrases,
    ID,
    {
        "posted_on": (lambda: text.published_info(_published())[0], "CAST(num % 31 + 1 AS VARCHAR) || CASE WHEN num % 2 = 0 THEN ' марта 2025' ELSE ' мая' END"),
        "city": (lambda: text.published_info(_published())[1], "'Нижний Новгород'"),
    },
)
projection(
    "parse_salary_location_modality",
    v_postings,
    ID,
    {
        "salary": (lambda: posting_text.salary(F.concat_ws(" ", F.lit("pay €"), "JobTitle")), rf"{q.collapse('regexp_extract(' + q.collapse(chr(40) + repr('pay €') + ' || chr(32) || JobTitle' + chr(41)) + ', ' + q.lit(posting_text.SALARY) + ', 0)')}"),
        "region": (lambda: posting_text.region("JobLocation"), r"regexp_extract(JobLocation, '(?i)\b(?:remote|latam|brazil|argentina|mexico|colombia|uruguay|chile|peru)\b[^,;|]*', 0)"),
        "contract": (
            lambda: posting_text.contract_type("JobDescription"),
            f"CASE WHEN regexp_matches(lower({q.collapse('JobDescription')}), 'full[- ]time') THEN 'Full-time' "
            f"WHEN regexp_matches(lower({q.collapse('JobDescription')}), 'part[- ]time') THEN 'Part-time' "
            f"WHEN contains(lower({q.collapse('JobDescription')}), 'contract') THEN 'Contract' ELSE '' END",
        ),
    },
)


def _made_title():
    return F.concat(F.col("JobTitle"), F.lit(" - "), F.col("JobCompany"), F.when(F.col("row_seq") % 3 == 0, "").otherwise(F.concat(F.lit(" ("), F.col("JobLocation"), F.lit(")"))))


_made_title_sql = "(JobTitle || ' - ' || JobCompany || CASE WHEN row_seq % 3 = 0 THEN '' ELSE ' (' || JobLocation || ')' END)"


def _parts():
    return posting_text.title_parts(_made_title())


_flat_title = q.collapse(_made_title_sql)
_fit = f"regexp_matches({_flat_title}, {q.lit(posting_text.TITLE_PARTS)})"


def _part(i: int, otherwise: str) -> str:
    extract = f"regexp_extract({_flat_title}, {q.lit(posting_text.TITLE_PARTS)}, {i})"
    return f"CASE WHEN {_fit} THEN {q.collapse(extract)} ELSE {otherwise} END"


projection(
    "title_parts",
    v_postings,
    ID,
    {"role": (lambda: _parts()["role"], _part(1, _flat_title)), "company": (lambda: _parts()["company"], _part(2, "''")), "location": (lambda: _parts()["location"], _part(3, "''"))},
)
projection(
    "title_score",
    v_postings,
    ID,
    {
        "score": (
            lambda: posting_text.title_score(_made_title()).cast("long"),
            rf"""CASE WHEN regexp_matches({_made_title_sql}, '\s-\s') THEN 5 ELSE 0 END
              + CASE WHEN regexp_matches({_made_title_sql}, '\([^)]+\)') THEN 3 ELSE 0 END
              + CASE WHEN contains({_made_title_sql}, ' ') THEN 2 ELSE 0 END
              + CASE WHEN length({_made_title_sql}) BETWEEN 12 AND 90 THEN 2 ELSE 0 END
              - CASE WHEN length({_made_title_sql}) > 120 THEN 3 ELSE 0 END""",
        )
    },
)
_phrases = posting_text.alternation(posting_text.BOILERPLATE)


def sql_stripped(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({q.collapse(x)}, '<[^>]+>', ' ', 'g'), {q.lit('(?i)' + _phrases)}, ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, ' {{2,}}', ' ', 'g'), '^[ /|.,;:()\\-•]+', ''), ' ')"


_framed = "('Back / <b>About us</b> ' || JobDescription || ' Terms of Use | Newsroom')"
projection(
    "strip_boilerplate",
    v_postings,
    ID,
    {
        "stripped": (
            lambda: posting_text.strip_boilerplate(F.concat(F.lit("Back / <b>About us</b> "), F.col("JobDescription"), F.lit(" Terms of Use | Newsroom"))),
            f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({q.collapse(_framed)}, '<[^>]+>', ' ', 'g'), {q.lit('(?i)' + _phrases)}, ' ', 'g'), ' {{2,}}', ' ', 'g'), '^[ /|.,;:()\\-•]+', ''), ' ')",
        )
    },
)
projection(
    "trim_between_markers",
    v_postings,
    ID,
    {
        "body": (
            lambda: posting_text.trim_between(F.concat(F.lit("Acme About the job: - "), F.col("JobDescription"), F.when(F.col("row_seq") % 2 == 0, " Set alert for similar jobs About us").otherwise(""))),
            f"{q.trim('regexp_replace(JobDescription, ' + q.lit('^(?:[ :–—-]|' + q.SPACE + ')+') + ', ' + repr('') + ')')}",
        )
    },
)


def _place():
    return F.element_at(F.array(*map(F.lit, ["Save Apply Montevideo, Uruguay", "Senior Data Engineer Buenos Aires", "12 applicants", "Reposted 3 days ago", "Big Shop Lead Developer", "Remote", "Great New Role Support Lima"])), (F.col("row_seq") % 7 + 1).cast("int"))


projection(
    "clean_location",
    v_phrases,
    ID,
    {
        "place": (
            lambda: posting_text.clean_location(_place()),
            "CASE row_seq % 7 WHEN 0 THEN 'Montevideo Uruguay' WHEN 1 THEN 'Buenos Aires' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'Big Shop Lead Developer' WHEN 5 THEN 'Remote' ELSE 'Lima' END",
        )
    },
)
projection(
    "posted_applicants_text",
    v_phrases,
    ID,
    {
        "posted_text": (lambda: posting_text.posted_text("posted"), rf"CASE WHEN regexp_matches(posted, '(?i)posted\s+\d+\s+\w+\s+ago|^\d+\s+\w+\s+ago') THEN {q.trim('posted')} ELSE '' END"),
        "applicants": (lambda: posting_text.applicants_text(F.concat_ws(" ", F.col("num").cast("string"), F.when(F.col("num") % 3 == 0, "Applicants").otherwise("views"))), "CASE WHEN num % 3 = 0 THEN CAST(num AS VARCHAR) || ' Applicants' ELSE '' END"),
    },
)
projection(
    "truncate_ellipsis",
    v_postings,
    ID,
    {
        "cut_420": (lambda: text.truncate("JobDescription", 420), "CASE WHEN length(JobDescription) > 420 THEN substr(JobDescription, 1, 420) || '...' ELSE JobDescription END"),
        "cut_10000": (lambda: text.truncate("JobDescription", 10_000), "CASE WHEN length(JobDescription) > 10000 THEN substr(JobDescription, 1, 10000) || '...' ELSE JobDescription END"),
    },
)


def sql_entities(x: str) -> str:
    for name, char in posting_text.ENTITIES:
        x = f"replace({x}, '&{name};', {q.lit(char)})"
    return x


def sql_html_to_text(x: str) -> str:
    no_script = f"regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    return q.collapse(sql_entities(f"regexp_replace({no_script}, '<[^>]*>', ' ', 'g')"))


_lines = (
    "regexp_replace(regexp_replace(replace(html, chr(13), ''), '(?i)<br\\s*/?>|</(?:p|div|li)>', chr(10), 'g'), "
    "'(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
)
_lines = sql_entities(f"regexp_replace({_lines}, '<[^>]*>', '', 'g')")
projection(
    "html_to_text",
    v_pages,
    ID,
    {
        "one_line": (lambda: posting_text.html_to_text("html"), sql_html_to_text("html")),
        "lines": (
            lambda: posting_text.html_to_lines("html"),
            f"array_to_string(list_filter(list_transform(string_split({_lines}, chr(10)), lambda t: {q.collapse('t')}), lambda t: t <> ''), chr(10))",
        ),
    },
)


def _path():
    return F.concat(F.col("JobTitle"), F.lit(" / x/"), F.col("JobCompany"), F.lit("/ /"), F.col("JobLocation"))


projection(
    "split_category_path",
    v_stack,
    ID,
    {"path": (lambda: F.array_join(posting_text.split_category_path(_path()), ";"), "JobTitle || ' / x;' || JobCompany || ';' || JobLocation")},
)
_prompt_fields = [("Title", "JobTitle"), ("Company", "JobCompany"), ("Location", "JobLocation"), ("Tags", "JobTags"), ("Description", "JobDescription"), ("URL", "JobUrl")]
projection(
    "build_prompt",
    v_postings,
    ID,
    {
        "prompt": (
            lambda: text.fill_template(F.lit("CV: {CV}\nGoal: {Goal}\n{JobText}"), {"CV": F.lit("dev"), "Goal": F.col("JobCompany"), "JobText": text.labelled_lines(_prompt_fields)}),
            "'CV: dev' || chr(10) || 'Goal: ' || JobCompany || chr(10) || concat_ws(chr(10), "
            + ", ".join(f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END" for label, c in _prompt_fields)
            + ")",
        ),
    },
)
projection(
    "notify_message",
    v_postings,
    ID,
    {
        "message": (
            lambda: settings.notify_message("JobTitle", "JobCompany", "JobLocation", F.lit(4), F.lit(""), F.coalesce(text.blank_to_null("JobApplyUrl"), "JobUrl")),
            f"concat_ws(chr(10), 'New good job', nullif({q.trim('JobTitle')}, ''), nullif({q.trim('JobCompany')}, ''), "
            f"nullif({q.trim('JobLocation')}, ''), 'Rate: 4', nullif({q.trim('coalesce(nullif(JobApplyUrl, ' + repr('') + '), JobUrl)')}, ''))",
        )
    },
)
projection(
    "unescape_json_string",
    v_postings,
    ID,
    {"plain": (lambda: posting_text.unescape_json(F.regexp_replace(F.regexp_replace(F.regexp_replace("JobDescription", r"([\\\"])", r"\\$1"), "\n", r"\\n"), "\t", r"\\t")), "JobDescription")},
)
projection(
    "easy_apply_flag",
    v_links,
    ID,
    {
        "flag": (
            lambda: posting_text.easy_apply_flag(F.concat(F.lit('<a href="'), F.regexp_replace("href", r"/\?refId=.*", "/apply/?openSDUApplyFlow%3Dtrue"), F.lit('">'), F.when(F.col("row_seq") % 5 == 0, "Easy  Apply").otherwise("Go"), F.lit("</a>"))),
            "CASE WHEN site = 'linkedin' OR row_seq % 5 = 0 THEN 'TRUE' ELSE 'FALSE' END",
        )
    },
)

# --- dates and numbers --------------------------------------------------------

AS_OF = "2024-03-31 12:00:00"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


_month = "DATE '2024-03-01' - to_months(CAST(num AS INTEGER)) + INTERVAL 30 DAY"
projection(
    "parse_relative_date",
    v_phrases,
    ID,
    {
        "day": (
            lambda: values.day_text(values.relative_date("posted", _now())),
            f"""strftime(CASE row_seq % 12
              WHEN 0 THEN DATE '2024-03-31' - to_days(CAST(num AS INTEGER)) WHEN 1 THEN DATE '2024-03-31' - to_days(CAST(7 * num AS INTEGER))
              WHEN 2 THEN {_month} WHEN 6 THEN date_trunc('day', ts) WHEN 7 THEN date_trunc('day', ts)
              WHEN 8 THEN make_date(2023, 12, CAST(num % 31 + 1 AS INTEGER))
              WHEN 9 THEN coalesce(TRY_CAST(format('2023-{{:02d}}-{{:02d}}', num % 31, row_seq % 13) AS DATE), TRY_CAST(format('2023-{{:02d}}-{{:02d}}', row_seq % 13, num % 31) AS DATE))
              END, '%Y-%m-%d')""",
        )
    },
)
_age = "date_diff('day', date_trunc('day', ts), TIMESTAMP '2024-03-31 12:00:00')"
_exact = "floor(epoch(TIMESTAMP '2024-03-31 12:00:00' - ts::TIMESTAMP(0)) / 86400)"
_december = "CAST(date_diff('day', make_date(2023, 12, CAST(num % 31 + 1 AS INTEGER)), DATE '2024-03-31') AS INTEGER)"


def _by_age(x: str) -> str:
    return f"CASE WHEN {x} >= 365 THEN 'absolute>=1y' WHEN {x} >= 30 THEN 'absolute>=1m' WHEN {x} BETWEEN 21 AND 63 THEN 'absolute=weeks(3-9)' ELSE '' END"


projection(
    "posted_age_rule",
    v_phrases,
    ID,
    {
        "rule": (
            lambda: values.posted_age_rule("posted", _now()),
            f"""CASE row_seq % 12 WHEN 1 THEN CASE WHEN num BETWEEN 3 AND 9 THEN 'ago+weeks(3-9)' ELSE '' END
              WHEN 2 THEN 'ago+months' WHEN 3 THEN 'ago+year' WHEN 4 THEN CASE WHEN num % 12 BETWEEN 3 AND 9 THEN 'ago+weeks(3-9)' ELSE '' END
              WHEN 6 THEN {_by_age(_age)} WHEN 7 THEN {_by_age("floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-03-31 12:00:00') / 86400)")} WHEN 8 THEN {_by_age(_december)} ELSE '' END""",
        ),
        "compat": (
            lambda: values.posted_age_rule("posted", _now(), strict_compat=True),
            f"""CASE row_seq % 12 WHEN 1 THEN CASE WHEN num BETWEEN 3 AND 9 THEN 'ago+weeks(3-9)' ELSE '' END
              WHEN 2 THEN 'ago+months' WHEN 3 THEN 'ago+year' WHEN 4 THEN CASE WHEN num % 12 BETWEEN 3 AND 9 THEN 'ago+weeks(3-9)' ELSE '' END
              WHEN 5 THEN 'ago+months'
              WHEN 6 THEN {_by_age(_age)} WHEN 7 THEN {_by_age("floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-03-31 12:00:00') / 86400)")} WHEN 8 THEN {_by_age(_december)} ELSE '' END""",
        ),
    },
)
projection(
    "day_key",
    v_phrases,
    ID,
    {"day": (lambda: values.day_key("posted"), "CASE WHEN row_seq % 12 IN (6, 7) THEN strftime(ts, '%Y-%m-%d') WHEN row_seq % 12 = 8 THEN format('2023-12-{:02d}', num % 31 + 1) ELSE '' END")},
)
projection(
    "parse_cell_date",
    v_phrases,
    ID,
    {
        "millis": (
            lambda: F.unix_millis(values.cell_instant(F.when(F.col("num") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")))),
            "CASE WHEN num % 2 = 0 THEN epoch_us(date_trunc('second', ts)) // 1000 ELSE epoch_us(ts) // 1000 END",
        )
    },
)
projection(
    "lenient_number",
    v_phrases,
    ID,
    {
        "number": (
            lambda: values.lenient_number(F.when(F.col("num") % 3 == 0, F.replace(F.format_string("%.2f kg", "amount"), F.lit("."), F.lit(","))).when(F.col("num") % 3 == 1, "n/a").otherwise(F.format_string(" %.2f", "amount"))),
            "CASE WHEN num % 3 = 1 THEN NULL ELSE round(amount, 2) END",
        ),
        "or_zero": (
            lambda: values.number_or_zero(F.when(F.col("num") % 3 == 1, "n/a").otherwise(F.format_string("%.2f", "amount"))),
            "CASE WHEN num % 3 = 1 THEN 0 ELSE round(amount, 2) END",
        ),
    },
)
projection(
    "positive_int",
    v_sources,
    ["source_id"],
    {
        "interval": (lambda: values.positive_int("minIntervalMin", 60).cast("long"), "CASE WHEN TRY_CAST(minIntervalMin AS BIGINT) > 0 THEN TRY_CAST(minIntervalMin AS BIGINT) ELSE 60 END"),
        "prefix": (lambda: values.positive_int(F.concat("minIntervalMin", F.lit("abc")), 7).cast("long"), "CASE WHEN TRY_CAST(minIntervalMin AS BIGINT) > 0 THEN TRY_CAST(minIntervalMin AS BIGINT) ELSE 7 END"),
    },
)
projection("truthy_enabled", v_sources, ["source_id"], {"is_on": (lambda: values.truthy_enabled("enabled"), "enabled <> 'No'")})
projection(
    "split_setting_list",
    v_postings,
    ID,
    {
        "items": (lambda: F.array_join(text.setting_list(F.concat_ws(",", F.upper("JobTags"), F.lit(" B ,,"))), ";"), "lower(replace(JobTags, ', ', ';')) || 'b'"),
        "mapped": (
            lambda: F.concat_ws(
                ";",
                F.transform(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda k: F.coalesce(F.try_element_at(text.setting_map(F.concat(F.lit("a=1; b = x=y ;junk;"), F.lit("a="), "JobCompany")), k), F.lit("-"))),
            ),
            "JobCompany || ';x=y;-'",
        ),
    },
)


@query(
    "setting_lookup",
    """SELECT lower(name) AS key, count(*) AS entries, arg_min(value, seq) AS value
       FROM (SELECT event_id AS seq, ' ' || upper(event_type) || ' ' AS raw, upper(event_type) AS name, CAST(user_id AS VARCHAR) AS value FROM events)
       GROUP BY 1""",
)
def setting_lookup(spark, sf_dir):
    """First value per key, keys trimmed and compared without case."""
    from rolemill.catalog.views import table

    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_seq"),
        F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("key"),
        F.col("user_id").cast("string").alias("value"),
    )
    return settings.first_values(raw, fold=True)
