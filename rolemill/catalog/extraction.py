"""Page extraction over the page table, as it is or wrapped in the markup a board uses."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rolemill.catalog import sqltext as q
from rolemill.catalog.registry import query
from rolemill.catalog.scalars import sql_entities, sql_html_to_text, sql_stripped
from rolemill.catalog.views import v_links, v_pages, v_postings, view_sql, with_views
from rolemill.functions import posting_text as P
from rolemill.functions import text
from rolemill.operators.plugins import Source, SourceRegistry
from rolemill.plans import extract as E
from rolemill.sources.boards import default_registry


def page_texts(spark, sf):
    """Pages with their plain text and title next to them, as raw material for composed markup."""
    head = P.html_to_text(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return v_pages(spark, sf).select("row_seq", "url", head.alias("head"), P.html_to_text("html").alias("body"))


_head_sql = sql_html_to_text("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")
view_sql("v_texts", f"SELECT row_seq, url, {_head_sql} AS head, {sql_html_to_text('html')} AS body FROM v_pages", ("v_pages",))


def escaped(column: str):
    """Text as it stands in markup."""
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def script(opening: str, body, rest: str = "</script><p>rest</p>"):
    return F.concat(F.lit("<html><head>" + opening), body, F.lit(rest))


_place_marks = " ".join(
    f"WHEN {' OR '.join(f'contains(href, {q.lit(m)})' for m in s.match)} THEN '{s.id}'" for s in default_registry()
)


@query("route_pages", with_views("v_links") + f"SELECT row_seq, CASE {_place_marks} ELSE 'unknown' END AS source FROM v_links")
def route_pages(spark, sf):
    return v_links(spark, sf).select("row_seq", E.route("href", default_registry()).alias("source"))


@query(
    "register_source",
    with_views("v_links")
    + "SELECT row_seq, CASE WHEN contains(href, 'hh.ru') OR contains(href, '.example.com') THEN 'mine' WHEN contains(href, 'linkedin.com') THEN 'linkedin' ELSE 'unknown' END AS source FROM v_links",
)
def register_source(spark, sf):
    """A source added at run time, then replaced under the same id."""
    rules = {"card": "article", "JobUrl": "a @href", "JobTitle": "h1"}
    registry = SourceRegistry(next(s for s in default_registry() if s.id == "linkedin"))
    registry.register(Source("mine", "Mine", ("nowhere.example",), rules, rules))
    registry.register(Source("mine", "Mine", (".example.com", "hh.ru"), rules, rules))
    return v_links(spark, sf).select("row_seq", E.route("href", registry).alias("source"))


@query(
    "extract_jsonld",
    with_views("v_texts")
    + """SELECT row_seq, head AS JobTitle, CASE WHEN row_seq % 4 = 3 THEN '' ELSE 'Acme' END AS JobCompany, body AS JobDescription,
      CASE row_seq % 4 WHEN 0 THEN 'Lima' WHEN 1 THEN 'Quito, Remote LATAM' WHEN 2 THEN 'Paris' ELSE '' END AS JobLocation, CASE row_seq % 4 WHEN 1 THEN 'Remote' WHEN 2 THEN 'Remote' ELSE 'FULL_TIME' END AS JobModality,
      CAST(row_seq AS VARCHAR) AS JobId FROM v_texts""",
)
def extract_jsonld(spark, sf):
    k = F.col("row_seq") % 4
    place = F.when(k == 0, '"Lima"').when(k == 1, '[{"address":{"addressLocality":"Quito"}},"Remote LATAM",{"address":{}}]').when(k == 2, '{"address":"Paris"}').otherwise("null")
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 10_000_000)
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), F.regexp_replace(quoted(c), r"\]$", ""))
    posting = F.concat(
        F.lit('{"@type":"JobPosting","datePosted":"2024-01-02","employmentType":"FULL_TIME",'), field("title", "head"), F.lit(","), field("description", F.replace("body", F.lit("<"), F.lit("&lt;"))),
        F.lit(',"identifier":{"value":"'), F.col("row_seq").cast("string"), F.lit('"},'),
        F.when(k != 3, '"hiringOrganization":{"name":"Acme"},').otherwise(""), F.when(k == 2, '"jobLocationType":"TELECOMMUTE",').otherwise(""), F.lit('"jobLocation":'), place, F.lit("}"),
    )
    body = F.when(k == 1, F.concat(F.lit('[{"@type":"Thing","title":"no"},'), posting, F.lit("]"))).otherwise(posting)
    html = script("<script type='application/ld+json'>{broken</script><script type=\"application/ld+json\">", F.replace(body, F.lit("</"), F.lit("<\\/")))
    out = E.jsonld(page_texts(spark, sf).select("row_seq", html.alias("html")))
    return out.select("row_seq", "JobTitle", "JobCompany", "JobDescription", "JobLocation", "JobModality", "JobId")


@query(
    "extract_ssr_state",
    with_views("v_texts")
    + """SELECT row_seq, 0 AS item_pos, CASE WHEN row_seq % 2 = 0 THEN url ELSE 'https://career.habr.com/vacancies/' || CAST(row_seq AS VARCHAR) END AS JobUrl, CAST(row_seq AS VARCHAR) AS JobId, CASE WHEN head = '' THEN 'Untitled' ELSE head END AS JobTitle,
      'Acme' AS JobCompany, 'Go, SQL' AS JobTags, CASE WHEN row_seq % 2 = 0 THEN 'Minsk' ELSE 'Kazan, Tula' END AS JobLocation, CASE WHEN row_seq % 3 = 0 THEN 'Remote' WHEN row_seq % 2 = 0 THEN 'full' ELSE '' END AS JobModality, '100' AS JobSalary FROM v_texts""",
)
def extract_ssr_state(spark, sf):
    titled = lambda *names: F.array(*[F.struct(F.lit(n).alias("title")) for n in names])
    number = F.col("row_seq").cast("string")
    item = F.struct(
        number.alias("id"), F.concat(F.lit("/vacancies/"), number).alias("href"), F.col("head").alias("title"), F.struct(F.lit("Acme").alias("title")).alias("company"), titled("Go", "SQL").alias("skills"),
        titled("Kazan", "Tula").alias("locations"), F.lit("Minsk").alias("humanCityNames"), (F.col("row_seq") % 3 == 0).alias("remoteWork"), F.lit("full").alias("employmentType"),
        F.struct(F.lit("100").alias("formatted")).alias("predictedSalary"), F.col("body").alias("description"),
    )
    detail = F.col("row_seq") % 2 == 0
    bare = item.dropFields("href")
    state = F.when(detail, F.to_json(F.struct(bare.alias("vacancy")))).otherwise(F.to_json(F.struct(F.struct(F.array(item).alias("list")).alias("vacancies"))))
    html = script('<script type="application/json" data-ssr-state="true">', F.replace(state, F.lit("</"), F.lit("<\\/")))
    url = F.when(detail, F.col("url")).otherwise("https://career.habr.com/vacancies?page=2")
    out = E.ssr_state(page_texts(spark, sf).select("row_seq", url.alias("url"), html.alias("html")))
    return out.select("row_seq", "item_pos", "JobUrl", "JobId", "JobTitle", "JobCompany", "JobTags", "JobLocation", "JobModality", "JobSalary")


def _entity_map(spark, sf):
    n = F.col("row_seq").cast("string")
    pair = lambda k, v: F.struct(k.alias("key"), F.to_json(v).alias("value"))
    listing = F.struct(n.alias("id"), F.lit("dev").alias("slug"), F.col("head").alias("title"), F.array(F.lit("Lima"), F.lit("Quito")).alias("locationNames"), F.struct(F.lit("Startup:7").alias("__ref")).alias("startup"), F.concat(F.lit("<b>"), F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</b>")).alias("descriptionSnippet"))
    second = F.struct(F.col("head").alias("title"), F.array(F.lit("Peru")).alias("acceptedRemoteLocationNames"), F.struct(F.lit("Startup:9").alias("__ref")).alias("startup"))
    company = F.struct(F.lit("Acme").alias("name"), F.concat(F.lit("acme-"), n).alias("slug"))
    entries = [pair(F.concat(F.lit("JobListing:"), n), listing), pair(F.lit("JobListing:x1"), second), pair(F.lit("Startup:7"), company), pair(F.lit("Other:1"), company)]
    raw = F.concat_ws(",", *[F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]) for e in entries])
    body = F.concat(F.lit('{"props":{"pageProps":{"apolloState":{"data":{'), raw, F.lit("}}}}}"))
    html = script('<script id="__NEXT_DATA__" type="application/json">', F.replace(body, F.lit("</"), F.lit("<\\/")))
    return page_texts(spark, sf).select("row_seq", html.alias("html"))


@query(
    "extract_next_data",
    with_views("v_texts")
    + """SELECT row_seq, CAST(row_seq AS VARCHAR) AS JobId, 'https://wellfound.com/company/acme-' || CAST(row_seq AS VARCHAR) || '/jobs/' || CAST(row_seq AS VARCHAR) || '-dev' AS JobUrl, head AS JobTitle, 'Acme' AS JobCompany, 'Lima, Quito' AS JobLocation, body AS JobDescription FROM v_texts WHERE head <> ''
      UNION ALL SELECT row_seq, 'x1', '', head, '', 'Remote', '' FROM v_texts WHERE head <> ''""",
)
def extract_next_data(spark, sf):
    return E.next_data(_entity_map(spark, sf))


@query(
    "apollo_ref_join",
    with_views("v_texts")
    + """SELECT JobCompany, count(*) AS listings, count(DISTINCT row_seq) AS pages, CAST(sum(length(d)) AS BIGINT) AS chars
      FROM (SELECT row_seq, 'Acme' AS JobCompany, body AS d FROM v_texts WHERE head <> '' UNION ALL SELECT row_seq, '', '' FROM v_texts WHERE head <> '') GROUP BY 1""",
)
def apollo_ref_join(spark, sf):
    """Listings per company found through the reference inside each page."""
    return E.next_data(_entity_map(spark, sf)).groupBy("JobCompany").agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("row_seq").alias("pages"), F.sum(F.length("JobDescription")).alias("chars"))


@query(
    "extract_data_page",
    with_views("v_texts")
    + """SELECT row_seq, 0 AS item_pos, 'https://www.workatastartup.com/jobs/' || CAST(row_seq AS VARCHAR) AS JobUrl, CAST(row_seq AS VARCHAR) AS JobId, head AS JobTitle, 'A & "B"' AS JobCompany, CASE WHEN row_seq % 2 = 0 THEN 'Lima, Remote' ELSE 'Oslo' END AS JobLocation,
      CASE WHEN row_seq % 2 = 0 THEN 'Remote' ELSE 'fulltime' END AS JobModality, CASE WHEN row_seq % 3 = 0 THEN '$5k' ELSE '10 - 20' END AS JobSalary, 'Backend' AS JobTags, body AS JobDescription FROM v_texts""",
)
def extract_data_page(spark, sf):
    n = F.col("row_seq").cast("string")
    even, third = F.col("row_seq") % 2 == 0, F.col("row_seq") % 3 == 0
    job = F.struct(
        n.alias("id"), F.col("head").alias("title"), F.concat(F.lit("/jobs/"), n, F.lit("?ref=1")).alias("show_path"), F.when(even, F.array(F.lit("Lima"), F.lit("Remote"))).alias("locations"), F.when(~even, "Oslo").alias("location"),
        F.when(third, "$5k").alias("pretty_salary_range"), F.lit("10").alias("salary_min"), F.lit("20").alias("salary_max"), F.lit("fulltime").alias("pretty_job_type"), F.lit("Backend").alias("pretty_eng_type"),
        F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("description"),
    )
    visa = F.to_json(F.struct(F.lit("9").alias("id"), F.lit("US citizens only").alias("visa")))
    body = F.concat(F.lit('{"props":{"rawCompany":{"name":"A & \\"B\\"","jobs":['), F.to_json(job), F.lit(","), visa, F.lit("]}}}"))
    encoded = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit('<div id="app" data-page="'), encoded, F.lit('"></div>'))
    out = E.data_page(page_texts(spark, sf).select("row_seq", F.lit("https://www.workatastartup.com/companies/a").alias("url"), html.alias("html")))
    return out.select("row_seq", "item_pos", "JobUrl", "JobId", "JobTitle", "JobCompany", "JobLocation", "JobModality", "JobSalary", "JobTags", "JobDescription")


@query(
    "extract_rehydration",
    with_views("v_texts")
    + """SELECT row_seq, CASE WHEN row_seq % 2 = 0 THEN 'Dev "x"' ELSE '' END AS JobTitle, CASE WHEN row_seq % 2 = 0 THEN 'Acme' ELSE '' END AS JobCompany, CASE WHEN row_seq % 2 = 0 THEN 'Lima' ELSE 'Quito' END AS JobLocation,
      CASE WHEN row_seq % 2 = 0 THEN '2024-02-03' ELSE '3 weeks ago' END AS JobPostedDttm, 'Over 20 applicants' AS JobTags, CASE WHEN row_seq % 2 = 0 THEN body WHEN length(body) > 200 THEN body ELSE '' END AS JobDescription FROM v_texts""",
)
def extract_rehydration(spark, sf):
    described = F.regexp_extract(F.to_json(F.struct("body")), r"(?s)^\{(.*)\}$", 1)
    described = F.replace(described, F.lit('"body":'), F.lit('"description":'))
    posting = F.concat(F.lit('{"@type":"JobPosting","datePosted":"2024-02-03","title":"Dev \\u0022x\\u0022",'), described, F.lit(',"addressLocality":"Lima","hiringOrganization":{"a":1,"name":"Acme"}}'))
    card = F.lit('1:["com.linkedin.sdui.impl.jobseeker.jobdetails.components.topcard.topCard",{"children":["Quito"]},{"children":["3 weeks ago"]},{"children":["Over 20 applicants"]}]')
    long = F.concat(F.lit("2:{"), described, F.lit("}"))
    items = F.when(F.col("row_seq") % 2 == 0, F.array(F.lit("x"), posting, card)).otherwise(F.array(card, long))
    html = F.concat(F.lit("<script>window.__como_rehydration__ = "), F.replace(F.to_json(items), F.lit("</"), F.lit("<\\/")), F.lit(";</script>"))
    return E.rehydration(page_texts(spark, sf).select("row_seq", html.alias("html")))


# Pages of each board with their text in it: address, list page, card fields, detail page, fields.
# {n} is the page's number, {head} its title and {body} its text; both are escaped in markup.
BOARD_PAGES = {
    "linkedin": (
        "https://www.linkedin.com/jobs/search/?p={n}",
        '<ul><li class="x" data-occludable-job-id="{n}"><div class="job-card-container"><a href="/jobs/view/{n}/?ref=1"><span>{head}</span></a><div class="a job-card-container__primary-description">Ac<b>me</b></div><li data-occludable-job-id="0">no link</ul>',
        {"JobUrl": "https://www.linkedin.com/jobs/view/{n}/", "JobId": "{n}", "JobTitle": "{head}", "JobCompany": "Acme"},
        '<h1>{head}</h1><span class="top-card-layout__company-name"> A &amp; B </span><span class="jobs-unified-top-card__bullet">Lima<!-- x --></span><div componentkey="JobDetails_AboutTheJob_1"><div>{body}</div></div><div>tail</div>',
        {"JobTitle": "{head}", "JobCompany": "A & B", "JobLocation": "Lima", "JobDescription": "{body}"},
    ),
    "hh": (
        "https://hh.ru/search?p={n}",
        '<div data-qa="vacancy-serp__vacancy"><a data-qa="vacancy-serp__vacancy-title" href="/vacancy/{n}?x=1"><b>{head}</b></a><a data-qa="vacancy-serp__vacancy-employer">Ac<i>me</i> </a><span data-qa="vacancy-serp__vacancy-compensation">5 000</span></div><div data-qa="vacancy-serp__vacancy">no link</div>',
        {"JobUrl": "https://hh.ru/vacancy/{n}?x=1", "JobId": "{n}", "JobTitle": "{head}", "JobCompany": "Acme", "JobSalary": "5 000"},
        '<title>t</title><h1 data-qa="vacancy-title">{head}</h1><a href="/employer/1">Acme</a><div class="g-user-content"><p>{body}</p></div><span data-qa="bloko-tag__text">Go</span><span data-qa="bloko-tag__text">SQL</span><span data-qa="bloko-tag__text">Go</span>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobTags": "Go, SQL", "JobDescription": "{body}"},
    ),
    "habr": (
        "https://career.habr.com/vacancies?page={n}",
        '<div class="vacancy-card"><div class="vacancy-card__company"><a href="/companies/x">Acme</a></div><a class="vacancy-card__title-link" href="/vacancies/{n}">{head}</a><div class="vacancy-card__skills"><a>Go</a> <a>SQL</a></div><div class="vacancy-card__salary">1 000</div></div>',
        {"JobUrl": "https://career.habr.com/vacancies/{n}", "JobId": "{n}", "JobTitle": "{head}", "JobCompany": "Acme", "JobSalary": "1 000"},
        '<div class="page-title"><h1 class="page-title__title">{head}</h1></div><div class="company_name"><span>at</span><a>Acme</a></div><div class="vacancy-description__text"><div>{body}</div></div>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobDescription": "{body}"},
    ),
    "gallito": (
        "https://trabajo.gallito.com.uy/buscar/{n}",
        '<a class="post-cuadro x" href="/anuncio/{n}"><div class="bloque-start-text-origin"><h2>{head}</h2></div><div class="contendor-img-post"><img alt="Acme"></div><div class="bloque-start-texto">{body}</div></a>',
        {"JobUrl": "https://trabajo.gallito.com.uy/anuncio/{n}", "JobId": "{n}", "JobTitle": "{head}", "JobCompany": "Acme"},
        '<div class="cuadro-puesto"><h1>{head}</h1></div><p class="subtitle-puesto">Acme<p class="ubicacion">Lima</p><div class="cuadro-aviso-text">{body}</div><ul class="breadcrumb-ficha"><li><a>Go</a></li><li class="active">SQL</li></ul>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima", "JobTags": "Go, SQL", "JobDescription": "{body}"},
    ),
    "getonbrd": (
        "https://www.getonbrd.com/search?p={n}",
        '<article data-job-id="{n}"><a href="/jobs/dev-{n}"><h4 class="title">{head}</h4></a><a href="/companies/acme">Acme</a><span class="location">Lima</span></article>',
        {"JobUrl": "https://www.getonbrd.com/jobs/dev-{n}", "JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima"},
        '<h1>{head}</h1><div class="gb-company">Acme</div><i data-seniority="Senior">x</i><span class="location">Lima</span><span class="tag">Go</span><span class="tag">SQL</span><div id="job-body"><p>{body}</p></div>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima", "JobTags": "Go, SQL", "JobDescription": "{body}"},
    ),
    "lever": (
        "https://jobs.lever.co/acme?p={n}",
        '<ul><li class="posting big" data-qa-posting-id="p{n}"><a class="posting-title" href="https://jobs.lever.co/acme/p{n}/?lever-source=x"><h5 data-qa="posting-name">{head}</h5></a><span class="sort posting-category location">Lima<br>Peru</span><p class="workplaceTypes">Remote</ul>',
        {"JobUrl": "https://jobs.lever.co/acme/p{n}", "JobId": "p{n}", "JobTitle": "{head}", "JobLocation": "LimaPeru", "JobModality": "Remote"},
        '<h2>{head}</h2><meta name="twitter:data1" content="Lima"><meta property="og:description" content="{body}">',
        {"JobTitle": "{head}", "JobLocation": "Lima", "JobDescription": "{body}"},
    ),
    "computrabajo": (
        "https://uy.computrabajo.com/trabajo?p={n}",
        '<article class="box_offer" data-id="ID{n}"><h2><a class="js-o-link fc_base" href="/ofertas/x?oi={n}">{head}</a></h2><p class="dFlex"><a>Acme</a></p><p class="fs16 fc_base mt5"><span>Lima</span></p></article>',
        {"JobUrl": "https://uy.computrabajo.com/ofertas/x?oi={n}", "JobId": "ID{n}", "JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima"},
        '<h1 class="fwB fs24">{head}</h1><a class="dIB fs16 js-o-link" href="/e">Acme</a><div div-link="oferta"><p class="mbB">{body}</p><p class="fc_aux fs13">x</p></div>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobDescription": "{body}"},
    ),
    "jobspresso": (
        "https://jobspresso.co/remote/?p={n}",
        '<ul class="job_listings"><li class="job_listing type-job_listing"><a class="job_listing-clickbox" href="https://jobspresso.co/job/dev-{n}/"></a><div class="position"><h3>{head}</h3></div><div class="company">Acme</div><div class="location">Lima</div></li></ul><ul><li class="job_listing"><a href="/job/other">x</a></li></ul>',
        {"JobUrl": "https://jobspresso.co/job/dev-{n}", "JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima"},
        '<link rel="canonical" href="https://jobspresso.co/job/dev-{n}"><h1 class="entry-title">{head}</h1><div class="company">Acme</div><div class="location">Lima</div><div class="job-type">Full</div><div class="job_description">{body}</div>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima", "JobTags": "Full", "JobDescription": "{body}"},
    ),
    "torc": (
        "https://platform.torc.dev/#/jobs?p={n}",
        '<article><h3>{head}</h3><a href="#/jobs/matches/{n}">go</a><ul><li>{body}</li></ul><span class="chip-x">Go</span><span class="badge">SQL</span></article>',
        {"JobUrl": "https://platform.torc.dev/#/jobs/matches/{n}", "JobId": "{n}", "JobTitle": "{head}"},
        '<h1>{head}</h1><span class="badge">Go</span><span class="tag-b">SQL</span><main><p>{body}</p></main>',
        {"JobTitle": "{head}", "JobTags": "Go, SQL", "JobDescription": "{body}"},
    ),
    "revelo": (
        "https://careers.revelo.com/home?p={n}",
        '<article class="home-position-card" data-position-id="{n}"><h3>{head}</h3><div class="home-position-card__company">Acme</div><a href="/positions/{n}">go</a><div data-test="position-skills"><b class="badge">Go</b><b class="badge">SQL</b></div></article>',
        {"JobUrl": "https://careers.revelo.com/positions/{n}", "JobId": "{n}", "JobTitle": "{head}", "JobCompany": "Acme"},
        '<article class="ev-drawer"><h2>{head}</h2><i class="company-x">Acme</i><div class="ev-drawer__body">{body}</div></article>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobDescription": "{body}"},
    ),
    "workatastartup": (
        "https://www.workatastartup.com/companies?p={n}",
        '<div class="company-jobs"><ul><li>none<li><a href="/jobs/{n}">{head}</a></ul></div>',
        {"JobUrl": "https://www.workatastartup.com/jobs/{n}", "JobId": "{n}", "JobTitle": "{head}"},
        '<h1>{head}</h1><div class="company-name">Acme</div><div class="prose x"><div><p>{body}</p></div></div><div>more</div>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobDescription": "{body}"},
    ),
    "wellfound": (
        "https://wellfound.com/jobs?p={n}",
        '<div class="styles_jobCard__x"><a href="/company/acme">Acme</a><a class="jobLink" href="/company/acme/jobs/{n}-dev"><h2>{head}</h2></a><span class="x-location">Lima</span></div>',
        {"JobUrl": "https://wellfound.com/company/acme/jobs/{n}-dev", "JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima"},
        '<h1>{head}</h1><a href="/company/acme">Acme</a><span class="Location">Lima</span><div class="job-description"><div>{body}</div></div>',
        {"JobTitle": "{head}", "JobCompany": "Acme", "JobLocation": "Lima", "JobDescription": "{body}"},
    ),
}
CARD_FIELDS = ["JobUrl", "JobId", "JobTitle", "JobCompany", "JobLocation", "JobSalary"]
DETAIL_FIELDS = ["JobTitle", "JobCompany", "JobLocation", "JobTags", "JobDescription"]


def _pieces(template: str) -> list[str]:
    return [p for p in re.split(r"(\{n\}|\{head\}|\{body\})", template) if p]


def _filled(template: str, escaped: bool):
    """A template as a column over row_seq, head and body."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")) if escaped else F.col(c)
    given = {"{n}": F.col("row_seq").cast("string"), "{head}": safe("head"), "{body}": safe("body")}
    return F.concat(*[given.get(p, F.lit(p)) for p in _pieces(template)])


def _filled_sql(template: str) -> str:
    given = {"{n}": "CAST(row_seq AS VARCHAR)", "{head}": "head", "{body}": "body"}
    return " || ".join(given.get(p, q.lit(p)) for p in _pieces(template)) or "''"


def _by_board(pick, column):
    """CASE over the boards, dealt by row number."""
    out = None
    for place, board in enumerate(BOARD_PAGES.values()):
        hit = F.col("row_seq") % len(BOARD_PAGES) == place
        out = F.when(hit, column(pick(board))) if out is None else out.when(hit, column(pick(board)))
    return out


def _by_board_sql(pick) -> str:
    return "CASE row_seq % 12 " + " ".join(f"WHEN {i} THEN {_filled_sql(pick(b))}" for i, b in enumerate(BOARD_PAGES.values())) + " END"


_source_sql = "CASE row_seq % 12 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(BOARD_PAGES)) + " END"


def _wanted_sql(kind: int, field: str) -> str:
    wanted = _by_board_sql(lambda b: b[kind].get(field, ""))
    return f"coalesce(nullif({wanted}, ''), 'Untitled') AS {field}" if field == "JobTitle" else f"{wanted} AS {field}"


def _board_pages(spark, sf, kind):
    """Pages in the markup of all twelve boards, with their own titles and texts."""
    html = _by_board(lambda b: b[1 if kind == "list" else 3], lambda t: _filled(t, True))
    page = F.concat(F.lit("<!DOCTYPE html><html><body><script>var x = '<h1>no</h1>';</script>"), html, F.lit("</body></html>"))
    return page_texts(spark, sf).select("row_seq", _by_board(lambda b: b[0] if kind == "list" else b[2]["JobUrl"], lambda t: _filled(t, False)).alias("url"), page.alias("html"))


@query("extract_cards", with_views("v_texts") + f"SELECT row_seq, {_source_sql} AS source, {', '.join(_wanted_sql(2, f) for f in CARD_FIELDS)} FROM v_texts")
def extract_cards(spark, sf):
    return E.cards(_board_pages(spark, sf, "list"), default_registry()).select("row_seq", "source", *CARD_FIELDS)


@query("extract_detail", with_views("v_texts") + f"SELECT row_seq, {_source_sql} AS source, {', '.join(_wanted_sql(4, f) for f in DETAIL_FIELDS)} FROM v_texts")
def extract_detail(spark, sf):
    return E.details(_board_pages(spark, sf, "detail"), default_registry()).select("row_seq", "source", *DETAIL_FIELDS)


_h1 = sql_html_to_text("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")


@query(
    "extract_title_fallback",
    with_views("v_pages", "v_texts")
    + f"""SELECT row_seq, CASE WHEN k = 0 THEN coalesce(nullif(h1, ''), nullif(head, ''), 'Untitled')
        ELSE coalesce(nullif({q.collapse("CASE WHEN len(bars) >= 2 THEN bars[1] WHEN len(ats) >= 2 THEN ats[1] ELSE '' END")}, ''), 'Untitled') END AS title,
      CASE WHEN k = 0 THEN '' WHEN len(bars) > 2 THEN bars[2] WHEN len(bars) < 2 AND len(ats) >= 2 THEN split_part(ats[2], ' | ', 1) ELSE '' END AS company
      FROM (SELECT *, string_split(t, ' | ') AS bars, string_split(t, ' at ') AS ats
        FROM (SELECT p.row_seq, p.row_seq % 3 AS k, {_h1} AS h1, head, trim(CASE WHEN p.row_seq % 3 = 1 THEN head || ' | Acme | Board' ELSE head || ' at Shop' END) AS t FROM v_pages p JOIN v_texts t ON p.row_seq = t.row_seq))""",
)
def extract_title_fallback(spark, sf):
    """The page as it is, and its title in two longer forms without a heading."""
    k = F.col("row_seq") % 3
    own = F.concat(F.lit("<title> "), escaped("head"), F.when(k == 1, " | Acme | Board").otherwise(" at Shop"), F.lit("</title><h1> </h1><p>"), escaped("body"))
    pages = v_pages(spark, sf).select("row_seq", "html").join(page_texts(spark, sf).drop("url"), "row_seq")
    title, company = E.title_fallback(F.when(k == 0, F.col("html")).otherwise(own))
    return pages.select("row_seq", title.alias("title"), company.alias("company"))


_href = "unnest(list_distinct(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=[\"'']([^\"'']*)[\"'']', 1)))"


@query(
    "extract_links",
    with_views("v_pages")
    + f"""SELECT row_seq, address FROM (SELECT DISTINCT row_seq, regexp_extract(url, '^(https?://[^/?#]+)', 1) || {sql_entities('href')} AS address, href FROM (SELECT row_seq, url, {_href} AS href FROM v_pages)) WHERE starts_with(href, '/')
      UNION SELECT row_seq, href FROM (SELECT row_seq, url, {_href} AS href FROM v_pages) WHERE starts_with(href, 'http')""",
)
def extract_links(spark, sf):
    return E.links(v_pages(spark, sf)).select("row_seq", "address")


@query(
    "extract_job_links",
    with_views("v_links")
    + "SELECT row_seq, CAST(0 AS INTEGER) AS pos, 'https://www.linkedin.com/jobs/view/' || CAST(row_seq AS VARCHAR) || '/' AS address FROM v_links WHERE site = 'linkedin' UNION ALL SELECT row_seq, 0, 'https://www.linkedin.com/jobs/view/77/' FROM v_links WHERE site <> 'linkedin'",
)
def extract_job_links(spark, sf):
    html = F.concat(F.lit('<a class="x" href="'), F.col("href"), F.lit('">a</a> <a href="'), F.col("href"), F.lit('#again">b</a><code>urn:li:fsd_jobPosting:77</code>'))
    return E.job_links(v_links(spark, sf).select("row_seq", F.concat("html", html).alias("html")))


@query(
    "longest_block",
    with_views("v_texts") + "SELECT row_seq, CASE WHEN length(body) > 200 THEN body ELSE '' END AS block FROM v_texts",
)
def longest_block(spark, sf):
    safe = F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<body><nav>menu menu</nav><div class='a'>short<div id=1>"), safe, F.lit("</div>tail</div><script>"), F.rpad(F.lit("x"), 2_000, "x"), F.lit("</script></body>"))
    return page_texts(spark, sf).select("row_seq", E.longest_block(html).alias("block"))


@query(
    "apply_url_candidates",
    with_views("v_links")
    + """SELECT row_seq, CASE row_seq % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || CAST(row_seq AS VARCHAR) || '/apply/?a=1' WHEN 1 THEN url ELSE '' END AS target FROM v_links""",
)
def apply_url_candidates(spark, sf):
    n = F.col("row_seq").cast("string")
    k = F.col("row_seq") % 3
    save = F.lit('<a href="/jobs/saved">Save and apply later</a>')
    own = F.concat(F.lit('<a aria-label="Easy Apply" href="/jobs/view/'), n, F.lit('/apply/?a=1">go</a>'))
    away = F.concat(F.lit('<a href="https://www.linkedin.com/redir/redirect/?url='), F.url_encode("url"), F.lit('&amp;t=1">Apply on company website</a>'))
    links = F.when(k == 0, F.concat(save, away, own)).when(k == 1, F.concat(save, away)).otherwise("<a href='/x'>home</a>")
    html = F.concat("html", links)
    page = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), n, F.lit("/"))
    return v_links(spark, sf).select("row_seq", E.apply_url(html, page, n).alias("target"))


@query(
    "next_page_url",
    with_views("v_links")
    + """SELECT row_seq, CASE row_seq % 3 WHEN 0 THEN 'https://b.example/v?page=9' WHEN 1 THEN 'https://b.example/v?page=' || CAST(row_seq % 5 + 2 AS VARCHAR) || '&q=1' ELSE '' END AS next_url FROM v_links""",
)
def next_page_url(spark, sf):
    page = F.col("row_seq") % 5 + 1
    link = lambda p: F.concat(F.lit('<a class="p" href="?page='), p.cast("string"), F.lit('&amp;q=1">p</a>'))
    k = F.col("row_seq") % 3
    html = F.concat(
        "html",
        F.when(k != 2, F.concat(link(page + 3), link(page + 1), link(page))).otherwise(link(page)),
        F.when(k == 0, '<a rel="next nofollow" href="/v?page=9">more</a>').otherwise(""),
    )
    url = F.concat(F.lit("https://b.example/v?page="), page.cast("string"))
    return v_links(spark, sf).select("row_seq", E.next_page_url(html, url).alias("next_url"))


@query(
    "coverage_report",
    with_views("v_texts")
    + f"""SELECT source, count(*) AS pages, count(*) AS postings, count(*) FILTER (WHERE JobTitle <> '') AS with_title, count(*) AS with_url, count(*) FILTER (WHERE JobCompany <> '') AS with_company,
      count(*) FILTER (WHERE JobLocation <> '') AS with_location, count(*) FILTER (WHERE JobDescription <> '') AS with_description
      FROM (SELECT {_source_sql} AS source, {', '.join(_wanted_sql(4, f) for f in DETAIL_FIELDS)} FROM v_texts) GROUP BY 1""",
)
def coverage_report(spark, sf):
    return E.coverage(E.details(_board_pages(spark, sf, "detail"), default_registry()))


@query(
    "section_blocks",
    with_views("v_texts")
    + f"""SELECT row_seq, concat_ws(chr(10) || chr(10), 'The stack' || chr(10) || 'Spark jobs over posting tables, streams with state, and plenty of plain SQL', repeat('w', 90), CASE WHEN length(body) >= 60 THEN 'Team' || chr(10) || body END) AS blocks
      FROM (SELECT row_seq, {sql_stripped('body')} AS body FROM v_texts)""",
)
def section_blocks(spark, sf):
    same = "<h3>The <i>stack</i></h3><p>Spark jobs over posting tables, streams with state, and plenty of plain SQL</p>"
    html = F.concat(F.lit("<h2>Intro</h2>short" + same + "<h3>Status update</h3>" + "w" * 90 + same + "<h4>Team</h4><div>"), escaped("body"), F.lit("</div>"))
    return page_texts(spark, sf).select("row_seq", E.section_blocks(html).alias("blocks"))


@query(
    "meta_line_fields",
    with_views("v_pages")
    + """SELECT row_seq, CASE row_seq % 3 WHEN 0 THEN 'Montevideo Uruguay' WHEN 1 THEN 'Remote' ELSE 'Lima Peru' END AS place, CAST(row_seq % 9 AS VARCHAR) || ' days ago' AS posted,
      CASE row_seq % 3 WHEN 2 THEN 'Over 30 people clicked apply' ELSE CAST(row_seq AS VARCHAR) || ' applicants' END AS people FROM v_pages""",
)
def meta_line_fields(spark, sf):
    k = F.col("row_seq") % 3
    days = F.concat((F.col("row_seq") % 9).cast("string"), F.lit(" days ago"))
    people = F.concat(F.col("row_seq").cast("string"), F.lit(" applicants"))
    line = F.when(k == 0, F.concat(F.lit(" Montevideo, Uruguay · "), days, F.lit(" • "), people)).when(k == 1, F.concat(F.lit("Remote · "), people, F.lit(" · "), days)).otherwise("")
    body = F.concat(F.when(k == 2, F.concat(F.lit("Lima, Peru · "), days, F.lit(" · Over 30 people clicked apply. "))).otherwise(""), F.col("body"))
    found = E.meta_line(line, body)
    return page_texts(spark, sf).select("row_seq", found["JobLocation"].alias("place"), found["JobPostedDttm"].alias("posted"), found["JobTags"].alias("people"))
