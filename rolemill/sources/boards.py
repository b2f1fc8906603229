"""The job boards: addresses, and selectors of their list cards and detail pages.

A field rule is a selector, or several in order of preference; see functions.elements.options.
``*JobTags`` joins all matches.
"""

from __future__ import annotations

from rolemill.operators.plugins import Source, SourceRegistry

# Address marks and selectors of each board.
BOARDS = (
    Source(
        "linkedin",
        "LinkedIn",
        ("linkedin.com",),
        {
            "card": 'li[data-occludable-job-id], div.job-card-container, div.base-card',
            "JobUrl": 'a[href*="/jobs/view/"] @href',
            "JobTitle": 'a[href*="/jobs/view/"]',
            "JobCompany": (".job-card-container__primary-description", ".base-search-card__subtitle"),
            "JobLocation": (".job-card-container__metadata-item", ".job-search-card__location"),
            "JobPostedDttm": "time @datetime",
        },
        {
            "JobTitle": ("h1", ".job-details-jobs-unified-top-card__job-title", ".top-card-layout__title"),
            "JobCompany": (".job-details-jobs-unified-top-card__company-name", ".top-card-layout__company-name", "[data-test-company-name]"),
            "JobLocation": (".job-details-jobs-unified-top-card__bullet", ".jobs-unified-top-card__bullet", "[data-test-job-location]"),
            "JobTags": (".job-details-jobs-unified-top-card__applicant-count", ".jobs-unified-top-card__applicant-count"),
            "JobDescription": '[componentkey^="JobDetails_AboutTheJob_"]',
        },
    ),
    Source(
        "hh",
        "HeadHunter",
        ("hh.ru", "headhunter.ge"),
        {
            "card": '[data-qa="vacancy-serp__vacancy"]',
            "JobUrl": 'a[href*="/vacancy/"] @href',
            "JobTitle": ('[data-qa="vacancy-serp__vacancy-title"]', 'a[href*="/vacancy/"]'),
            "JobCompany": ('[data-qa="vacancy-serp__vacancy-employer"]', 'a[href*="/employer/"]'),
            "JobLocation": '[data-qa="vacancy-serp__vacancy-address"]',
            "JobSalary": '[data-qa="vacancy-serp__vacancy-compensation"]',
            "JobPostedDttm": '[data-qa="vacancy-serp__vacancy-date"]',
        },
        {
            "JobTitle": ('[data-qa="vacancy-title"]', 'h1', 'title'),
            "JobCompany": ('[data-qa="vacancy-company-name"]', 'a[data-qa="vacancy-company-logo"]', 'a[href*="/employer/"]'),
            "JobLocation": ('[data-qa="vacancy-view-location"]', '[data-qa="vacancy-view-raw-address"]'),
            "JobSalary": '[data-qa="vacancy-salary"]',
            "JobSeniority": '[data-qa="vacancy-experience"]',
            "JobModality": '[data-qa="vacancy-view-employment-mode"]',
            "JobDescription": ('[data-qa="vacancy-description"]', '.vacancy-description', '.g-user-content'),
            "*JobTags": '[data-qa="bloko-tag__text"]',
            "JobPostedDttm": ('[data-qa="vacancy-creation-date-redesigned"]', '[data-qa="vacancy-creation-date"]'),
        },
    ),
    Source(
        "habr",
        "Habr Career",
        ("career.habr.com/vacancies",),
        {
            "card": ".vacancy-card",
            "JobUrl": (".vacancy-card__title-link @href", ".vacancy-card__backdrop-link @href"),
            "JobTitle": (".vacancy-card__title-link", ".vacancy-card__backdrop-link"),
            "JobCompany": ".vacancy-card__company a",
            "JobSalary": ".vacancy-card__salary",
            "JobPostedDttm": (".vacancy-card__date time @datetime", ".vacancy-card__date time"),
            "*JobTags": ".vacancy-card__skills a",
        },
        {
            "JobTitle": ("h1", ".page-title__title", "title"),
            "JobCompany": (".company_name a", ".vacancy-company__title a"),
            "JobDescription": (".vacancy-description__text", ".style-ugc"),
        },
    ),
    Source(
        "gallito",
        "Gallito",
        ("trabajo.gallito.com.uy",),
        {
            "card": "a.post-cuadro",
            "JobUrl": "@href",
            "JobTitle": ".bloque-start-text-origin h2",
            "JobCompany": (".bloque-start-nombre", ".contenedor-post-movile img @alt", ".contendor-img-post img @alt"),
            "JobDescription": ".bloque-start-texto",
            "JobPostedDttm": ".bloque-start-time .time-text",
            "*JobTags": ".bloque-start-time .link-post",
        },
        {
            "JobTitle": (".title-puesto h1", ".cuadro-puesto h1", "h1"),
            "JobCompany": ".subtitle-puesto",
            "JobPostedDttm": ".bloque-start-time .time-text",
            "JobLocation": ('[itemprop="addressLocality"]', '.job-location', '.ubicacion', '.location', '[data-location]'),
            "JobDescription": ".cuadro-aviso-text",
            "*JobTags": ".breadcrumb-ficha li a, .breadcrumb-ficha li.active",
        },
    ),
    Source(
        "getonbrd",
        "Get on Board",
        ("getonbrd.com",),
        {
            "card": 'article[data-job-id], .job-card, .gb-job-card, div[data-job-id]',
            "JobUrl": 'a[href*="/jobs/"] @href',
            "JobTitle": ('h1, h2, h3, h4, [class*="title"]', 'a[href*="/jobs/"]'),
            "JobCompany": ('a[href*="/companies/"]', '[class*="company"]'),
            "JobLocation": '[class*="location"], [class*="remote"], [data-location]',
            "JobSeniority": '[itemprop="qualifications"], [data-seniority], [class*="seniority"]',
            "*JobTags": '.tag, [class*="tag"], .skill, [class*="skill"]',
        },
        {
            "JobTitle": ('h1', '.job-title', '[class*="job-title"]', 'title', 'meta[property="og:title"] @content'),
            "JobCompany": ('.company', '[class*="company"]', '.gb-company', 'a[href*="/companies/"]', '[itemprop="hiringOrganization"]'),
            "JobLocation": ('.location', '[class*="location"]', '.gb-location', '[data-location]', '.remote', '[itemprop="jobLocation"]'),
            "JobSeniority": ('[itemprop="qualifications"]', '[data-seniority] @data-seniority', '.seniority', '[class*="seniority"]', '.level'),
            "JobModality": ('.modality', '[class*="modality"]', '.type', '[data-modality] @data-modality', '.remote', '.perk-remote_full'),
            "JobSalary": ('.salary', '[class*="salary"]', '.compensation', '[data-salary] @data-salary', '[itemprop="baseSalary"]'),
            "*JobTags": '.tag, [class*="tag"], .skill, [class*="skill"], .badge',
            "JobDescription": ('#job-body', '[itemprop="description"]', '.job-description', '[class*="description"]', '.gb-rich-txt'),
        },
    ),
    Source(
        "lever",
        "Lever",
        ("jobs.lever.co/",),
        {
            "card": ".posting",
            "JobUrl": ('a.posting-title @href', 'a[href*="jobs.lever.co/"] @href'),
            "JobId": "@data-qa-posting-id",
            "JobTitle": ('[data-qa="posting-name"]', 'a.posting-title'),
            "JobLocation": ".posting-category.location",
            "JobModality": (".workplaceTypes", ".posting-category.commitment"),
        },
        {
            "JobTitle": ("h2", "h1", "title"),
            "JobLocation": 'meta[name="twitter:data1"] @content',
            "JobTags": 'meta[name="twitter:data2"] @content',
            "JobDescription": ('meta[name="twitter:description"] @content', 'meta[property="og:description"] @content'),
        },
    ),
    Source(
        "computrabajo",
        "Computrabajo",
        ("computrabajo.com",),
        {
            "card": "article.box_offer, article[data-id]",
            "JobUrl": "a.js-o-link @href",
            "JobId": ("@data-id", "@id"),
            "JobTitle": "a.js-o-link",
            "JobCompany": ("[offer-grid-article-company-url]", "p.dFlex a"),
            "JobLocation": ("p.fs16.fc_base.mt5 span", "p.fs16.fc_base.mt5"),
            "JobPostedDttm": "p.fs13.fc_aux.mt15",
        },
        {
            "JobTitle": ("h1.fwB.fs24", "h1"),
            "JobCompany": ('a.dIB.fs16.js-o-link', 'a.js-o-link[href^="/"]'),
            "JobDescription": ('div[div-link="oferta"] p.mbB', 'div[div-link="oferta"]'),
            "JobPostedDttm": 'div[div-link="oferta"] p.fc_aux.fs13',
        },
    ),
    Source(
        "jobspresso",
        "Jobspresso",
        ("jobspresso.co",),
        {
            "card": "ul.job_listings li.job_listing, ul.job_listings li.type-job_listing",
            "JobUrl": ('a.job_listing-clickbox @href', 'a[href*="/job/"] @href'),
            "JobTitle": (".position h3, .position strong, .entry-title, .job_listing-title", "a"),
            "JobCompany": ".company, .job_listing-company",
            "JobLocation": ".location, .job_listing-location, .job-location",
            "JobTags": ".job-type, .job_listing-type, .job-types",
        },
        {
            "JobUrl": 'link[rel="canonical"] @href',
            "JobTitle": ("h1.entry-title", ".entry-title", ".job_listing-title", "h1"),
            "JobCompany": ".company, .job_listing-company",
            "JobLocation": ".location, .job_listing-location, .job-location",
            "JobTags": ".job-type, .job_listing-type, .job-types",
            "JobDescription": (".job_description", ".job_listing-description"),
        },
    ),
    Source(
        "torc",
        "Torc",
        ("platform.torc.dev", ".torc.dev"),
        {
            "card": 'article, li, [class*="card"]',
            "JobUrl": 'a[href*="#/jobs/matches/"], a[href*="/jobs/matches/"] @href',
            "JobTitle": 'h1, h2, h3, [data-test*="title"], [class*="title"]',
            "*JobTags": '[class*="badge"], [class*="chip"], [class*="tag"]',
            "JobDescription": "self",
        },
        {
            "JobTitle": 'h1, h2, h3, [data-test*="title"], [class*="title"]',
            "*JobTags": '[class*="badge"], [class*="chip"], [class*="tag"]',
            "JobDescription": ('main', 'article', 'section', '[class*="prose"]', '[class*="description"]'),
        },
    ),
    Source(
        "revelo",
        "Revelo",
        ("careers.revelo.com",),
        {
            "card": 'article[data-test="home-position-card"], article.home-position-card',
            "JobUrl": 'a[href*="/positions/"], a[href*="/job/"], a[href*="/jobs/"] @href',
            "JobId": ("@data-position-id", "@data-id", "@id"),
            "JobTitle": '[data-test="position-title"], .home-position-card__title, h2, h3',
            "JobCompany": '[data-test="position-company"], .home-position-card__company',
            "*JobTags": '[data-test="position-skills"] [class*="badge"], .home-position-card__skills [class*="badge"], .home-position-card__skills span',
            "JobDescription": "self",
        },
        {
            "JobTitle": ('article.ev-drawer h1, article.ev-drawer h2, article.ev-drawer h3, [data-test="position-title"]', 'h1'),
            "JobCompany": '[data-test="position-company"], article.ev-drawer [class*="company"]',
            "JobDescription": ('article.ev-drawer [data-test="body"]', 'article.ev-drawer .ev-drawer__body', 'article.ev-drawer'),
        },
    ),
    Source(
        "workatastartup",
        "Work at a Startup",
        ("workatastartup.com",),
        {
            "card": "div.job-name, div.company-jobs li",
            "JobUrl": 'a[href*="/jobs/"] @href',
            "JobTitle": 'a[href*="/jobs/"]',
        },
        {"JobTitle": ("h1", "title"), "JobCompany": (".company-name", "h2"), "JobDescription": ("div.prose", "main")},
    ),
    Source(
        "wellfound",
        "Wellfound",
        ("wellfound.com",),
        {
            "card": '[data-test*="JobCard"], [class*="jobCard"], [class*="job-card"]',
            "JobUrl": ('a[class*="jobLink"][href*="/jobs/"] @href', 'a[href*="/company/"][href*="/jobs/"] @href'),
            "JobTitle": 'h1, h2, h3, [data-test*="title"], [class*="title"]',
            "JobCompany": 'a[href*="/company/"]',
            "JobLocation": '[class*="location"], [data-test*="location"]',
        },
        {
            "JobTitle": 'h1, h2, [data-test*="JobTitle"], [class*="job-title"], [class*="jobTitle"]',
            "JobCompany": 'a[href*="/company/"], [data-test*="Company"], [class*="company"]',
            "JobLocation": '[data-test*="Location"], [class*="location"], [class*="Location"]',
            "JobDescription": '[data-test*="JobDescription"], [class*="job-description"], [class*="description"], [class*="Description"]',
        },
    ),
)


def default_registry() -> SourceRegistry:
    return SourceRegistry(*BOARDS)
