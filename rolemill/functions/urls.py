"""URL rules: ids in addresses, site names, page kinds, canonical and redirect addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import SPACE, blank_to_null, let, text, trim


def _has(value: Column, *needles: str) -> Column:
    found = F.contains(value, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(value, F.lit(needle))
    return found


def extract_job_id(url) -> Column:
    """The posting id in an address; the first pattern that fits wins."""
    return let(text(url), _job_id_in)


def _job_id_in(raw: Column) -> Column:
    board = F.when(
        _has(raw, "computrabajo.com"),
        F.coalesce(
            blank_to_null(F.regexp_extract(raw, "(?i)[?&]oi=([A-Za-z0-9]+)", 1)),
            blank_to_null(F.regexp_extract(raw, r"-([A-Za-z0-9]{16,})(?:$|[/?#])", 1)),
        ),
    )
    return F.coalesce(
        blank_to_null(F.regexp_extract(raw, r"/vacancy/(\d+)", 1)),
        blank_to_null(F.regexp_extract(raw, r"/vacancies/(\d+)", 1)),
        blank_to_null(F.regexp_extract(raw, r"(?i)jobs\.lever\.co/[^/]+/([^/?]+)", 1)),
        board,
        blank_to_null(F.regexp_extract(raw, r"/jobs/[^/]+/([^/?]+)", 1)),
        blank_to_null(F.regexp_extract(raw, r"/(\d+)(?:/|$|\?)", 1)),
        F.lit(""),
    )


def parse_source(url) -> Column:
    """The first host label behind protocol and ``www.``/``m.``/``jobs.``."""
    bare = F.regexp_replace(trim(url), "^https?://", "")
    bare = F.regexp_replace(bare, r"^(?i:www\.|m\.|jobs\.)", "")
    return F.lower(F.substring_index(bare, ".", 1))


# Site name and the parts of an address or label that give it away.
SITE_MARKS = (
    ("linkedin", ("linkedin",)),
    ("wellfound", ("wellfound",)),
    ("lever", ("lever", "dlocal")),
    ("habr", ("career.habr.com",)),
    ("hh", ("headhunter", "hh.ru")),
    ("getonbrd", ("getonbrd",)),
    ("gallito", ("gallito",)),
    ("computrabajo", ("computrabajo",)),
    ("jobspresso", ("jobspresso",)),
    ("workatastartup", ("workatastartup", "ycombinator")),
    ("torc", ("torc",)),
    ("revelo", ("revelo",)),
)


def site_key(value) -> Column:
    """The canonical site of an address or label, else the label itself."""
    return let(F.lower(trim(value)), _site_of)


def _site_of(raw: Column) -> Column:
    out = raw
    for name, marks in reversed(SITE_MARKS):
        hit = _has(raw, *marks)
        if name == "habr":
            hit = hit | F.startswith(raw, F.lit("habr"))
        out = F.when(hit, name).otherwise(out)
    return out


# Detail pages by site mark and address pattern.
DETAIL_RULES = (
    (r"linkedin\.com", r"/jobs/(?:view|details)/"),
    (r"hh\.ru|headhunter\.ge", r"/vacancy/"),
    (r"career\.habr\.com", r"/vacancies/\d+"),
    (r"trabajo\.gallito\.com\.uy", r"(?i:/anuncio/)[^/?#]+"),
    (r"jobs\.lever\.co", r"jobs\.lever\.co/[^/]+/[^/?#]+"),
    (r"getonbrd\.com", r"/jobs/[^/]+/[^/]+"),
    (r"computrabajo\.com", r"/ofertas-de-trabajo/|/trabajo-"),
    (r"jobspresso\.co", r"/job/"),
    (r"torc\.dev", r"(?i:(?:#/|/)jobs/matches/[a-f0-9-]{8,})"),
    (r"workatastartup\.com", r"/jobs/\d+"),
)


def is_detail_page(url) -> Column:
    """True for the address of one posting, false for lists and unknown pages."""
    raw = text(url)
    revelo = _has(raw, "careers.revelo.com")
    hit = revelo & ~_has(raw, "/home") & raw.rlike("/(?:jobs?|positions?)/")
    for site, pattern in DETAIL_RULES:
        hit = hit | (raw.rlike(site) & raw.rlike(pattern))
    return hit


def without_query(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def canonical_job_url(site, url) -> Column:
    """One spelling per posting and site; '' where the address is not a posting of that site."""
    return let(trim(url), lambda raw: _canonical(text(site), raw, without_query(raw)))


def _canonical(name: Column, raw: Column, bare: Column) -> Column:
    slashless = F.regexp_replace(bare, "^(.+)/$", "$1")
    view = F.regexp_extract(raw, r"(?i)/jobs/view/(\d+)", 1)
    board = F.regexp_extract(bare, r"(?i)https?://(?:www\.)?jobspresso\.co/job/[^/?#]+/?", 0)
    board = F.when(board != "", board).otherwise(bare)
    startup = F.regexp_extract(
        bare,
        r"https?://[^/]*wellfound\.com/(?:company/[^/]+/jobs/\d+(?:-[^/?#]+)?|jobs/\d+(?:-[^/?#]+)?)",
        0,
    )
    hash_route = F.concat(
        F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1),
        F.when(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1) == "", "/").otherwise(
            F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
        ),
        F.regexp_extract(raw, "(#.+)$", 1),
    )
    return (
        F.when(raw == "", "")
        .when(
            name == "linkedin",
            F.when(view != "", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), view, F.lit("/"))).otherwise(""),
        )
        .when(name == "lever", slashless)
        .when(
            name == "jobspresso",
            F.when(board.rlike("(?i)jobspresso\\.co/job/"), F.regexp_replace(board, "^(.+)/$", "$1")).otherwise(""),
        )
        .when(name == "wellfound", startup)
        .when(name == "torc", hash_route)
        .when(name == "workatastartup", bare)
        .otherwise(raw)
    )


# Query parameters that may carry the real target, in order.
REDIRECT_PARAMETERS = ("url", "redirect", "target", "dest", "destination", "redirectUrl")


def _decode_once(value: Column) -> Column:
    plus_kept = F.replace(value, F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(blank_to_null(F.try_url_decode(plus_kept)), value)
    return F.when(value.rlike("%[0-9A-Fa-f]{2}"), decoded).otherwise(value)


def _decoded(value: Column) -> Column:
    """Percent-decode up to four times; a text that cannot be decoded stays."""
    return F.aggregate(F.array_repeat(F.lit(0), 4), value, lambda acc, _: _decode_once(acc))


def _against(origin: Column):
    """Resolve a target against an origin; null unless the result is a web address."""

    def resolve(target: Column) -> Column:
        return (
            F.when(target == "", None)
            .when(target.rlike("^(?i:https?)://"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(F.substring_index(origin, "//", 1), target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
            .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
            .otherwise(F.concat(origin, F.lit("/"), target))
        )

    return resolve


def resolve_redirect(href) -> Column:
    """The target inside a redirect address, else the address; '' unless it is a web address."""
    raw = trim(href)
    query = F.regexp_extract(raw, r"\?([^#]*)", 1)
    origin = F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    values = F.array(*[F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1) for name in REDIRECT_PARAMETERS])
    decoded = F.transform(values, lambda v: _decoded(trim(F.coalesce(F.try_url_decode(v), v))))
    targets = F.filter(F.transform(decoded, _against(origin)), lambda t: t.isNotNull())
    return F.when(
        raw.rlike("^(?i:https?)://[^/?#]"), F.coalesce(F.try_element_at(targets, F.lit(1)), raw)
    ).otherwise("")


def page_number(url) -> Column:
    """The ``page`` parameter, 1 when missing or not positive."""
    digits = F.regexp_extract(text(url), r"[?&]page=" + SPACE + r"*\+?(\d+)", 1)
    value = blank_to_null(digits).try_cast("long")
    return F.when(value >= 1, value).otherwise(F.lit(1).cast("long"))


def page_number_url(url, number) -> Column:
    """The address with its ``page`` parameter set, or dropped for page 1."""
    raw = trim(url)
    wanted = F.col(number) if isinstance(number, str) else number
    fragment = F.regexp_extract(raw, "(#.*)$", 1)
    base = F.substring_index(raw, "#", 1)
    path = F.substring_index(base, "?", 1)
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    is_page = lambda p: F.substring_index(p, "=", 1) == "page"
    at = F.array_position(F.transform(parts, is_page), F.lit(True))
    wanted_part = F.concat(F.lit("page="), wanted.cast("string"))
    set_parts = F.when(at == 0, F.concat(parts, F.array(wanted_part))).otherwise(
        F.filter(
            F.transform(parts, lambda p, i: F.when(i + 1 == at, wanted_part).when(is_page(p), None).otherwise(p)),
            lambda p: p.isNotNull(),
        )
    )
    kept = F.when(wanted <= 1, F.filter(parts, lambda p: ~is_page(p))).otherwise(set_parts)
    joined = F.array_join(kept, "&")
    return F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), F.concat(
        path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)), fragment
    )).otherwise("")
