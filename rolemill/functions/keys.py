"""Identity columns: normalised URLs, composite keys, hashes, site rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import (
    blank_to_null,
    collapse,
    join_filled,
    let,
    normalize_key,
    text,
    trim,
)

# One pass over an absolute web address: user part, www./m., port, query, fragment
# and one trailing slash go; host and path stay, split by a mark.
WEB = (
    r"(?s)^(?i:https?|ftp|wss?)://(?:[^/?#@]*+@)?(?i:www\.)?(?i:m\.)?([^/?#:@]++)(?::\d*+)?([^?#]*?)/?(?:[?#].*)?$"
)
WEB_WHOLE_HOST = r"(?s)^(?i:https?|ftp|wss?)://(?:[^/?#@]*+@)?([^/?#:@]++)(?::\d*+)?([^?#]*?)/?(?:[?#].*)?$"
CUT, MARK = "\x01", "\x02"


def _without_scheme(raw: Column) -> Column:
    return F.regexp_replace(raw, "^(?i:https?)://", "")


def _cleaned(raw: Column) -> Column:
    """Relative or odd addresses: cut fragment and query, drop the scheme and one trailing slash."""
    cut = trim(F.substring_index(F.substring_index(raw, "#", 1), "?", 1))
    return F.regexp_replace(_without_scheme(cut), "(?s)^(.+)/$", "$1")


def _short_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(trim(host)), r"^(?:www\.)?(?:m\.)?", "")


def _host_and_url(url) -> Column:
    """Host, a mark, then the normalised address."""

    def odd(raw):
        clean = _cleaned(raw)
        return F.concat(_short_host(F.substring_index(clean, "/", 1)), F.lit(MARK), clean)

    def web(raw):
        def put(parts):
            host = F.lower(F.substring_index(parts, CUT, 1))
            whole = F.concat(host, F.lit(MARK), host, F.substring_index(parts, CUT, -1))
            return F.when(F.contains(parts, F.lit(CUT)), whole).otherwise(odd(raw))

        return let(F.regexp_replace(raw, WEB, "$1" + CUT + "$2"), put)

    return web(trim(url))


def _host(pair: Column) -> Column:
    return F.substring_index(pair, MARK, 1)


def _url(pair: Column) -> Column:
    return F.substring_index(pair, MARK, -1)


def url_host(url) -> Column:
    return _host(_host_and_url(url))


def normalize_url(url) -> Column:
    """Host and path, host lower-case without ``www.``/``m.``, one trailing slash off."""
    return _url(_host_and_url(url))


def _by_id(ident: Column, host: Column) -> Column:
    return F.when(host != "", F.concat_ws("|", F.lit("id"), host, ident)).otherwise(F.concat(F.lit("id|"), ident))


def _by_url(address: Column) -> Column:
    return F.when(address != "", F.concat(F.lit("url|"), address)).otherwise("")


def _job_key(ident: Column, pair: Column) -> Column:
    named = (ident != "") & ((_host(pair) != "") | (_url(pair) == ""))
    return F.when(named, _by_id(ident, _host(pair))).otherwise(_by_url(_url(pair)))


def job_key(job_id, url) -> Column:
    """``id|host|id``, else ``url|…``, else ``id|…``, else ''."""
    return let(_host_and_url(url), lambda pair: _job_key(trim(job_id), pair))


def url_key(url) -> Column:
    return _by_url(normalize_url(url))


def id_key(job_id, url) -> Column:
    ident = trim(job_id)
    return F.when(ident != "", _by_id(ident, url_host(url))).otherwise("")


def all_keys(job_id, url) -> Column:
    """Array of job, address and id key, from one reading of the address."""
    ident = trim(job_id)

    def three(pair):
        by_id = F.when(ident != "", _by_id(ident, _host(pair))).otherwise("")
        return F.array(_job_key(ident, pair), _by_url(_url(pair)), by_id)

    return let(_host_and_url(url), three)


def session_key(job_id, url) -> Column:
    """Key of one scrape session: the id wins over the address, the host keeps its prefix."""
    ident, raw = trim(job_id), trim(url)

    def put(parts):
        web = F.contains(parts, F.lit(CUT))
        host = F.lower(F.when(web, F.substring_index(parts, CUT, 1)).otherwise(F.substring_index(_without_scheme(raw), "/", 1)))
        address = F.when(web, F.concat(host, F.substring_index(parts, CUT, -1))).otherwise(F.lower(_cleaned(raw)))
        return F.when(ident != "", _by_id(ident, host)).otherwise(_by_url(address))

    return let(F.regexp_replace(raw, WEB_WHOLE_HOST, "$1" + CUT + "$2"), put)


def null_if_blank_key(key: Column) -> Column:
    return blank_to_null(key)


# --- hashes -----------------------------------------------------------------


def job_id_hash(source_id, external_id, url) -> Column:
    ident = trim(external_id)
    part = F.when(ident != "", ident).otherwise(F.lower(trim(url)))
    return F.sha2(F.concat(text(source_id), F.lit("|"), part), 256)


def dedupe_key(title, company, location, apply_url) -> Column:
    parts = [normalize_key(v) for v in (title, company, location, apply_url)]
    return F.sha2(F.concat_ws("|", *parts), 256)


# The fields of a row snapshot, in order.
SNAPSHOT_FIELDS = (
    "JobId",
    "JobUrl",
    "JobApplyUrl",
    "JobTitle",
    "JobCompany",
    "JobLocation",
    "JobSeniority",
    "JobModality",
    "JobEasyApplyFlg",
    "JobSalary",
    "JobTags",
    "JobDescription",
)


def snapshot_hash(columns) -> Column:
    """Hash of the twelve ``Name=value`` lines; fields missing from ``columns`` count as blank."""
    lines = [
        F.concat(F.lit(name + "="), collapse(name) if name in columns else F.lit(""))
        for name in SNAPSHOT_FIELDS
    ]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def stable_key(job_id, url) -> Column:
    return job_key(job_id, url)


def signature(*parts) -> Column:
    """Normalised parts joined with '|', blanks skipped."""
    return join_filled("|", *[normalize_key(p) for p in parts])


def row_key(job_id, url, parts, row_num) -> Column:
    key, sig = stable_key(job_id, url), signature(*parts)
    return (
        F.when(key != "", key)
        .when(sig != "", F.concat(F.lit("sig|"), sig))
        .otherwise(F.concat(F.lit("row|"), text(row_num)))
    )


WORD = (1 << 32) - 1


def _big(number: int) -> Column:
    return F.lit(number).cast("long")


def _code_units(value) -> Column:
    """UTF-16 code units of a text, as numbers."""
    digits = F.hex(F.encode(text(value), "UTF-16BE"))
    return F.transform(F.regexp_extract_all(digits, F.lit("(.{4})")), lambda u: F.conv(u, 16, 10).cast("long"))


def fnv_hash(value) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as hex without leading zeros.

    The prime 16777619 is 2**24 + 403, so the product is built without overflow.
    """

    def step(acc, code):
        mixed = acc.bitwiseXOR(code)
        high = mixed.bitwiseAND(_big(0xFF)) * _big(1 << 24)
        return (high + mixed * _big(403)).bitwiseAND(_big(WORD))

    return F.lower(F.hex(F.aggregate(_code_units(value), _big(2166136261), step)))


def slug_hash(value) -> Column:
    """Signed 32-bit hash with multiplier 31, absolute value, base 36."""
    total = F.aggregate(
        _code_units(value),
        _big(0),
        lambda acc, code: (acc * _big(31) + code).bitwiseAND(_big(WORD)),
    )
    signed = F.when(total >= _big(1 << 31), total - _big(1 << 32)).otherwise(total)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))
