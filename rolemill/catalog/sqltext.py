"""DuckDB spellings of the shared text rules, written for the comparison queries only."""

from __future__ import annotations

from rolemill.functions.text import SPACE


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def trim(x: str) -> str:
    return f"regexp_replace({text(x)}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({text(x)}, '{SPACE}+', ' ', 'g'), ' ')"


def key(x: str) -> str:
    return f"lower({collapse(x)})"


HOST = "^(?i:https?|ftp|wss?)://(?:[^/?#@]*@)?([^/?#:@]+)"


def raw_host(x: str) -> str:
    return f"lower(regexp_extract({trim(x)}, '{HOST}', 1))"


def raw_path(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({trim(x)}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def short_host(h: str) -> str:
    return rf"regexp_replace(lower({trim(h)}), '^(?:www\.)?(?:m\.)?', '')"


def one_slash_off(x: str) -> str:
    return rf"regexp_replace({x}, '^((?s).+)/$', '\1')"


def no_scheme(x: str) -> str:
    return f"regexp_replace({x}, '^(?i:https?)://', '')"


def cleaned(x: str) -> str:
    return one_slash_off(no_scheme(trim(f"split_part(split_part({trim(x)}, '#', 1), '?', 1)")))


def url_host(x: str) -> str:
    first = f"split_part({cleaned(x)}, '/', 1)"
    return f"CASE WHEN {raw_host(x)} <> '' THEN {short_host(raw_host(x))} ELSE {short_host(first)} END"


def norm_url(x: str) -> str:
    full = f"({short_host(raw_host(x))} || {raw_path(x)})"
    return f"CASE WHEN {raw_host(x)} <> '' THEN {one_slash_off(full)} ELSE {cleaned(x)} END"


def job_key(i: str, u: str) -> str:
    ident, host, norm = trim(i), f"({url_host(u)})", f"({norm_url(u)})"
    return (
        f"CASE WHEN {ident} <> '' AND {host} <> '' THEN 'id|' || {host} || '|' || {ident} "
        f"WHEN {norm} <> '' THEN 'url|' || {norm} WHEN {ident} <> '' THEN 'id|' || {ident} ELSE '' END"
    )


def url_key(u: str) -> str:
    norm = f"({norm_url(u)})"
    return f"CASE WHEN {norm} <> '' THEN 'url|' || {norm} ELSE '' END"


def id_key(i: str, u: str) -> str:
    ident, host = trim(i), f"({url_host(u)})"
    return (
        f"CASE WHEN {ident} = '' THEN '' WHEN {host} <> '' THEN 'id|' || {host} || '|' || {ident} "
        f"ELSE 'id|' || {ident} END"
    )


def session_key(i: str, u: str) -> str:
    ident = trim(i)
    host = (
        f"(CASE WHEN {raw_host(u)} <> '' THEN {raw_host(u)} "
        f"ELSE lower(split_part({no_scheme(trim(u))}, '/', 1)) END)"
    )
    address = (
        f"(CASE WHEN {raw_host(u)} <> '' THEN {raw_host(u)} || {one_slash_off(raw_path(u))} "
        f"ELSE lower({cleaned(u)}) END)"
    )
    return (
        f"CASE WHEN {ident} <> '' AND {host} <> '' THEN 'id|' || {host} || '|' || {ident} "
        f"WHEN {ident} <> '' THEN 'id|' || {ident} "
        f"WHEN {address} <> '' THEN 'url|' || {address} ELSE '' END"
    )


def signature(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"nullif({key(p)}, '')" for p in parts) + ")"


def first_filled(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({trim(v)}, '')" for v in values) + ", '')"


def infer_work_mode(location: str, description: str) -> str:
    hay = f"lower({text(location)} || ' ' || {text(description)})"
    return (
        f"CASE WHEN contains({hay}, 'remote') THEN 'Remote' WHEN contains({hay}, 'hybrid') THEN 'Hybrid' "
        f"WHEN contains({hay}, 'onsite') OR contains({hay}, 'on-site') THEN 'Onsite' ELSE 'Unknown' END"
    )


def snapshot_hash(columns) -> str:
    from rolemill.functions.keys import SNAPSHOT_FIELDS

    lines = [f"'{n}=' || " + (collapse(n) if n in columns else "''") for n in SNAPSHOT_FIELDS]
    return "sha256(" + " || chr(10) || ".join(lines) + ")"


def stack(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(upper(replace({text(x)}, 'ß', 'SS')), '[^A-Z0-9+#.\\- ]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"
    )


def company(x: str) -> str:
    return collapse(rf"regexp_replace(lower({text(x)}), '[^\p{{L}}\p{{N}}\s&+.\-]', ' ', 'g')")
