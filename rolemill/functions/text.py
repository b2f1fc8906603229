"""Text columns: whitespace, keys, tags, work mode, titles, markers.

Every function takes and returns columns and stays inside built-in expressions.
A missing text is an empty string, never null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the browser counts as white space.
SPACE_CHARS = "".join(
    map(
        chr,
        [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF],
    )
)
SPACE = (
    r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# White space that has to change: a run that is more than one plain blank. The
# look-aheads reject printable ASCII with a range test before the long class is tried.
SPACE_RUN = "(?=[^!-~])(?: (?=[^!-~])|(?=[^ -~]))" + SPACE + "+"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Bind a value once, so that nested rules do not multiply the expression."""
    return F.transform(F.array(value), body)[0]


def text(value) -> Column:
    """Null to empty text."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def trim(value) -> Column:
    return F.btrim(text(value), F.lit(SPACE_CHARS))


def collapse(value) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.btrim(F.regexp_replace(text(value), SPACE_RUN, " "), F.lit(" "))


def blank_to_null(value) -> Column:
    return F.nullif(col(value), F.lit(""))


def first_filled(*values) -> Column:
    """The first candidate that is not blank after trimming, else ''."""
    return F.coalesce(*[blank_to_null(trim(v)) for v in values], F.lit(""))


def normalize_key(value) -> Column:
    return F.lower(collapse(value))


def join_filled(separator: str, *values) -> Column:
    """Join the non-blank parts."""
    return F.concat_ws(separator, *[blank_to_null(v) for v in values])


# --- stack and company text -------------------------------------------------


def normalize_stack(value) -> Column:
    kept = F.regexp_replace(F.upper(text(value)), r"[^A-Z0-9+#.\- ]+", " ")
    return F.btrim(F.regexp_replace(kept, " +", " "), F.lit(" "))


def stack_tokens(value) -> Column:
    return F.filter(F.split(normalize_stack(value), " "), lambda t: t != "")


def compact_stack(value) -> Column:
    return F.replace(normalize_stack(value), F.lit(" "), F.lit(""))


def normalize_company(value) -> Column:
    kept = F.regexp_replace(F.lower(text(value)), r"[^\p{L}\p{N}\s&+.\-]", " ")
    return collapse(kept)


# --- arrays -----------------------------------------------------------------


def normalize_tags(value) -> Column:
    """Array or separated text to trimmed, non-blank tags."""
    return F.filter(
        F.transform(F.split(text(value), r"[,\n|]"), lambda t: trim(t)), lambda t: t != ""
    )


def normalize_tag_array(values) -> Column:
    return F.filter(F.transform(col(values), lambda t: trim(t)), lambda t: t != "")


def pad_three(values) -> Column:
    """Exactly three entries, padded with 'Unknown'."""
    kept = normalize_tag_array(F.coalesce(col(values), F.array().cast("array<string>")))
    return F.slice(F.concat(kept, F.array_repeat(F.lit("Unknown"), 3)), 1, 3)


def distinct_tags(values, fold: bool = False, limit: int | None = None) -> Column:
    """Order-preserving distinct; ``fold`` compares in lower case."""
    items = normalize_tag_array(values)
    if fold:
        items = F.transform(items, F.lower)
    items = F.array_distinct(items)
    return F.slice(items, 1, limit) if limit else items


def setting_list(value) -> Column:
    """Comma list to trimmed lower-case entries."""
    return F.filter(
        F.transform(F.split(text(value), ","), lambda t: F.lower(trim(t))), lambda t: t != ""
    )


def setting_map(value) -> Column:
    """``a=b;c=d`` to a map; parts without '=' are skipped, the last repeat wins."""
    parts = F.filter(
        F.transform(F.split(text(value), ";"), lambda p: trim(p)), lambda p: F.contains(p, F.lit("="))
    )
    names = F.transform(parts, lambda p: trim(F.substring_index(p, "=", 1)))
    values = F.transform(parts, lambda p: trim(_after(p, "=")))
    keep = F.filter(
        F.arrays_zip(
            names.alias("k"), values.alias("v"), F.transform(names, lambda n, i: i).alias("i")
        ),
        lambda z: z["i"] == F.size(names) - F.array_position(F.reverse(names), z["k"]),
    )
    return F.map_from_arrays(F.transform(keep, lambda z: z["k"]), F.transform(keep, lambda z: z["v"]))


def _after(value: Column, mark: str) -> Column:
    """Text behind the first ``mark``; '' when it is absent."""
    return F.regexp_extract(value, "(?s)^.*?" + re.escape(mark) + "(.*)$", 1)


# --- work mode, level -------------------------------------------------------


def work_mode(value) -> Column:
    raw = F.lower(trim(value))
    return (
        F.when(raw == "remote", "Remote")
        .when(raw == "onsite", "Onsite")
        .when(raw == "hybrid", "Hybrid")
        .otherwise("Unknown")
    )


def infer_work_mode(location, description) -> Column:
    hay = F.lower(F.concat_ws(" ", text(location), text(description)))
    return (
        F.when(F.contains(hay, F.lit("remote")), "Remote")
        .when(F.contains(hay, F.lit("hybrid")), "Hybrid")
        .when(F.contains(hay, F.lit("onsite")) | F.contains(hay, F.lit("on-site")), "Onsite")
        .otherwise("Unknown")
    )


# Title words and their level, first hit wins.
LEVEL_WORDS = (
    (r"(?<!\w)(?:internship|intern)(?!\w)", "Intern"),
    (r"(?<!\w)junior(?!\w)", "Junior"),
    (r"(?<!\w)middle(?!\w)", "Middle"),
    (r"(?<!\w)senior(?!\w)", "Senior"),
    (r"(?<!\w)lead(?!\w)", "Lead"),
)
RANGE = r"(\d+)\s*[–—-]\s*(\d+)"


def modality_seniority(title, experience) -> Column:
    low = F.lower(text(title))
    flat = collapse(experience)
    bounds = F.concat_ws("-", F.regexp_extract(flat, RANGE, 1), F.regexp_extract(flat, RANGE, 2))
    level = F.lit(None).cast("string")
    for pattern, name in reversed(LEVEL_WORDS):
        level = F.when(low.rlike(pattern), name).otherwise(level)
    by_years = (
        F.when(bounds.rlike("^0*1-0*3$"), "Middle").when(bounds.rlike("^0*3-0*6$"), "Senior")
    )
    return F.coalesce(level, by_years, F.lit(""))


def experience_range(value) -> Column:
    pattern = r"(?iu)(\d+)\s*[–—-]\s*(\d+)\s*(?:года|лет)"
    flat = collapse(value)
    low, high = F.regexp_extract(flat, pattern, 1), F.regexp_extract(flat, pattern, 2)
    return F.when(low != "", F.concat(low, F.lit("–"), high, F.lit(" года"))).otherwise("")


PUBLISHED = r"Вакансия опубликована\s+(\d{1,2}\s+[А-Яа-яЁё]+(?:\s+\d{4})?)\s+в\s+(.+?)(?:\s+[•·–—-]|$)"


def published_info(value) -> tuple[Column, Column]:
    """Posted date and city from the Russian publication sentence."""
    flat = collapse(value)
    return trim(F.regexp_extract(flat, PUBLISHED, 1)), trim(F.regexp_extract(flat, PUBLISHED, 2))


# --- cutting, markers, messages ---------------------------------------------


def truncate(value, limit: int, mark: str = "...") -> Column:
    body = text(value)
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit(mark))).otherwise(body)


def labelled_lines(pairs) -> Column:
    """``Label: value`` lines, blank values skipped."""
    lines = [
        F.when(text(value) != "", F.concat(F.lit(label + ": "), text(value))) for label, value in pairs
    ]
    return F.concat_ws("\n", *lines)


def fill_template(template, values: dict) -> Column:
    """Replace ``{Name}`` placeholders one after the other."""
    out = text(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), text(value))
    return out


def title_deny_pattern(raw: str | None) -> str | None:
    """A setting value to a Java pattern: line breaks and quotes dropped, ``/p/flags`` read."""
    value = re.sub(r"[\r\n]+", "", (raw or "").strip())
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1].strip()
    flags = ""
    delimited = re.fullmatch(r"/(.+)/([A-Za-z]*)", value)
    if delimited:
        value, flags = delimited.groups()
    value = value.strip()
    if not value:
        return None
    kept = "".join(dict.fromkeys(f for f in flags + "i" if f in "ims"))
    return f"(?{kept}){value}"


_WORD = "[0-9A-Za-z_]"
_EDGE = {
    r"\b": f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))",
    r"\B": f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))",
}


def ascii_edges(pattern: str) -> str:
    """The pattern with word edges between ASCII letters, digits and ``_`` alone, as settings mean them.

    In Java ``\\b`` also counts other letters, before version 19 at least, and finds no edge in ``quí``.
    """
    return re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", lambda m: _EDGE.get(m[0], m[0]), pattern, flags=re.DOTALL)
