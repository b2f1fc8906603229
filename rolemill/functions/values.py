"""Numbers, flags and dates in loose text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import blank_to_null, collapse, let, text, trim

NUMBER_PREFIX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def lenient_number(value) -> Column:
    """Leading number of a text, decimal comma allowed, null when there is none."""
    raw = F.regexp_replace(trim(value), "^([^,]*),", "$1.")
    return blank_to_null(F.regexp_extract(raw, NUMBER_PREFIX, 0)).try_cast("double")


def number_or_zero(value) -> Column:
    return F.coalesce(lenient_number(value), F.lit(0.0))


def leading_int(value) -> Column:
    """Leading whole number, null when there is none."""
    return blank_to_null(F.regexp_extract(trim(value), r"^[+-]?\d+", 0)).try_cast("int")


def positive_int(value, fallback: int) -> Column:
    number = leading_int(value)
    return F.when(number > 0, number).otherwise(F.lit(fallback))


def non_negative_int(value, fallback: int) -> Column:
    number = leading_int(value)
    return F.when(number >= 0, number).otherwise(F.lit(fallback))


def truthy_enabled(value) -> Column:
    """False for false / 'false' / 'no' / '0', true for anything else."""
    return ~F.lower(trim(value)).isin("false", "no", "0")


# --- dates ------------------------------------------------------------------

ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
# Month names as they begin in postings.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = (
    "(?i)(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date from its text parts; null when there is no such day."""
    parts = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(parts, F.lit("yyyy-MM-dd"))


def instant(value) -> Column:
    """ISO text or 'Month d, yyyy' to a timestamp, null when unreadable."""
    raw = trim(value)
    iso = F.when(raw.rlike(ISO), raw).try_cast("timestamp")
    pattern = rf"^{MONTH_NAME}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(raw, 1, 3)))
    named = F.when(
        raw.rlike(pattern),
        _date(F.regexp_extract(raw, pattern, 2), month.cast("string"), F.regexp_extract(raw, pattern, 1)),
    )
    return F.coalesce(iso, named)


def cell_instant(value) -> Column:
    """A cell with epoch milliseconds, ISO text or a named date."""
    raw = trim(value)
    millis = F.when(raw.rlike(r"^\d{10,14}$"), raw).try_cast("long")
    return F.coalesce(F.timestamp_millis(millis), instant(raw))


def day_key(value) -> Column:
    """UTC day of ISO text, '' when it is not a date."""
    return F.coalesce(F.date_format(instant(value), "yyyy-MM-dd"), F.lit(""))


def day_text(date: Column) -> Column:
    """yyyy-MM-dd; a year before 0 has a sign and no leading zeros."""
    year = F.year(date).cast("string")
    padded = F.when(F.year(date) < 0, year).otherwise(F.lpad(year, F.greatest(F.lit(4), F.length(year)), "0"))
    return F.concat(padded, F.date_format(date, "-MM-dd"))


def relative_date(value, as_of) -> Column:
    """'n days/weeks/months ago', an absolute date, m/d/y where it exists, else d/m/y.

    Months step back by the calendar and roll over: 31 March less one month is
    the 31st day counted from 1 February.
    """
    now = F.to_date(as_of)

    def ago(low, unit):
        return blank_to_null(F.regexp_extract(low, rf"(\d+)\s*{unit}s?\s*ago", 1)).try_cast("int")

    def stepped(low):
        months = ago(low, "month")
        rolled = F.date_add(F.trunc(F.add_months(now, -months), "MM"), F.dayofmonth(now) - 1)
        return F.coalesce(F.date_sub(now, ago(low, "day")), F.date_sub(now, ago(low, "week") * 7), rolled)

    def year(raw, pattern):
        return F.regexp_extract(raw, pattern, 3).try_cast("int").between(2001, 2099)

    def named(raw):
        found = rf"({MONTH_NAME})\s+(\d{{1,2}}),?\s+(\d{{4}})"
        part = lambda i: F.regexp_extract(raw, found, i)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3)))
        return F.when(year(raw, found), F.to_date(_date(part(3), month.cast("string"), part(2))))

    def slashed(raw):
        pattern = r"(\d{1,2})/(\d{1,2})/(\d{4})"
        part = lambda i: F.regexp_extract(raw, pattern, i)
        dates = F.coalesce(F.to_date(_date(part(3), part(1), part(2))), F.to_date(_date(part(3), part(2), part(1))))
        return F.when(year(raw, pattern), dates)

    def read(raw):
        relative = F.when(raw.rlike("(?i)\\dago|\\d.*ago"), stepped(F.lower(raw)))
        plain = F.when(F.contains(raw, F.lit("/")), slashed(raw)).otherwise(
            F.coalesce(F.to_date(instant(raw)), named(raw))
        )
        return F.coalesce(relative, F.when(raw.rlike("\\d{4}"), plain))

    return let(trim(value), read)


def posted_age_rule(value, as_of, strict_compat: bool = False) -> Column:
    """The age rule a posting breaks, '' when none.

    ``strict_compat`` also takes any 'MO' inside a word for months, as in
    'a moment ago'; the default wants a whole word or a number before it.
    """
    raw = trim(value)

    def judge(flat: Column, packed: Column) -> Column:
        ago = F.contains(packed, F.lit("AGO"))
        months = packed.rlike("MO") if strict_compat else (
            flat.rlike(r"(?<!\w)(?:MONTHS?|MOS?)(?!\w)") | packed.rlike(r"\d(?:MONTHS?|MOS?)(?:AGO|$)")
        )
        spaced = F.regexp_extract(flat, r"(\d+)\s*(?:WEEKS?|WKS?)(?!\w)", 1)
        joined = F.regexp_extract(packed, r"(\d+)(?:WEEK|WK)", 1)
        weeks = F.coalesce(blank_to_null(spaced), blank_to_null(joined)).try_cast("int")
        return (
            F.when(ago & packed.rlike("YEAR|YR"), "ago+year")
            .when(ago & months, "ago+months")
            .when(ago & weeks.between(3, 9), "ago+weeks(3-9)")
            .otherwise(let(_age_days(raw, as_of), _by_days))
        )

    flat = collapse(F.regexp_replace(F.upper(raw), r"[\x{200B}-\x{200D}\x{FEFF}]", ""))
    return let(flat, lambda f: let(F.regexp_replace(f, "[^A-Z0-9]", ""), lambda p: judge(f, p)))


def _age_days(raw: Column, as_of: Column) -> Column:
    passed = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(instant(raw))
    return F.floor(passed / F.lit(86_400_000_000))


def _by_days(age: Column) -> Column:
    return (
        F.when(age >= 365, "absolute>=1y")
        .when(age >= 30, "absolute>=1m")
        .when(age.between(21, 63), "absolute=weeks(3-9)")
        .otherwise("")
    )
