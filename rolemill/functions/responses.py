"""Reading model answers: rates, extracted fields, final ratings, numbered sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions.text import SPACE, blank_to_null, let, pad_three, text, trim, work_mode

# Names under which a short description may come.
SHORT_NAMES = ("job short desc", "jobShortDesc", "job_short_desc", "jobShortDescription", "job_short_description")


def json_block(value) -> Column:
    """The text from the first '{' to the last '}', code fences removed; '' when there is none."""
    bare = F.replace(F.replace(text(value), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def _lines(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "\n"), lambda line: trim(line)), lambda line: line != "")


def _member(block: Column, name: str) -> Column:
    return F.get_json_object(block, f"$['{name}']")


def _line_rate(line: Column) -> Column:
    named = blank_to_null(F.regexp_extract(line, r"(?i)RATE\s*:\s*(\d+)", 1)).try_cast("int")
    lone = blank_to_null(F.regexp_extract(line, r"^(\d+)$", 1)).try_cast("int")
    return F.coalesce(named, F.when(lone.between(0, 10), lone))


def parse_rate(value) -> Column:
    """Struct (success, rate_num, rate_desc, short_desc, error) of a rating answer.

    JSON with rate and explanation first, else a 'RATE: n' line or a lone number
    with the lines behind it as description.
    """
    raw = text(value)
    block = json_block(raw)
    valid = F.try_parse_json(blank_to_null(block)).isNotNull()
    names = F.json_object_keys(block)
    rate = blank_to_null(F.regexp_extract(text(_member(block, "rate")), r"^\s*([+-]?\d+)", 1)).try_cast("int")
    by_json = valid & F.coalesce(F.array_contains(names, "explanation"), F.lit(False)) & F.coalesce(rate.between(0, 10), F.lit(False))
    short = trim(F.coalesce(*[F.when(F.array_contains(names, n), text(_member(block, n))) for n in SHORT_NAMES], F.lit("")))
    told = F.coalesce(blank_to_null(text(_member(block, "explanation"))), F.lit("No explanation provided"))

    lines = _lines(raw)
    rated = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), _line_rate(line).alias("rate"))),
        lambda r: r["rate"].isNotNull(),
    )
    first = F.try_element_at(rated, F.lit(1))
    line_rate = F.when(first["rate"] <= 10, first["rate"])
    rest = F.array_join(F.slice(lines, F.coalesce(first["at"], F.lit(0)) + 2, F.greatest(F.size(lines), F.lit(1))), "\n")
    rest = F.regexp_replace(rest, r"(?m)^[*\-•]\s*", "- ")
    rest = F.coalesce(blank_to_null(trim(rest)), F.lit("No description provided"))
    success = by_json | line_rate.isNotNull()
    error = (
        F.when(success, "")
        .when(raw == "", "Empty or invalid response")
        .when(F.size(lines) == 0, "No lines in response")
        .otherwise(
            F.concat(F.lit("Could not extract valid rate (0-10) from response. Response: "), F.substring(raw, 1, 100))
        )
    )
    return F.struct(
        success.alias("success"),
        F.when(by_json, rate).otherwise(line_rate).alias("rate_num"),
        F.when(by_json, trim(told)).when(line_rate.isNotNull(), rest).alias("rate_desc"),
        F.when(by_json, short).when(line_rate.isNotNull(), "").alias("short_desc"),
        error.alias("error"),
    )


def _three(block: Column, name: str) -> Column:
    found = _member(block, name)
    listed = F.from_json(F.when(F.startswith(found, F.lit("[")), found), "array<string>")
    return pad_three(F.coalesce(listed, F.when(found.isNotNull(), F.array(found))))


def parse_extract(value) -> Column:
    """Struct (success, top3_stack, top3_want, work_mode, error) of an extraction answer."""
    raw = text(value)
    block = json_block(raw)
    valid = F.try_parse_json(blank_to_null(block)).isNotNull()
    unknown = F.array_repeat(F.lit("Unknown"), 3)
    error = (
        F.when(valid, "")
        .when(raw == "", "Empty or invalid response")
        .when(block == "", "No JSON object found")
        .otherwise("Parse error")
    )
    return F.struct(
        valid.alias("success"),
        F.when(valid, _three(block, "JobTop3Stack")).otherwise(unknown).alias("top3_stack"),
        F.when(valid, _three(block, "JobTop3Want")).otherwise(unknown).alias("top3_want"),
        F.when(valid, work_mode(_member(block, "JobWorkMode"))).otherwise("Unknown").alias("work_mode"),
        error.alias("error"),
    )


RATE_MARK = r"(?<!\w)jobratenum\s*[:=]\s*([0-5])(?!\s*[-–—/]\s*[0-9])(?!\w)"
WANT_MARK = r"на\s+самом\s+деле\s+хотят"


def _paragraph(tail: Column) -> Column:
    """The text up to the first blank line, without leading punctuation."""
    open_text = F.regexp_replace(tail, "^[" + SPACE[1:-1] + r":;\-–—]+", "")
    return trim(F.element_at(F.split(open_text, r"\n\s*\n", 2), 1))


def parse_final(value, lease_id) -> Column:
    """Struct (lease_id, rate_num, rate_desc, short_desc, top3_want, error) of a final rating.

    The answer must name the lease twice, at its start mark and in its last line;
    a range such as 4-5 is no rate.
    """
    whole = trim(F.replace(text(value), F.lit("\r\n"), F.lit("\n")))
    expected = trim(lease_id)
    last = F.try_element_at(_lines(whole), F.lit(-1))
    closed = F.regexp_extract(text(last), r"(?i)^LRateResponseComplete\s*[:=]\s*([a-z0-9_-]+)\s*$", 1)
    opened = F.regexp_extract(whole, r"(?i)(?<!\w)lrateleaseid\s*[:=]\s*([a-z0-9_-]+)", 1)
    rate = F.regexp_extract(whole, "(?i)" + RATE_MARK, 1)
    tail = F.regexp_extract(whole, "(?is)^.*?" + RATE_MARK + "(.*)$", 2)
    want = F.regexp_extract(whole, "(?ius)^.*?" + WANT_MARK + "(.*)$", 1)
    error = (
        F.when(whole == "", "Empty LRate response")
        .when(closed == "", "Could not parse final LRateResponseComplete line")
        .when((expected != "") & (closed != expected), "LRateResponseComplete mismatch")
        .when(opened == "", "Could not parse LRateLeaseId in format LRateLeaseId[:|=]<id>")
        .when((expected != "") & (opened != expected), "LRateLeaseId mismatch")
        .when(rate == "", "Could not parse JobRateNum in format JobRateNum[:|=]<0..5>")
        .otherwise("")
    )
    ok = error == ""
    return F.struct(
        F.when(ok, opened).alias("lease_id"),
        F.when(ok, rate.try_cast("int")).alias("rate_num"),
        F.when(ok, whole).alias("rate_desc"),
        F.when(ok, _paragraph(tail)).alias("short_desc"),
        F.when(ok, _paragraph(want)).alias("top3_want"),
        error.alias("error"),
    )


SECTION_MARK = r"(?m)(?:^|\n)\s*(?:[#>*\-]\s*)?(?:\*\*)?(\d{1,2})(?:\*\*)?\s*[).\-:–—]?\s+"


def numbered_sections(value) -> Column:
    """Array of (num, body); text without a marker is section 1, a repeated number keeps its last body."""

    def cut(content):
        marked = F.regexp_replace(content, SECTION_MARK, "\x01$1\x02")
        return let(F.split(marked, "\x01"), lambda pieces: let(_sections(pieces), lambda p: whole(content, p)))

    def whole(content, parts):
        one = F.array(F.struct(F.lit(1).alias("num"), content.alias("body")))
        return F.when(content == "", F.slice(one, 1, 0)).when(F.size(parts) == 0, one).otherwise(_last_per_number(parts))

    return let(trim(F.replace(text(value), F.lit("\r\n"), F.lit("\n"))), cut)


def _sections(pieces: Column) -> Column:
    def read(piece):
        return F.struct(
            F.substring_index(piece, "\x02", 1).try_cast("int").alias("num"),
            trim(F.substring_index(piece, "\x02", -1)).alias("body"),
        )

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), read)


def _last_per_number(parts: Column) -> Column:
    numbers = F.transform(parts, lambda p: p["num"])
    back = lambda p: F.array_position(F.reverse(numbers), p["num"]).cast("int")
    return F.filter(parts, lambda p, i: i == F.size(numbers) - back(p))
