"""Hand-made rows for every branch of the text, key, date and answer rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolemill.functions import keys, posting_text, responses, text, urls, values
from rolemill.plans import rate


def apply(spark, column, *rows):
    """Values of a column over rows given as tuples c0, c1, …"""
    names = [f"c{i}" for i in range(len(rows[0]))]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_normalize_url(spark):
    got = apply(
        spark,
        keys.normalize_url("c0"),
        ("https://www.Example.com/Jobs/1/?a=1#x",),
        (" HTTPS://m.example.com:8080 ",),
        ("http://user:pw@www.m.site.org/a//",),
        ("www.Site.org/A/?q",),
        ("/relative/path/",),
        ("",),
        (None,),
        ("https://x.com/",),
        ("﻿https://x.com/a ",),
        ("/",),
    )
    assert got == [
        "example.com/Jobs/1", "example.com", "site.org/a/", "www.Site.org/A", "/relative/path", "", "", "x.com", "x.com/a", "/",
    ]


def test_job_and_session_keys(spark):
    rows = [("7", "https://www.a.com/x"), ("", "https://www.a.com/x"), ("7", ""), ("", ""), (" 7 ", "M.b.org/y")]
    assert apply(spark, keys.job_key("c0", "c1"), *rows) == ["id|a.com|7", "url|a.com/x", "id|7", "", "id|b.org|7"]
    assert apply(spark, keys.session_key("c0", "c1"), *rows) == [
        "id|www.a.com|7", "url|www.a.com/x", "id|7", "", "id|m.b.org|7",
    ]
    assert apply(spark, keys.all_keys("c0", "c1"), rows[0], rows[1]) == [
        ["id|a.com|7", "url|a.com/x", "id|a.com|7"], ["url|a.com/x", "url|a.com/x", ""],
    ]


def test_row_key(spark):
    got = apply(
        spark, keys.row_key("c0", "c1", ("c2", "c3"), F.lit(5)), ("1", "", "A", "b"), ("", "", " A  b", "C"), ("", "", "", "")
    )
    assert got == ["id|1", "sig|a b|c", "row|5"]


def test_hashes(spark):
    assert apply(spark, keys.fnv_hash("c0"), ("abc",), ("",)) == ["1a47e90b", "811c9dc5"]
    assert apply(spark, keys.slug_hash("c0"), ("abc",), ("",)) == ["22ci", "0"]


def test_redirects_decode_more_than_once(spark):
    got = apply(
        spark,
        urls.resolve_redirect("c0"),
        ("https://l.com/r?url=https%253A%252F%252Fa.com%252Fx%2520y",),
        ("https://l.com/r?redirect=%2Fjobs",),
        ("https://l.com/plain?x=1",),
        ("mailto:a@b.c",),
        ("https://l.com/r?url=javascript%3Ax&target=https%3A%2F%2Fb.com",),
    )
    assert got == ["https://a.com/x y", "https://l.com/jobs", "https://l.com/plain?x=1", "", "https://b.com"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("/senior|lead/g", "(?i)senior|lead"),
        ("'intern'", "(?i)intern"),
        ('"a\nb"', "(?i)ab"),
        ("", None),
        ("  ", None),
        ("/^x$/m", "(?mi)^x$"),
    ],
)
def test_title_pattern(raw, want):
    assert text.title_deny_pattern(raw) == want


def test_stack_terms(spark):
    def hit(stack, *terms):
        got = apply(spark, rate.negative_stack_hit("c0", terms), (stack,))[0]
        return got and (got["item"], got["term"])

    assert hit("React | R", "r") == ("R", "r")
    assert hit("React", "r") is None
    assert hit("G o | Java", "go") == ("G o", "go")
    assert hit("Ruby on Rails", "on rails") == ("Ruby on Rails", "on rails")
    assert hit("Java | PHP", "php", "java") == ("Java", "java")
    assert hit("", "java") is None
    assert hit("C++ | C#", "c#") == ("C#", "c#")


def test_company_terms(spark):
    def hit(company, *terms):
        return apply(spark, rate.negative_company_hit("c0", terms), (company,))[0]

    assert hit("Acme Labs", "acme") == "acme"
    assert hit("AB Labs", "ab") is None
    assert hit("AB", "ab") == "ab"
    assert hit("Ёлка, ООО", "ёлка") == "ёлка"
    assert hit("", "x") is None


def now():
    return F.lit("2025-03-31 12:00:00").cast("timestamp_ntz")



@pytest.mark.parametrize(
    ("posted", "rule", "compat"),
    [
        ("2 years ago", "ago+year", None),
        ("1 yr ago", "ago+year", None),
        ("2 months ago", "ago+months", None),
        ("3mo ago", "ago+months", None),
        ("2 weeks ago", "", None),
        ("3 weeks ago", "ago+weeks(3-9)", None),
        ("9wks ago", "ago+weeks(3-9)", None),
        ("10 weeks ago", "", None),
        ("a moment ago", "", "ago+months"),
        ("more than 2 days ago", "", "ago+months"),
        ("2025-03-11", "", None),
        ("2025-03-10", "absolute=weeks(3-9)", None),
        ("2025-03-02", "absolute=weeks(3-9)", None),
        ("2025-03-01", "absolute>=1m", None),
        ("2024-03-31", "absolute>=1y", None),
        ("March 1, 2025", "absolute>=1m", None),
        ("nonsense", "", None),
        ("", "", None),
    ],
)
def test_posted_age(spark, posted, rule, compat):
    assert apply(spark, values.posted_age_rule("c0", now()), (posted,)) == [rule]
    want = rule if compat is None else compat
    assert apply(spark, values.posted_age_rule("c0", now(), strict_compat=True), (posted,)) == [want]


def test_relative_dates(spark):
    got = apply(
        spark,
        values.relative_date("c0", now()),
        ("5 days ago",), ("Posted 2 weeks ago",), ("1 month ago",), ("December 19, 2025",), ("dec 3 2025",),
        ("03/04/2025",), ("25/12/2025",), ("31/02/2025",), ("2025-01-02",), ("soon",), ("",), (None,),
    )
    day = dt.date
    assert got == [
        day(2025, 3, 26), day(2025, 3, 17), day(2025, 3, 3), day(2025, 12, 19), day(2025, 12, 3),
        day(2025, 3, 4), day(2025, 12, 25), None, day(2025, 1, 2), None, None, None,
    ]


def test_numbers(spark):
    assert apply(spark, values.lenient_number("c0"), ("4,5",), ("12abc",), ("-1.5e2x",), ("x1",), ("",), (None,)) == [4.5, 12.0, -150.0, None, None, None]
    assert apply(spark, values.positive_int("c0", 9), ("12x",), ("0",), ("-3",), ("",)) == [12, 9, 9, 9]
    assert apply(spark, values.truthy_enabled("c0"), ("FALSE",), ("no",), ("0",), ("",), ("yes",), (None,)) == [False, False, False, True, True, True]


def test_setting_map_keeps_the_last_repeat(spark):
    assert apply(spark, text.setting_map("c0"), (" a=1; b = x=y ;junk;a=2",), ("",)) == [{"a": "2", "b": "x=y"}, {}]


@pytest.mark.parametrize(
    ("answer", "success", "num", "desc"),
    [
        ('```json\n{"rate": "7", "explanation": "ok", "jobShortDesc": " s "}\n```', True, 7, "ok"),
        ('Well {"rate": 4.9, "explanation": ""} end', True, 4, "No explanation provided"),
        ('{"rate": 11, "explanation": "x"}', False, None, None),
        ("RATE: 7\n- a\n* b", True, 7, "- a\n- b"),
        ("text\n 3 \nwhy", True, 3, "why"),
        ("RATE: 12", False, None, None),
        ("no rate here", False, None, None),
        ("", False, None, None),
    ],
)
def test_rate_answers(spark, answer, success, num, desc):
    got = apply(spark, responses.parse_rate("c0"), (answer,))[0]
    assert (got["success"], got["rate_num"], got["rate_desc"]) == (success, num, desc)


def test_final_answers(spark):
    whole = "LRateLeaseId=ab-1\nJobRateNum={}\nShort text\n\nНа самом деле хотят: людей\nещё\n\nx\nLRateResponseComplete=ab-1"
    column = responses.parse_final("c0", F.lit("ab-1"))
    good, ranged, wrong = apply(spark, column, (whole.format("4"),), (whole.format("4-5"),), (whole.replace("LeaseId=ab-1", "LeaseId=zz").format("4"),))
    assert (good["rate_num"], good["short_desc"], good["top3_want"], good["error"]) == (4, "Short text", "людей\nещё", "")
    assert ranged["error"].startswith("Could not parse JobRateNum") and ranged["rate_num"] is None
    assert wrong["error"] == "LRateLeaseId mismatch"


def test_sections(spark):
    got = apply(spark, responses.numbered_sections("c0"), ("1) a\nb\n\n2. c\n- 10) d\n2) e",), ("plain",), ("",))
    assert [[tuple(s) for s in row] for row in got] == [[(1, "a\nb"), (10, "d"), (2, "e")], [(1, "plain")], []]


def test_keyword_rating_is_substring(spark):
    df = spark.createDataFrame(
        [("International sales", "", ["x"], "", ""), ("Dev", "Remote", ["GCP"], "", ""), ("Cook", "", [], "", "")],
        "title string, location string, tags array<string>, description string, enrich_summary string",
    )
    rows = rate.keyword_rate(df, ("intern", "qa"), ("node", "gcp", "remote")).collect()
    assert [(r["rate_num"], r["status"], r["rate_reason"]) for r in rows] == [
        (1, "2Delete", "Deny keywords: intern"),
        (4, "2Apply", "Target keywords: gcp, remote"),
        (3, "new", "No target keywords matched"),
    ]


def test_elements_by_selectors(spark):
    from rolemill.functions import elements as X

    html = "<div class='a b'><p id=x>One<p data-q='tt'>T<b>wo</b></p><a href='/jobs/1'>go &amp; see</a><ul class='s'><li>A<ul><li>in</li></ul><li class=\"k\">B</ul><img alt='pic'></div><script><p>no</p></script><i class='abc'>z</i>"
    rules = X.compiled(
        {
            "first": "div.a p",
            "link": ("#none", 'a[href*="/jobs/"] @href'),
            "quoted": "[data-q='tt']",
            "either": "a[href^='/x'], a",
            "*items": ".s li",
            "picture": "div.a img @alt",
            "word": ".abc",
            "part": '[class$="bc"]',
            "none": (".c", "ab", "p.x"),
            "own": "@class",
        }
    )
    df = spark.createDataFrame([(html, __import__("json").dumps(rules))], "html string, rules string")
    df = df.select(X.without_silent("html").alias("html"), F.from_json("rules", X.KIND).alias("rules"))
    got = df.select(X.values(F.col("html"), F.col("rules")).alias("v")).first().v
    assert got == {
        "first": "One", "link": "/jobs/1", "quoted": "Two", "either": "go & see", "items": "A, in, B", "picture": "pic", "word": "z", "part": "z", "none": "", "own": "",
    }


def test_cards_of_a_long_page(spark):
    from rolemill.plans import extract as E
    from rolemill.sources.boards import default_registry

    many = "".join(f'<div data-qa="vacancy-serp__vacancy"><a href="/vacancy/{i}"><b>Dev</b> {i}</a><p>x<p>y</div>' for i in range(5000))
    df = spark.createDataFrame([(1, "https://hh.ru/search", many)], "row_seq long, url string, html string")
    rows = E.cards(df, default_registry()).select("item_pos", "JobTitle", "JobId").collect()
    assert len(rows) == 5000 and {(r.item_pos, r.JobTitle, r.JobId) for r in rows} == {(i, f"Dev {i}", str(i)) for i in range(5000)}


def test_page_text(spark):
    html = "<style>p{}</style><p>A&nbsp;b<br>c</p><script>x</script><li>d &lt;e&gt;</li>"
    assert apply(spark, posting_text.html_to_lines("c0"), (html,)) == ["A b\nc\nd <e>"]
    assert apply(spark, posting_text.html_to_text("c0"), (html,)) == ["A b c d <e>"]


def test_next_data_of_5_000_listings_and_of_broken_pages(spark):
    import json

    from rolemill.plans import extract as E

    data = {f"JobListing:{i}": {"id": i, "title": f"T{i}", "slug": "s", "startup": {"__ref": f"Startup:{i % 50}"}, "locationNames": ["Lima", str(i)]} for i in range(5000)}
    data |= {f"Startup:{i}": {"name": f"C{i}", "slug": f"c{i}"} for i in range(40)} | {"Other:1": {"title": "x"}}
    page = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"apolloState": {"data": data}}}}) + "</script>"
    df = spark.createDataFrame([(1, page), (2, '<script id="__NEXT_DATA__">{broken</script>'), (3, "none"), (4, None)], "row_seq long, html string")
    rows = {r.JobId: r for r in E.next_data(df).collect()}
    assert len(rows) == 5000
    assert rows["77"].JobUrl == "https://wellfound.com/company/c27/jobs/77-s" and rows["77"].JobCompany == "C27" and rows["77"].JobLocation == "Lima, 77"
    assert rows["49"].JobUrl == "" and rows["49"].JobCompany == ""
