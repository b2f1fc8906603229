"""Rating stages: title pattern, one winner per company and title, negative terms, keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions import values
from rolemill.functions.text import (
    infer_work_mode,
    join_filled,
    normalize_company,
    normalize_key,
    normalize_stack,
    text,
    trim,
    work_mode,
)
from rolemill.operators.filters import title_denied
from rolemill.operators.winners import SEQ, best_rows, mark

# --- title pattern ------------------------------------------------------------


def simple_rate(df: DataFrame, pattern: str, as_of: Column) -> DataFrame:
    """Loaded rows: rate 0 and out where the title is denied, else rate 5 and on."""
    mine = trim("Status") == "Loaded"
    denied = title_denied("JobTitle", pattern)

    def put(value, old):
        return F.when(mine, value).otherwise(F.col(old))

    return df.withColumns(
        {
            "JobRateNum": put(F.when(denied, F.lit(0.0)).otherwise(5.0), "JobRateNum"),
            "JobRateDesc": put(
                F.when(denied, "Title matched deny regex").otherwise("Title passed deny regex"), "JobRateDesc"
            ),
            "JobRateShortDesc": put(F.lit(""), "JobRateShortDesc"),
            "JobRateDttm": put(as_of, "JobRateDttm"),
            "RatedModelName": put(F.lit("TitleRegex"), "RatedModelName"),
            "Status": put(F.when(denied, "2Delete").otherwise("2MARate"), "Status"),
        }
    )


# --- one winner per company and title -----------------------------------------

# Places by preference.
PLACE_RANK = (("uruguay", 3), ("montevideo", 2), ("latin americ", 1))


def place_priority(location) -> Column:
    low = F.lower(text(location))
    rank = F.lit(0)
    for mark_text, value in reversed(PLACE_RANK):
        rank = F.when(F.contains(low, F.lit(mark_text)), value).otherwise(rank)
    return rank


def location_winners(df: DataFrame) -> DataFrame:
    """Row number of the preferred place per company and title; blank names take no part."""
    keyed = df.filter((trim("JobCompany") != "") & (trim("JobTitle") != "")).select(
        SEQ,
        normalize_key("JobCompany").alias("_company"),
        normalize_key("JobTitle").alias("_title"),
        place_priority("JobLocation").alias("_rank"),
    )
    return best_rows(keyed, ["_company", "_title"], "_rank").select(SEQ)


def medium_a_rate(df: DataFrame) -> DataFrame:
    """Winners go on to 2MBrate, other rows of the group out; rows without a name stay."""
    mine = trim("Status").isin("2MARate", "2Mrate") & (trim("JobCompany") != "") & (trim("JobTitle") != "")
    marked = mark(df, location_winners(df.filter(mine)), "_winner")
    loser = mine & ~F.col("_winner")
    desc = join_filled("; ", trim("JobRateDesc"), F.lit("Location DBL"))
    return marked.withColumns(
        {
            "Status": F.when(loser, "2Delete").when(mine, "2MBrate").otherwise(F.col("Status")),
            "JobRateDesc": F.when(loser, desc).otherwise(F.col("JobRateDesc")),
        }
    ).drop("_winner")


# --- negative terms -----------------------------------------------------------


def _stack_term(term: str) -> str:
    return re.sub(" +", " ", re.sub(r"[^A-Z0-9+#.\- ]+", " ", term.upper())).strip(" ")


def negative_stack_hit(stack, terms) -> Column:
    """First (item, term) hit by item order, then term order; null when none.

    A one-word term must be a whole word of the item (up to three letters also
    the item without its blanks), a longer one is a phrase. The terms come from
    settings, so they are part of the expression and nothing is joined.
    """
    items = F.filter(F.transform(F.split(text(stack), r"\|"), lambda i: trim(i)), lambda i: i != "")
    pairs = F.transform(items, lambda i: F.struct(i.alias("item"), normalize_stack(i).alias("flat")))

    def hit(flat: Column) -> Column:
        padded = F.concat(F.lit(" "), flat, F.lit(" "))
        tests = []
        for term in terms:
            word = _stack_term(term)
            if not word:
                continue
            if " " in word:
                found = F.contains(flat, F.lit(word))
            else:
                found = F.contains(padded, F.lit(f" {word} "))
                if len(word) <= 3:
                    found = found | (F.replace(flat, F.lit(" "), F.lit("")) == word)
            tests.append(F.when(found, F.lit(term)))
        return F.coalesce(*tests) if tests else F.lit(None).cast("string")

    hits = F.transform(pairs, lambda p: F.struct(p["item"].alias("item"), hit(p["flat"]).alias("term")))
    return F.try_element_at(F.filter(hits, lambda h: h["term"].isNotNull()), F.lit(1))


def _company_term(term: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s&+.\-]|_", " ", term.lower())).strip()


def negative_company_hit(company, terms) -> Column:
    """First term that equals the company, or is inside it when at least three letters long."""
    flat = normalize_company(company)
    tests = []
    for term in terms:
        name = _company_term(term)
        if not name:
            continue
        found = flat == name
        if len(name) >= 3:
            found = found | F.contains(flat, F.lit(name))
        tests.append(F.when((flat != "") & found, F.lit(term)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def medium_c_rate(df: DataFrame, stack_terms, company_terms, as_of: Column, strict_compat: bool = False) -> DataFrame:
    """Rows in 2MCRate: out with all reasons, or on to the final rating."""
    mine = trim("Status") == "2MCRate"
    stack, company = F.col("_stack"), F.col("_company")
    mode, age = F.col("_mode"), F.col("_age")
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    reasons = F.array_compact(
        F.array(
            F.when(stack.isNotNull(), quoted('StackNegative hit "', stack["term"], '" in "', stack["item"], '"')),
            F.when(company.isNotNull(), quoted('CompanyNegative hit "', company, '" in "', text("JobCompany"), '"')),
            F.when(mode.isin("Onsite", "Hybrid"), quoted("JobWorkMode=", mode)),
            F.when(age != "", quoted("JobPostedDttm rule ", age, ' in "', trim("JobPostedDttm"), '"')),
        )
    )
    judged = df.withColumns(
        {
            "_stack": negative_stack_hit("JobTop3Stack", stack_terms),
            "_company": negative_company_hit("JobCompany", company_terms),
            "_mode": work_mode("JobWorkMode"),
            "_age": values.posted_age_rule("JobPostedDttm", as_of, strict_compat),
        }
    ).withColumn("_reasons", reasons)
    bad = F.size("_reasons") > 0
    note = F.when(bad, F.concat(F.lit("Medium CRate: "), F.array_join("_reasons", "; "))).otherwise(
        F.concat(F.lit("Medium CRate: no StackNegative/CompanyNegative hit; JobWorkMode="), mode)
    )
    return judged.withColumns(
        {
            "JobRateDesc": F.when(mine, note).otherwise(F.col("JobRateDesc")),
            "Status": F.when(mine & bad, "2Delete").when(mine, "2LRate").otherwise(F.col("Status")),
        }
    ).drop("_stack", "_company", "_mode", "_age", "_reasons")


# --- keyword rating -------------------------------------------------------------


def _hits(hay: Column, words) -> Column:
    return F.concat_ws(", ", *[F.when(F.contains(hay, F.lit(w)), F.lit(w)) for w in words]) if words else F.lit("")


def keyword_rate(df: DataFrame, deny, target, tags="tags") -> DataFrame:
    """Substring rating: a deny word gives 1, a target word 4, neither 3; hits in configured order."""
    hay = F.lower(
        F.concat_ws(
            " ", text("title"), text("location"), F.array_join(tags, " "), text("description"), text("enrich_summary")
        )
    )
    scored = df.withColumn("_hay", hay).withColumns(
        {"_deny": _hits(F.col("_hay"), deny), "_target": _hits(F.col("_hay"), target)}
    )
    denied, wanted = F.col("_deny") != "", F.col("_target") != ""
    return scored.withColumns(
        {
            "rate_provider": F.lit("rule-based"),
            "rated_model": F.lit("rule-based-v1"),
            "rate_num": F.when(denied, 1).when(wanted, 4).otherwise(3),
            "status": F.when(denied, "2Delete").when(wanted, "2Apply").otherwise("new"),
            "rate_reason": F.when(denied, F.concat(F.lit("Deny keywords: "), "_deny"))
            .when(wanted, F.concat(F.lit("Target keywords: "), "_target"))
            .otherwise("No target keywords matched"),
        }
    ).drop("_hay", "_deny", "_target")


# --- stored jobs: normalise, enrich ---------------------------------------------


def normalize_stage(df: DataFrame, version: int) -> DataFrame:
    from rolemill.functions.keys import dedupe_key
    from rolemill.functions.text import blank_to_null

    due = F.coalesce("normalize_version", F.lit(0)) < version
    address = F.coalesce(blank_to_null(text("apply_url")), text("canonical_url"))
    made = {
        "normalized_title": normalize_key("title"),
        "normalized_company": normalize_key("company"),
        "normalized_location": normalize_key("location"),
        "normalized_apply_url": normalize_key(address),
        "dedupe_key": dedupe_key("title", "company", "location", address),
        "pipeline_stage": F.lit("normalized"),
        "normalize_version": F.lit(version),
    }
    return df.withColumns(_gated(df, due, made))


def enrich_stage(df: DataFrame, version: int, summary_tags: int = 5) -> DataFrame:
    """Keywords, work mode and a summary; the summary names the first ``summary_tags`` keywords."""
    due = F.coalesce("enrich_version", F.lit(0)) < version
    words = F.filter(F.transform("tags", lambda t: F.lower(trim(t))), lambda t: t != "")
    mode = infer_work_mode("location", "description")
    summary = F.concat_ws(
        " | ",
        F.when(F.size(words) > 0, F.concat(F.lit("Tags: "), F.array_join(F.slice(words, 1, summary_tags), ", "))),
        F.when(mode != "Unknown", F.concat(F.lit("WorkMode: "), mode)),
    )
    made = {
        "enrich_keywords": words,
        "work_mode_hint": mode,
        "enrich_summary": summary,
        "pipeline_stage": F.lit("enriched"),
        "enrich_version": F.lit(version),
    }
    return df.withColumns(_gated(df, due, made))


def rate_stage(df: DataFrame, version: int, rater) -> DataFrame:
    """Rate rows this version has not rated; ``rater`` is any registered rater."""
    due = F.coalesce("rate_version", F.lit(0)) < version
    names = ["rate_num", "rate_reason", "rate_provider", "rated_model", "status"]
    before = df.withColumns({f"_old_{c}": F.col(c) if c in df.columns else F.lit(None) for c in names})
    rated = rater(before)
    out = rated.withColumns(
        {c: F.when(due, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in names}
        | _gated(
            rated,
            due,
            {"rate_status": F.lit("done"), "pipeline_stage": F.lit("rated"), "rate_version": F.lit(version), "sheet_sync_version": F.lit(version)},
        )
    )
    return out.drop(*[f"_old_{c}" for c in names])


def _gated(df: DataFrame, due: Column, made: dict) -> dict:
    """New values where the stage is due, the old ones elsewhere."""
    return {name: F.when(due, value).otherwise(F.col(name)) if name in df.columns else F.when(due, value) for name, value in made.items()}
