"""Readers: tables by header, CSV exports, page lists, feeds, raw pages, result envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.functions import urls
from rolemill.functions.text import blank_to_null, collapse, first_filled, text, trim
from rolemill.operators.schema import read_header

ENVELOPE = T.StructType(
    [
        *[
            T.StructField(n, T.StringType())
            for n in ("lease_id", "run_id", "source_id", "addon_instance_id", "started_at", "finished_at")
        ],
        T.StructField("success", T.BooleanType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField(
            "jobs",
            T.ArrayType(
                T.StructType(
                    [
                        *[
                            T.StructField(n, T.StringType())
                            for n in ("external_job_id", "job_url", "job_apply_url", "job_title", "job_company", "job_location")
                        ],
                        T.StructField("job_tags", T.ArrayType(T.StringType())),
                        T.StructField("job_description", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
FEED = T.StructType(
    [
        T.StructField(
            "channel",
            T.StructType(
                [
                    T.StructField(
                        "item",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(n, T.StringType())
                                    for n in ("link", "title", "job_listing:company", "job_listing:location")
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)


def scan_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A table by its header: names trimmed, nameless columns dropped."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return read_header(reader.format(kind).load(path))


def scan_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with doubled quotes and line breaks in cells; carriage returns dropped, blanks kept as ''.

    Give ``columns`` on large inputs: without them the header is read first.
    """
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", nullValue=None)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = read_header(reader.csv(path))
    bom = {c: c.lstrip("﻿") for c in df.columns}
    return df.select(*[F.replace(text(c), F.lit("\r"), F.lit("")).alias(bom[c]) for c in df.columns])


def scrape_list(df: DataFrame) -> DataFrame:
    """Page list entries: column names without case, rows without an address dropped."""
    have = {c.strip().lower(): c for c in df.columns}

    def cell(*names):
        found = [F.col(f"`{have[n]}`") for n in names if n in have]
        return first_filled(*found) if found else F.lit("")

    extra = [c for c in ("row_seq",) if c in df.columns]
    entries = df.select(
        *extra,
        cell("id", "scrapepageid").alias("id"),
        cell("name", "scrapepagename").alias("name"),
        cell("url", "scrapepageurl").alias("url"),
    )
    return entries.filter(F.col("url") != "")


def rss_items(df: DataFrame, xml: str) -> DataFrame:
    """Feed documents in a column to posting rows; items without an address dropped."""
    keep = [c for c in df.columns if c != xml]
    parsed = df.select(*keep, F.from_xml(F.col(xml), FEED).alias("_feed"))
    items = parsed.select(*keep, F.posexplode("_feed.channel.item").alias("item_pos", "i"))
    link = text("i.link")
    address = F.coalesce(blank_to_null(urls.canonical_job_url(F.lit("jobspresso"), link)), link)
    return items.select(
        *keep,
        "item_pos",
        address.alias("JobUrl"),
        urls.extract_job_id(address).alias("JobId"),
        F.coalesce(blank_to_null(collapse("i.title")), F.lit("Untitled")).alias("JobTitle"),
        collapse(F.col("i.`job_listing:company`")).alias("JobCompany"),
        collapse(F.col("i.`job_listing:location`")).alias("JobLocation"),
    ).filter(F.col("JobUrl") != "")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages; only the columns a job asks for leave the file."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def envelope_rows(parsed: DataFrame) -> DataFrame:
    """One row per scraped job of a result envelope, with its place in the list."""
    head = [c for c in parsed.columns if c != "jobs"]
    jobs = parsed.select(*head, F.posexplode_outer("jobs").alias("job_pos", "job"))
    return jobs.select(*head, "job_pos", "job.*")


def parse_envelopes(df: DataFrame, column: str) -> DataFrame:
    """Envelope JSON in a column, to one row per job."""
    keep = [c for c in df.columns if c != column]
    parsed = df.select(*keep, F.from_json(F.col(column), ENVELOPE).alias("e")).select(*keep, "e.*")
    return envelope_rows(parsed)


def envelope_count(column) -> Column:
    return F.size(F.coalesce(F.col(column), F.array()))


def read_trimmed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: trim(c) for c in columns})
