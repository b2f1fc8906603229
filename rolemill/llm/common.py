"""Helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.session import discard, new_folder, written

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACES", "WORD", "discard", "new_folder", "read", "rows_of", "spread_row", "token_count", "whole_row", "written"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def token_count(text: Column | str = "text") -> Column:
    """White-space separated words; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(df: DataFrame) -> Column:
    """A row as one struct, so that a column of any name may stand beside what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def spread_row(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The struct ``row`` as columns again, with ``added``; an added column replaces one of its name."""
    names = {a.lower() for a in added}
    kept = [F.col("row")[c].alias(c) for c in columns if c.lower() not in names]
    return df.select(*kept, *added)


def rows_of(df: DataFrame, columns: dict[str, Column], purpose: str) -> DataFrame:
    """The given columns and ``row_id``, unique for each row, as a written table.

    Row numbers are taken once and stored, so a task that runs again can't change them.
    """
    thin = df.select(*[c.alias(n) for n, c in columns.items()])
    return written(thin.withColumn("row_id", F.monotonically_increasing_id()), purpose)
