"""The apply mart and the applications registered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.functions.text import text, trim
from rolemill.functions.values import lenient_number
from rolemill.operators import joins, order, schema
from rolemill.operators.winners import SEQ
from rolemill.session import written


def mart_rows(df: DataFrame) -> DataFrame:
    """Rows to apply for with rate 3, 4 or 5; rate as a number."""
    rated = df.withColumn("rate", lenient_number("JobRateNum"))
    return rated.filter((trim("Status") == "2Apply") & F.col("rate").isin(3, 4, 5))


def build_mart(df: DataFrame) -> DataFrame:
    """The mart's eighteen columns in mart order."""
    ordered = order.mart_order(mart_rows(df))
    return schema.align(ordered, [SEQ, *schema.MART])


def register_applications(selected: DataFrame, rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Application rows, the table with the matched rows set to Applied, and the counts.

    Only rows still to apply for (or applied) can be registered.
    """
    able = selected.filter(trim("Status").isin("2Apply", "Applied"))
    applications = schema.application_rows(able, as_of)
    updated, counts = propagate(able, rows, "Applied")
    return applications, updated, counts


def propagate(selected: DataFrame, rows: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Set the status of the rows that selected items match; counts of updated rows and missed items."""
    # read by the update and by the counts
    matched = written(joins.application_match(selected, rows), "matched")
    hit = matched.filter(F.col("row_num").isNotNull()).select(F.col("row_num").alias(SEQ)).distinct()
    joined = rows.join(hit.withColumn("_hit", F.lit(True)), SEQ, "left")
    updated = joined.withColumn("Status", F.when(F.col("_hit"), status).otherwise(F.col("Status"))).drop("_hit")
    counts = matched.agg(
        F.count_distinct("row_num").alias("updated"), F.count_if(F.col("row_num").isNull()).alias("missed")
    )
    return updated, counts


def mark_selected(mart: DataFrame, selected: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selected mart rows to 2Delete, passed on to the table by matching."""
    flagged = written(mart.join(selected.select(SEQ, F.lit(True).alias("_sel")), SEQ, "left"), "flagged")
    hit = F.col("_sel") & trim("Status").isin("2Apply", "Applied")
    chosen = flagged.filter(hit).drop("_sel")
    marked = flagged.withColumn("Status", F.when(hit, "2Delete").otherwise(text("Status"))).drop("_sel")
    updated, counts = propagate(chosen, rows, "2Delete")
    return marked, updated, counts
