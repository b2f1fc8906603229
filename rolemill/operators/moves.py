"""Moving rows between tables: each move splits a table into what goes and what stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rolemill.functions.text import trim
from rolemill.operators.filters import is_older
from rolemill.operators.schema import widen_union
from rolemill.operators.winners import SEQ
from rolemill.session import new_folder


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that move and rows that stay; a null condition stays."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(hit), df.filter(~hit)


def dealt(df: DataFrame, place: Column, purpose: str) -> Callable[[str], DataFrame]:
    """Rows written once, partitioned by the table they go to; the result reads the part of a table."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, purpose)
    tagged = df.withColumn("_table", place)
    tagged.write.partitionBy("_table").parquet(folder)
    kind = StructType([*df.schema.fields, StructField("_table", StringType())])

    def part(table: str) -> DataFrame:
        return spark.read.schema(kind).option("basePath", folder).parquet(folder).filter(F.col("_table") == table).drop("_table")

    return part


def move_by_status(source: DataFrame, target: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    moved, stay = split(source, trim("Status") == status)
    return stay, widen_union(target, moved)


def move_older(source: DataFrame, target: DataFrame, date: str, as_of, days: int = 7) -> tuple[DataFrame, DataFrame]:
    moved, stay = split(source, is_older(date, as_of, days))
    return stay, target.unionByName(moved, allowMissingColumns=True)


def promote_stalled(df: DataFrame) -> DataFrame:
    """Rows left in the first medium stage go on; the remark is added once."""
    stalled = trim("Status") == "2MARate"
    desc, note = trim("JobRateDesc"), F.lit("MA->MB fallback")
    noted = (
        F.when(F.contains(desc, note), F.col("JobRateDesc"))
        .when(desc == "", note)
        .otherwise(F.concat(desc, F.lit("; "), note))
    )
    return df.withColumns(
        {
            "JobRateDesc": F.when(stalled, noted).otherwise(F.col("JobRateDesc")),
            "Status": F.when(stalled, "2MBrate").otherwise(F.col("Status")),
        }
    )


def set_source_status(state: DataFrame, batch: DataFrame, status: str) -> DataFrame:
    """Set a status for every source of a batch; unknown sources are added."""
    touched = batch.select(trim("ScrapePageName").alias("source_id")).filter(F.col("source_id") != "").distinct()
    marked = touched.withColumn("_new", F.lit(status))
    joined = state.join(marked, "source_id", "full_outer")
    return joined.select("source_id", F.coalesce("_new", "status").alias("status"), F.coalesce("jobs", F.lit(0)).alias("jobs"))
