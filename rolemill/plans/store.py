"""The job store as a table partitioned by a hash of the job id.

A batch reads and writes only the partitions its jobs fall into; all other files stay as they are.
Writing a partition replaces it as a whole, and a row that already carries the batch's run stays as it
is, so a batch that is applied again, wholly or after half of it was written, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rolemill.plans import cloud

BUCKET = "bucket"
#: Partitions of a store; about as many as bring one of them to some hundred megabytes.
BUCKETS = 64


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def write(jobs: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Replace the partitions that the jobs fall into; Spark writes a large one by several tasks, of its advisory size each."""
    placed = jobs.withColumn(BUCKET, bucket_of(buckets)).hint("rebalance", BUCKET)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All jobs, with their partition's number. ``schema`` is that of the jobs alone."""
    stored = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
    return spark.read.schema(stored).option("basePath", folder).parquet(folder)


def touched(batch: DataFrame, buckets: int) -> list[int]:
    """Numbers of the partitions a batch falls into; at most ``buckets``, whatever the batch's size."""
    return sorted(r[0] for r in batch.select(bucket_of(buckets)).distinct().collect())


def upsert(folder: str, schema, batch: DataFrame, as_of: Column, buckets: int = BUCKETS) -> None:
    """Fold a batch (an id once) into the store."""
    numbers = touched(batch, buckets)
    if not numbers:
        return
    own = read(batch.sparkSession, folder, schema).filter(F.col(BUCKET).isin(numbers)).drop(BUCKET)
    write(cloud.upsert_jobs(own, batch, as_of, once=True), folder, buckets)
