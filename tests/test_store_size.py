"""A partition of the job store is written by as many tasks as its size asks for."""

import glob

from pyspark.sql import functions as F

from rolemill.plans import store


def test_large_partitions_are_written_by_several_tasks(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    jobs = spark.range(0, 4000, 1, 8).select(F.col("id").cast("string").alias("job_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        store.write(jobs, folder, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [len(glob.glob(f"{folder}/bucket={b}/*.parquet")) for b in (0, 1)]
    assert min(files) > 1
    assert store.read(spark, folder, jobs.schema).drop("bucket").exceptAll(jobs).isEmpty() and spark.read.parquet(folder).count() == 4000
