"""The pipeline's stages: (spark, docs, sf_dir) to a frame; all but the last return documents' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import whole_row
from rolemill.llm.jaccard_join import Likeness, one_of_each
from rolemill.llm.language_id import held_out, identify, learn_prototypes
from rolemill.llm.length_buckets import pack
from rolemill.llm.line_dedup import line_dedup
from rolemill.llm.source_mixing import mix_sources

#: The query has four words and 0.85.
NEAR = Likeness(width=5, need=80)


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or null, are rejected; prototypes are learned from the rest's labels."""
    prototypes = learn_prototypes(docs.where(~F.coalesce(held_out(), F.lit(False))))
    # columns of any name may come in, so the judgement stands beside the row, not in it
    rows = docs.select(whole_row(docs).alias("row"), "text")
    return identify(rows, prototypes).where("lang_pred <> 'und'").select("row.*")


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; so does a document that loses all its lines."""
    cleaned = line_dedup(docs)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = cleaned.where((F.col("lines_dropped") == 0) | worded)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs, NEAR)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources(docs).select(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its bucket and batch."""
    return pack(docs, whole=True)
