"""Exact dedup in two passes over a Bloom filter; DataFrame functions only.

Pass 1 inserts each text's hash into a blocked Bloom filter (one 64-bit word per hash, two bits
in it) and keeps the bits that were set more than once. Pass 2 probes the kept bits: a row with
both bits set may be repeated and is grouped by its SHA-256; every other row passes straight
through as a group of one. A false positive costs a shuffled row, never a wrong result.

The filter is a table of (word, mask) rows, so no size is fixed beforehand: Spark broadcasts it
where it is below ``spark.sql.autoBroadcastJoinThreshold`` and else joins by shuffle.

Defined results: null text counts as empty; texts are equal without white space; of equal texts
the longest original stays, then the smallest doc_id (null last), then the first stored row, so
of repeated rows exactly one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import SPACES, rows_of, written

#: Filter bits for each row; two of them are set by each distinct text.
BITS_PER_ROW = 16


def _address(key: Column, words: int) -> tuple[Column, Column, Column]:
    """Word number and the two bit numbers of a key."""
    bits = F.xxhash64(key, F.lit(1))
    return (
        F.pmod(F.xxhash64(key), F.lit(words)),
        F.pmod(bits, F.lit(64)).cast("int"),
        F.pmod(F.shiftright(bits, 32), F.lit(64)).cast("int"),
    )


def repeated_bits(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, mask): the filter bits that more than one row of ``keys`` set."""
    word, one, two = _address(F.col(key), words)
    cells = keys.select(word.alias("word"), F.explode(F.array_distinct(F.array(one, two))).alias("bit"))
    often = cells.groupBy("word", "bit").count().where("count > 1")
    # shiftleft takes its distance as a column only in SQL form
    return often.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def possibly_repeated(keys: DataFrame, key: str, bloom: DataFrame, words: int) -> DataFrame:
    """``keys`` with ``suspect``: both bits of the row are among the repeated ones."""
    word, one, two = _address(F.col(key), words)
    probe = keys.withColumns({"word": word, "one": one, "two": two})
    mask = F.expr("shiftleft(1L, one) | shiftleft(1L, two)")
    hit = F.coalesce(F.col("mask").bitwiseAND(mask) == mask, F.lit(False))
    return probe.join(bloom, "word", "left").withColumn("suspect", hit).drop("word", "one", "two", "mask")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    digests = rows_of(
        docs,
        {
            "doc_id": docs[id_col].cast("long"),
            "chars": F.length(text),
            "text_sha256": F.sha2(F.regexp_replace(text, SPACES, ""), 256),
        },
        "digests",
    )
    words = max(1, digests.count() * BITS_PER_ROW // 64)
    bloom = written(repeated_bits(digests, "text_sha256", words), "repeated-bits")
    marked = possibly_repeated(digests, "text_sha256", bloom, words)

    through = marked.where(~F.col("suspect")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    suspects = marked.where("suspect")
    best = F.min(F.struct((-F.col("chars")).alias("rank"), F.col("doc_id").isNull().alias("blank"), "doc_id", "row_id"))
    # written, so that the join below has an exchange of its own on either side, which Spark may split
    # where one text is hot
    groups = written(suspects.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    grouped = suspects.join(groups, "text_sha256").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
    )
    return through.unionByName(grouped)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
