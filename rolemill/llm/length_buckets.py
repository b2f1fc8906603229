"""Packing into optimal length buckets.

A dynamic program over the histogram of all documents' lengths chooses the bucket boundaries that
need the least padding. Batches with a token budget then form inside each bucket.

The histogram is exact up to ``EXACT`` tokens and has ``STEPS`` bins per doubling above, so it has
at most EXACT + 64 * STEPS rows whatever the input (a length is below 2**63); only this comes to
the driver. A boundary is the longest length seen in a bin, so every document fits its bucket.
A bucket's rows are dealt into cells of a few batches each, so a bucket with a third of all rows is
spread over many tasks; each cell ends with at most one batch that isn't full.

Defined results: null and blank texts have length 0 and go to the shortest bucket; repeated rows are
packed as often as they occur; a document longer than the budget is a batch of its own and is not
cut; an empty table gives no rows; extra columns are not used, or with ``whole`` stay, and one with the
name of an added column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.common import read, rows_of, spread_row, token_count, whole_row

EXACT, STEPS = 1024, 64
ADDED = ["doc_id", "n_tokens", "bucket_len", "batch_id", "slot", "padding"]


@dataclass(frozen=True)
class Packing:
    buckets: int = 16
    batch_tokens: int = 32_768  # padded tokens of a batch
    batch_docs: int = 512


def length_bin(n: Column) -> Column:
    """A length's bin: itself up to EXACT, above that a step of 1/STEPS of a doubling."""
    return F.when(n <= EXACT, n).otherwise(EXACT + F.ceil((F.log2(n.cast("double")) - float(np.log2(EXACT))) * STEPS)).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least padding.

    ``lengths`` ascending: the longest length of each bin; ``counts`` documents and ``totals``
    tokens of each bin. best[j] is the least padding of the first j bins with k buckets.
    """
    n = len(lengths)
    docs = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    tokens = np.concatenate([[0.0], np.cumsum(totals, dtype=float)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, n)):
        new, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        new[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            came[j] = int(np.argmin(cost))
            new[j] = cost[came[j]]
        best = new
        back.append(came)
    cuts, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        cuts.append(int(lengths[j - 1]))
        j = came[j]
    return cuts[::-1]


def pack(docs: DataFrame, packing: Packing = Packing(), id_col: str = "doc_id", length: Column | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, n_tokens, bucket_len, batch_id, slot, padding), one row per row of ``docs``; with ``whole`` its other columns too."""
    carried = {"row": whole_row(docs)} if whole else {}
    thin = rows_of(docs, {"doc_id": docs[id_col], "n_tokens": token_count() if length is None else length, **carried}, "lengths")
    bins = thin.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")
    )
    found = sorted((r.longest, r.docs, r.tokens) for r in bins.collect())
    if not found:
        empty = thin.select(*carried, "doc_id", "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit("").alias("batch_id"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("padding"))
        return spread_row(empty, docs.columns, ADDED) if whole else empty
    lengths, counts, totals = (np.array(x) for x in zip(*found))
    edges = best_boundaries(lengths, counts, totals, packing.buckets)
    sizes = np.add.reduceat(counts, [0, *(np.searchsorted(lengths, e, side="right") for e in edges[:-1])])
    rooms = [max(1, min(packing.batch_docs, packing.batch_tokens // max(e, 1))) for e in edges]
    # a few batches to a cell, and no cell so small that its last batch counts for much
    cells = [max(1, -(-int(n) // max(256, 2 * r))) for n, r in zip(sizes, rooms)]

    at = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e < F.col("n_tokens")))
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at + 1)
    dealt = thin.select("*", pick(edges).alias("bucket_len"), pick(rooms).alias("room"), F.pmod(F.xxhash64("row_id"), pick(cells)).alias("cell"))
    number = F.row_number().over(Window.partitionBy("bucket_len", "cell").orderBy("row_id")) - 1
    out = dealt.withColumn("number", number).select(
        *carried,
        "doc_id",
        "n_tokens",
        "bucket_len",
        F.concat_ws("-", "bucket_len", "cell", F.floor(F.col("number") / F.col("room"))).alias("batch_id"),
        (F.col("number") % F.col("room")).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
    return spread_row(out, docs.columns, ADDED) if whole else out


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
