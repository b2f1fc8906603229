"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are made whole numbers, floor(256 * x), and taken as sparse rows: a term is a dimension with
a weight other than 0. Queries and candidates are dealt into blocks of bounded size, and every
block of queries meets every block of candidates in one task. There the candidates' weights are
posting lists by term; each query scatters its weight times the postings of each of its terms into
a dense array of scores, the k best are selected by partition, and the blocks' lists are merged.

Both sides are dealt by row number, so a vector that a third of all rows share is spread.

Defined results: vectors that are null or hold null or non-finite components take no part; a vector
without components scores 0; vectors of different lengths meet on their common dimensions; ties go
to the smaller id, then to the row stored first, null ids last; of rows with one id each is a query and a candidate
of its own, and a row with a null id is no query; scores are 64-bit numbers, and vectors whose scores
could pass 2**62 are an error; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.common import read, rows_of
from rolemill.session import ship_package

SCALE = 256
#: Rows of a block, and queries whose dense scores are held at a time.
BLOCK, TILE = 8192, 128
#: A posting list longer than this share of the block is added as a dense row.
DENSE = 0.25


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _postings(weights: pa.Array) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, row, term, weight) of the weights other than 0."""
    weights = weights.combine_chunks() if isinstance(weights, pa.ChunkedArray) else weights
    sizes = np.diff(weights.offsets.to_numpy())
    flat = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used = flat != 0
    return len(sizes), row[used], term[used], flat[used]


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    terms, at = np.unique(term, return_index=True)
    return {int(t): (r, w) for t, r, w in zip(terms, np.split(row, at[1:]), np.split(weight, at[1:]))}


def _best(scores: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, candidates): the k largest scores of each row, ties to the lower column, without ``own``."""
    lowest = np.iinfo(scores.dtype).min
    has = own >= 0
    scores[np.flatnonzero(has), own[has]] = lowest
    width = scores.shape[1]
    for q, line in enumerate(scores):
        if width > k:
            least = np.partition(line, width - k)[width - k]
            found = np.flatnonzero(line >= least)
        else:
            found = np.arange(width)
        found = found[found != own[q]]
        yield q, found[np.argsort(-line[found].astype(np.int64), kind="stable")][:k]


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one block for each query of one block."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row_id", "ascending")])
    n_rows, row, term, weight = _postings(rows["weights"])
    n_queries, q_row, q_term, q_weight = _postings(queries["query_weights"])
    postings = _by_term(row, term, weight)
    sums = lambda n, r, w: np.bincount(r, np.abs(w).astype(float), minlength=n).max(initial=0)
    most = sums(n_queries, q_row, q_weight) * np.abs(weight).max(initial=0)
    kind = np.int32 if most < 2**31 - 1 else np.int64
    dense = {}
    for t, (r, w) in postings.items():
        if len(r) > DENSE * n_rows:
            dense[t] = np.zeros(n_rows, kind)
            dense[t][r] = w
    ids = rows["row_id"].to_numpy()
    order = np.argsort(ids)
    q_ids = queries["query_row"].to_numpy()
    at = np.minimum(np.searchsorted(ids[order], q_ids), n_rows - 1)
    own = np.where(ids[order][at] == q_ids, order[at], -1)

    out_q, out_c, out_s = [], [], []
    for start in range(0, n_queries, TILE):
        inside = (q_row >= start) & (q_row < start + TILE)
        size = min(TILE, n_queries - start)
        scores = np.zeros((size, n_rows), kind)
        for t, (q, w) in _by_term(q_row[inside] - start, q_term[inside], q_weight[inside]).items():
            if t in dense:
                share = np.multiply.outer(w.astype(kind), dense[t])
                if len(q) == size:
                    scores += share
                else:
                    scores[q] += share
            elif t in postings:
                r, weights = postings[t]
                scores[np.ix_(q, r)] += np.multiply.outer(w.astype(kind), weights.astype(kind))
        for q, found in _best(scores, k, own[start : start + size]):
            out_q.append(np.full(len(found), start + q))
            out_c.append(found)
            out_s.append(scores[q, found].astype(np.int64))
    q, c, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))
    take = lambda column, i: column.take(pa.array(i.astype(np.int64)))
    return pa.table(
        {
            "query_row": take(queries["query_row"], q),
            "query_id": take(queries["query_id"], q),
            "vec_id": take(rows["vec_id"], c),
            "row_id": take(rows["row_id"], c),
            "score": pa.array(s),
        }
    )


def exact_topk(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product of each query."""
    ship_package(vectors.sparkSession)
    kept = vectors.where(usable(F.col(vector_col)))
    table = rows_of(kept, {"vec_id": F.col(id_col).cast("long"), "weights": quantised(F.col(vector_col)), "is_query": is_query}, "vectors")
    largest = F.aggregate("weights", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    counts = table.agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries"), F.max(F.size("weights")).alias("width"), F.max(largest).alias("largest")).first()
    if (counts.largest or 0.0) ** 2 * (counts.width or 0) >= 2.0**62:
        raise ValueError("scores of these vectors could pass 64 bits")
    # never above BLOCK rows; smaller where there are few, so that every core has a block
    row_blocks = max(-(-counts.rows // BLOCK), min(16, -(-counts.rows // 256)), 1)
    query_blocks = max(-(-counts.queries // BLOCK), 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = table.select("vec_id", "row_id", "weights", F.pmod(F.xxhash64("row_id"), F.lit(row_blocks)).alias("rb"), spread(query_blocks).alias("qb"))
    # new names: both sides come from one table, and Spark tells their columns apart by origin
    asked = table.where("is_query").withColumnsRenamed({"vec_id": "query_id", "row_id": "query_row", "weights": "query_weights"})
    queries = asked.select("query_id", "query_row", "query_weights", F.pmod(F.xxhash64("query_row"), F.lit(query_blocks)).alias("qb"), spread(row_blocks).alias("rb"))

    def cell(q: pa.Table, r: pa.Table) -> pa.Table:
        return search_block(q, r, k)

    shape = "query_row long, query_id long, vec_id long, row_id long, score long"
    found = queries.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInArrow(cell, shape)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def topk_query(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
) WHERE rank <= 5
"""
