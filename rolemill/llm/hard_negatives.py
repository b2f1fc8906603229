"""Hard-negative mining with bounds that are passed along a spanning tree of anchors.

An anchor's positives are the best rows of its label. Its hard negatives for a positive are the best
rows of other labels whose score lies in a window set by the positive's score. Anchors are dealt into
blocks of neighbours, and each block gets a spanning tree of its shortest edges. Every block of
anchors meets every block of rows in one task, twice: for the positives, and, once these are merged
over all tasks, for the negatives. In a task the root's scores are computed; a child's score of a row
is then known to lie within (length of the edge) x (norm of the row) of its parent's, and only rows whose
bounds reach the best positives so far, or overlap a window, are rescored. Bounds of the other rows
are passed on as they are, wider by each edge. Where rows repeat a vector, or anchors do, edges
are short and nothing more is rescored.

Sums of products are exact: in doubles while they are sure to stay below 2**53, in 64-bit integers
above, and vectors whose scores could pass 2**62 are an error.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part;
vectors of different lengths meet on their common dimensions; ties go to the smaller id, then to the
row stored first, null ids last; a row with a null id is no anchor; of rows with one id each is an
anchor, positive and negative of its own, and only the row itself is not "another" row; an anchor
without positives, or without rows in the window, gives no rows; an empty table gives none; extra
columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.common import read, rows_of
from rolemill.llm.exact_topk import quantised, usable
from rolemill.session import ship_package, written

POSITIVES, NEGATIVES = 5, 3
#: The window, in hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Anchors and rows of a block.
ANCHORS, ROWS = 1024, 4096
#: Above this share of a block's rows all of them are rescored, which is one product of matrix and vector.
WHOLE = 0.5


def _matrix(weights: pa.Array, width: int, exact: type) -> np.ndarray:
    """Rows of ``width`` numbers, filled up with 0."""
    weights = weights.combine_chunks() if isinstance(weights, pa.ChunkedArray) else weights
    sizes = np.diff(weights.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width), exact)
    out[row, at] = weights.flatten().to_numpy(zero_copy_only=False)
    return out


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Lengths of rows, not below the true ones."""
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=-1)) * (1 + 1e-9)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent's place in it, length of the edge) of a shortest tree: each node joins the nearest one inside."""
    n = len(vectors)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    place = np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    distance, nearest = np.full(n, np.inf), np.full(n, -1, np.int64)
    node = 0
    for step in range(n):
        inside[node] = True
        order[step], place[node] = node, step
        if step:
            parent[step], edge[step] = place[nearest[node]], distance[node]
        away = _norms(vectors - vectors[node])
        closer = (away < distance) & ~inside
        distance[closer], nearest[closer] = away[closer], node
        node = int(np.argmin(np.where(inside, np.inf, distance)))
    return order, parent, edge


def tree_block(anchors: pa.Table, width: int) -> pa.Table:
    """A block's anchors in tree order, with the parent's place and the edge."""
    order, parent, edge = spanning_tree(_matrix(anchors["anchor_weights"], width, np.float64))
    sorted_ = anchors.take(pa.array(order))
    return sorted_.append_column("at", pa.array(np.arange(len(order)))).append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))


class Bounds:
    """Lower and upper bounds of the scores of a block's rows for each anchor of a tree, in tree order."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, exact: type):
        self.vectors = _matrix(anchors["anchor_weights"], width, exact)
        self.rows = _matrix(rows["weights"], width, exact)
        self.parent = anchors["parent"].to_numpy()
        self.edge = anchors["edge"].to_numpy()
        self.norms = _norms(self.rows)
        self.low = np.empty((len(self.vectors), len(self.rows)), exact)
        self.high = np.empty_like(self.low)
        self.rescored = 0

    def score(self, anchor: int, at: np.ndarray | None = None) -> None:
        """Exact scores of some rows, or of all."""
        if at is None or len(at) > WHOLE * len(self.rows):
            self.low[anchor] = self.rows @ self.vectors[anchor]
            self.high[anchor] = self.low[anchor]
            self.rescored += len(self.rows)
        else:
            self.low[anchor, at] = self.rows[at] @ self.vectors[anchor]
            self.high[anchor, at] = self.low[anchor, at]
            self.rescored += len(at)

    def inherit(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds from the parent's; the root's scores."""
        parent = self.parent[anchor]
        if parent < 0:
            self.score(anchor)
        else:
            # rounded up, and one more than any error of the product
            reach = (np.ceil(self.edge[anchor] * self.norms * (1 + 1e-9)) + 1).astype(self.low.dtype)
            np.subtract(self.low[parent], reach, out=self.low[anchor])
            np.add(self.high[parent], reach, out=self.high[anchor])
        return self.low[anchor], self.high[anchor]

    def best(self, anchor: int, at: np.ndarray, k: int) -> np.ndarray:
        """The k best of the rows ``at``; their bounds that could matter are made exact."""
        low, high = self.low[anchor, at], self.high[anchor, at]
        if len(at) > k:
            at = at[high >= np.partition(low, len(at) - k)[len(at) - k]]
        self.tighten(anchor, at)
        scores = self.low[anchor, at]
        return at[np.argsort(-scores, kind="stable")[:k]]

    def tighten(self, anchor: int, at: np.ndarray) -> None:
        loose = at[self.low[anchor, at] < self.high[anchor, at]]
        if len(loose):
            self.score(anchor, loose)


def _sorted(anchors: pa.Table, rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Anchors in tree order; rows in the order in which ties are broken."""
    return anchors.sort_by("at"), rows.sort_by([("vec_id", "ascending"), ("row_id", "ascending")])


def positives_of_cell(anchors: pa.Table, rows: pa.Table, k: int, width: int, exact: type) -> pa.Table:
    """The k best rows of each anchor's label in one block of rows."""
    anchors, rows = _sorted(anchors, rows)
    bounds = Bounds(anchors, rows, width, exact)
    labels, own_labels = rows["label"].to_numpy(), anchors["anchor_label"].to_numpy()
    ids, own_ids = rows["row_id"].to_numpy(), anchors["anchor_row"].to_numpy()
    found_a, found_r, found_s = [], [], []
    for a in range(len(own_ids)):
        bounds.inherit(a)
        same = np.flatnonzero((labels == own_labels[a]) & (ids != own_ids[a]))
        best = bounds.best(a, same, k)
        found_a.append(np.full(len(best), a))
        found_r.append(best)
        found_s.append(bounds.low[a, best].astype(np.int64))
    a, r, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_r, found_s))
    return pa.table(
        {
            "anchor_row": anchors["anchor_row"].take(pa.array(a)),
            "positive_row": rows["row_id"].take(pa.array(r)),
            "positive_id": rows["vec_id"].take(pa.array(r)),
            "positive_score": pa.array(s),
        }
    )


@dataclass(frozen=True)
class Limits:
    """A window in hundredths of the positive's score, and how many rows are taken from it."""

    least: int = LEAST
    most: int = MOST
    negatives: int = NEGATIVES

    def window(self, score: int) -> tuple[int, int]:
        """The whole scores n with least * score <= 100 * n <= most * score."""
        return -(-self.least * score // 100), self.most * score // 100


def negatives_of_cell(anchors: pa.Table, rows: pa.Table, limits: Limits, width: int, exact: type) -> pa.Table:
    """For each anchor and positive the best rows of other labels in the window, in one block of rows."""
    anchors, rows = _sorted(anchors, rows)
    bounds = Bounds(anchors, rows, width, exact)
    labels, own_labels = rows["label"].to_numpy(), anchors["anchor_label"].to_numpy()
    positives = anchors["positives"].to_pylist()
    k = limits.negatives
    found_a, found_p, found_r, found_s = [], [], [], []
    for a, own in enumerate(positives):
        low, high = bounds.inherit(a)
        if not own:
            continue
        other = np.flatnonzero(labels != own_labels[a])
        wanted = []
        for positive in own:
            least, most = limits.window(positive["positive_score"])
            near = other[(high[other] >= least) & (low[other] <= most)] if least <= most else other[:0]
            sure = near[(low[near] >= least) & (high[near] <= most)]
            if len(sure) >= k:
                near = near[high[near] >= np.partition(low[sure], len(sure) - k)[len(sure) - k]]
            wanted.append((positive, least, most, near))
        bounds.tighten(a, np.unique(np.concatenate([w[3] for w in wanted])))
        for positive, least, most, near in wanted:
            scores = low[near]
            near = near[(scores >= least) & (scores <= most)]
            best = near[np.argsort(-low[near], kind="stable")[:k]]
            found_a.append(np.full(len(best), a))
            found_p += [positive] * len(best)
            found_r.append(best)
            found_s.append(low[best].astype(np.int64))
    a, r, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_r, found_s))
    whole = pa.int64()
    return pa.table(
        {
            "anchor_row": anchors["anchor_row"].take(pa.array(a)),
            "anchor_id": anchors["anchor_id"].take(pa.array(a)),
            "positive_row": pa.array([p["positive_row"] for p in found_p], whole),
            "positive_id": pa.array([p["positive_id"] for p in found_p], whole),
            "positive_score": pa.array([p["positive_score"] for p in found_p], whole),
            "row_id": rows["row_id"].take(pa.array(r)),
            "negative_id": rows["vec_id"].take(pa.array(r)),
            "negative_score": pa.array(s),
        }
    )


def _anchor_trees(table: DataFrame, anchors: int, width: int) -> DataFrame:
    """Anchors by blocks of neighbours of at most ANCHORS, with their trees, as a written table.

    Neighbours are rows of one label that lie near each other along one direction. The driver
    gets the number of anchors of each partition, from which the blocks are cut to size.
    """
    sign = lambda i: F.pmod(F.xxhash64(i), F.lit(2)) * 2 - 1
    along = F.aggregate(F.transform("weights", lambda x, i: x.cast("double") * sign(i)), F.lit(0.0), lambda s, x: s + x)
    asked = table.where("is_anchor").select(
        F.col("row_id").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("weights").alias("anchor_weights"), along.alias("along")
    )
    order = ["anchor_label", "along", "anchor_row"]
    dealt = asked.repartitionByRange(max(1, -(-anchors // (16 * ANCHORS))), *order).sortWithinPartitions(*order)
    # the upper bits of this number are the partition, the lower ones the place in it
    placed = written(dealt.drop("along").withColumn("place", F.monotonically_increasing_id()), "anchors")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):
        before[r.part] = total
        total += r["count"]
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    blocks = placed.withColumn("ab", F.floor((F.element_at(start, part.cast("int")) + inside) / ANCHORS).cast("long")).drop("place")

    def tree(block: pa.Table) -> pa.Table:
        return tree_block(block, width)

    kind = "anchor_row long, anchor_id long, anchor_label long, anchor_weights array<bigint>, ab long, at long, parent long, edge double"
    return written(blocks.groupBy("ab").applyInArrow(tree, kind), "anchor-trees")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    limits: Limits = Limits(),
    positives: int = POSITIVES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    ship_package(vectors.sparkSession)
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    )
    kept = named.where(usable(F.col("vector")) & F.col("label").isNotNull())
    table = rows_of(kept, {"vec_id": F.col("vec_id"), "label": F.col("label"), "weights": quantised(F.col("vector")), "is_anchor": F.col("is_anchor") & F.col("vec_id").isNotNull()}, "vectors")
    largest = F.aggregate("weights", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    known = table.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("weights")).alias("width"), F.max(largest).alias("largest")).first()
    width = known.width or 0
    most = (known.largest or 0.0) ** 2 * width
    if most >= 2.0**62:
        raise ValueError("scores of these vectors could pass 64 bits")
    exact = np.float64 if most < 2.0**53 else np.int64
    row_blocks = max(-(-known.rows // ROWS), min(16, -(-known.rows // 256)), 1)
    anchor_blocks = max(-(-known.anchors // ANCHORS), 1)

    trees = _anchor_trees(table, known.anchors, width)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = table.select("vec_id", "row_id", "label", "weights", F.pmod(F.xxhash64("row_id"), F.lit(row_blocks)).alias("rb"), each(anchor_blocks).alias("ab"))

    def first(anchors: pa.Table, block: pa.Table) -> pa.Table:
        return positives_of_cell(anchors, block, positives, width, exact)

    def second(anchors: pa.Table, block: pa.Table) -> pa.Table:
        return negatives_of_cell(anchors, block, limits, width, exact)

    def cells(anchors: DataFrame):
        return anchors.withColumn("rb", each(row_blocks)).groupBy("ab", "rb").cogroup(rows.groupBy("ab", "rb"))

    offered = cells(trees).applyInArrow(first, "anchor_row long, positive_row long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    best = offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    # at most ``positives`` rows a list
    lists = best.groupBy("anchor_row").agg(F.collect_list(F.struct("positive_row", "positive_id", "positive_score")).alias("positives"))
    ready = written(trees.join(lists.withColumnRenamed("anchor_row", "of_row"), F.col("anchor_row") == F.col("of_row"), "left").drop("of_row"), "anchor-positives")

    shape = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row_id long, negative_id long, negative_score long"
    found = cells(ready).applyInArrow(second, shape)
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limits.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_query(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, noisy)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         coalesce(list_sum(list_transform(range(1, least(len(a.w), len(c.w)) + 1), lambda i: a.w[i] * c.w[i])), 0)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id IS DISTINCT FROM a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
) WHERE rank <= 3
"""
