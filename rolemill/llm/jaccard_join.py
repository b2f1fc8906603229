"""N-gram Jaccard join of documents with an R-tree over count vectors.

A document is the set of its distinct shingles. ``Likeness`` gives their width and the similarity from
which sets link; numbers below are those of the query, 4 words and 0.85. Shingles are hashed into 256
groups; the numbers of a set's shingles in each group are a point. The overlap of two sets is at most
the sum of the smaller of their coordinates, and for a node of the tree at most that with the node's
upper corner. Pairs that reach the needed overlap by this bound are verified on the whole sets.

The index is spread over the cluster by keys. Shingles are put in one order for all sets, common ones
last, and the first n - ceil(0.85 n) + 1 of a set's n shingles are its keys. Two sets at a similarity
of 0.85 or more share a key for certain: were all their keys different, the set whose last key comes
first in the order would lack more than 0.15 n of its shingles in the other. Which shingles are common is
counted on a bounded sample of the texts. Any order gives the same links; this one keeps a passage
that many documents share out of their keys, so that they don't meet by it.

Links are found in three steps, so that a group of n near copies isn't expanded into n**2 pairs:
1. By each key every set is compared with the key's first set; links join sets to clusters. The first
   set has met all others then and takes no part in what follows.
2. Where other sets of a key are still of different clusters, they are dealt to cells of bounded size (by
   set size, then by hash). A tree in each cell finds the pairs that the bound lets pass, and the few
   best of each set are verified. Sets that hang together in any way mostly join one cluster here.
3. Cells of a key whose sets are still of different clusters meet each other, and all pairs of
   different clusters that the trees let pass are verified.
A pair that is never compared is in one cluster already, so no component is missed.

Count vectors join rows only where sets meet, verifying carries texts and not their (larger) sets, and
a table that nothing reads any more is deleted, so that the disk in use stays near the input's size.

Defined results: text without words, or null, has the empty set and links with nothing; with fewer than
a shingle's words the whole sequence is the one shingle; equal sets are one node, so copies cost nothing
beyond the first; equal doc_ids are separate rows; a null doc_id is no component's smallest unless
all of its ids are null; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.arrow_text import chunks, mix, words
from rolemill.llm.common import discard, read, whole_row, written
from rolemill.llm.components import components
from rolemill.session import ship_package

HUNDRED = 100
GROUPS = 256
#: Groups that are taken together in the boxes of a tree; its points are compared in full.
TOGETHER = 4
#: Sets of a cell, and children of a node of its tree.
CELL, FAN = 512, 16
#: Meetings of up to FEW rows are compared without a tree; so many rows of meetings are taken at a time.
FEW, TAKEN = 24, 4096
#: Pairs whose sets a task holds at a time when verifying.
HELD = 256
#: Pairs of a set and cell that step 2 verifies.
BEST = 2
#: Texts whose shingles are counted to find common ones, in how many of them a shingle is common, and how
#: many are told apart at most (16 bytes each, sent to all tasks). They steer the order only.
SAMPLE, COMMON, TOLD = 40_000, 3, 500_000

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``width`` words; two sets link when HUNDRED * overlap >= need * union. The defaults are the query's."""

    width: int = 4
    need: int = 85

    def __post_init__(self):
        if not (1 <= self.width <= len(_PLACE) and 50 <= self.need < HUNDRED):
            raise ValueError("shingles have 1 to 5 words, and the needed similarity is from 0.5 to below 1")

    @property
    def lone(self) -> int:
        """Sets below this size link with equal sets only: at 0.85 it is 6, since 5 / 6 is less."""
        return -(-self.need // (HUNDRED - self.need))


QUERY = Likeness()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    _, _, h, first = words(data, offsets)
    n = max(len(h) - width + 1, 0)
    with np.errstate(over="ignore"):
        grams = mix(sum((h[i : n + i] * _PLACE[i] for i in range(width)), np.zeros(n, np.uint64)))
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                short = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@dataclass(frozen=True)
class Common:
    """Hashes of common shingles in ascending order, and how often each was seen."""

    hashes: np.ndarray
    counts: np.ndarray

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingles, self.counts[at], 0)


def keys_of(own: np.ndarray, like: Likeness, common: Common) -> np.ndarray:
    """So many of a set's shingles, rare ones first, that a set which shares none can't link with it."""
    n = len(own)
    if n < like.lone:
        return own[:0]
    return own[np.lexsort((own, common.of(own)))[: n - -(-like.need * n // HUNDRED) + 1]]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def _described(batches: Iterator[pa.RecordBatch], like: Likeness, common) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n", "sum", "xor", "keys", "vector"]
    for batch in batches:
        for start, end, data, offsets in chunks(batch.column("text")):
            sets = shingle_sets(data, offsets, like.width)
            with np.errstate(over="ignore"):
                total = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            odd = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            points = [np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, end - start),
                    batch.column("text_hash").slice(start, end - start),
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(total.view(np.int64)),
                    pa.array(odd.view(np.int64)),
                    _lists([keys_of(s, like, common.value) for s in sets], pa.int64()),
                    _lists(points, pa.int32()),
                ],
                names,
            )


def _expanded(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Sets of texts."""
    for batch in batches:
        for start, end, data, offsets in chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(start, end - start), _lists(shingle_sets(data, offsets, like.width), pa.int64())], ["node", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts x and y have sets that are similar enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            part = batch.slice(at, HELD)
            xs, ys = ([s for _, _, data, offsets in chunks(part.column(c)) for s in shingle_sets(data, offsets, like.width)] for c in ("x", "y"))
            same = [len(np.intersect1d(x, y, assume_unique=True)) * (HUNDRED + like.need) >= (len(x) + len(y)) * like.need for x, y in zip(xs, ys)]
            yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def common_shingles(docs: DataFrame, like: Likeness) -> Common:
    """Shingles of several texts of the sample; at most TOLD of them come to the driver."""
    every = -(-docs.count() // SAMPLE) or 1
    sample = _hashed(docs).where(F.pmod(F.xxhash64("text_hash"), F.lit(every)) == 0).dropDuplicates(["text_hash"])
    sets = sample.select(F.col("text_hash").alias("node"), "text").mapInArrow(partial(_expanded, like=like), "node long, shingles array<long>")
    counts = sets.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
    hashes = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Common(hashes[order], rows["n"].to_numpy()[order])


def enough(overlap: Column, n: Column, m: Column, need: int) -> Column:
    """Whether an overlap is enough for sets of n and m shingles; all in whole numbers."""
    return overlap * (HUNDRED + need) >= (n + m) * need


def bound(a: Column, b: Column) -> Column:
    """The most that two sets with these points can share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x).cast("long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, as a written table."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = nodes.join(wanted, "node").select("node", "doc_id", "text_hash")
    texts = _hashed(docs).withColumnRenamed("doc_id", "id").join(found, "text_hash").where(F.col("id").eqNullSafe(F.col("doc_id")))
    # rows that agree in id and text stand for one node
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "asked")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return written(met.mapInArrow(partial(_similar, like=like), "a long, b long"), "similar", gone=[texts])


class CountTree:
    """An R-tree over count vectors, packed by set size and coordinates.

    Level 0 holds the points; a node of a higher level covers FAN nodes of the one below and has
    their upper corner and smallest set size. Boxes are in fewer coordinates, the sums of TOGETHER
    groups, whose bound is never below that of all groups; what passes is compared in all.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, need: int = QUERY.need):
        self.points, self.sizes, self.need = points, sizes, need
        points = self.coarse(points)
        heavy = np.argsort(-points.var(axis=0), kind="stable")[:2] if len(points) else [0, 0]
        # tiles: runs of like size, in them by the two coordinates that differ most
        self.order = np.argsort(sizes, kind="stable")
        tile = np.arange(len(sizes)) // (FAN * FAN)
        self.order = self.order[np.lexsort((points[self.order, heavy[1]], points[self.order, heavy[0]], tile))]
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FAN:
            upper, least = self.levels[-1]
            at = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at)))

    @staticmethod
    def coarse(points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), GROUPS // TOGETHER, TOGETHER).sum(axis=2, dtype=np.int32)

    def _passed(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which of the pairs a[i], b[j] can share enough."""
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 13):
            x, y = i[s : s + (1 << 13)], j[s : s + (1 << 13)]
            out[s : s + (1 << 13)] = np.minimum(a[x], b[y]).sum(axis=1, dtype=np.int64) * (HUNDRED + self.need) >= (n[x] + m[y]) * self.need
        return out

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) numbers of all pairs that the bound lets pass."""
        small = self.coarse(points)
        top = len(self.levels[-1][1])
        query = np.repeat(np.arange(len(sizes)), top)
        node = np.tile(np.arange(top), len(sizes))
        for level in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[level]
            passed = self._passed(small, query, upper, node, sizes, least)
            query, node = query[passed], node[passed]
            if level:
                below = len(self.levels[level - 1][1])
                query = np.repeat(query, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, node = query[node < below], node[node < below]
        found = self.order[node]
        passed = self._passed(points, query, self.points, found, sizes, self.sizes)
        return query[passed], found[passed]


def _in_small(meet: np.ndarray, side: np.ndarray, alone: np.ndarray, n: np.ndarray, points: np.ndarray, apart, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of small meetings, of which all are compared; rows are in the order of ``meet``."""
    found = []
    for ahead in range(1, FEW):
        i = np.flatnonzero(meet[:-ahead] == meet[ahead:])
        j = i + ahead
        fits = (alone[i] | (side[i] != side[j])) & apart(i, j)
        # what the sizes alone rule out isn't compared
        fits &= np.minimum(n[i], n[j]) * (HUNDRED + need) >= (n[i] + n[j]) * need
        i, j = i[fits], j[fits]
        for s in range(0, len(i), 1 << 12):
            x, y = i[s : s + (1 << 12)], j[s : s + (1 << 12)]
            most = np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64)
            passed = most * (HUNDRED + need) >= (n[x] + n[y]) * need
            found.append((x[passed], y[passed]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return i, j


def _found_in(cells: pa.Table, best: int | None, need: int) -> pa.Table:
    """Pairs of different clusters that the bound lets pass, of many meetings.

    A meeting is a cell by itself or two cells (sides) that meet. Where it has more than FEW rows, a
    tree finds the pairs. With ``best``, only so many of each set, those with the largest bound for
    their sizes.
    """
    cells = cells.sort_by([("meet", "ascending"), ("side", "ascending")]).combine_chunks()
    meet, side, node, cluster, n = (cells[c].to_numpy() for c in ("meet", "side", "node", "cluster", "n"))
    points = cells["vector"].combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)
    starts = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1]]))
    sizes = np.diff(np.append(starts, len(meet)))
    alone = np.repeat(np.add.reduceat(side, starts) == 0, sizes)
    apart = lambda i, j: (cluster[i] != cluster[j]) & (node[i] != node[j])

    few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    i, j = _in_small(meet[few], side[few], alone[few], n[few], points[few], lambda i, j: apart(few[i], few[j]), need)
    pairs = [(few[i], few[j])]
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        rows = np.arange(start, start + size)
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        right = right if len(right) else left
        q, p = CountTree(points[right], n[right], need).search(points[left], n[left])
        i, j = left[q], right[p]
        keep = apart(i, j)
        pairs.append((i[keep], j[keep]))
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    if best is not None:
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        most = np.minimum(CountTree.coarse(points[i]), CountTree.coarse(points[j])).sum(axis=1) / (n[i] + n[j])
        order = np.lexsort((node[j], -most, i))
        own = i[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        i, j = own[place < best], j[order][place < best]
    a, b = node[i], node[j]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _in_batches(rows: DataFrame, total: int, best: int | None, need: int) -> DataFrame:
    """Meetings, many of which are small, some thousand rows at a time; ``total`` is the number of rows."""
    parts = max(1, -(-total // TAKEN))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("meet"), F.lit(parts)))
    return dealt.groupBy("batch").applyInArrow(lambda cells: _found_in(cells, best, need), "a long, b long").distinct()


def cross_pairs(keys: DataFrame, points: DataFrame, clusters: DataFrame, best: bool, need: int) -> DataFrame:
    """Candidates (a, b) of different clusters that share a key, written; with ``best`` the best of each cell."""
    own = keys.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    seen = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    mixed = own.groupBy("key").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), F.count("*").alias("size"), *seen).where("x <> y")
    # keys of the same sets (as all those of a passage that two texts share) are one: 128 bits of hash tell
    mixed = mixed.groupBy("size", "h1", "h2").agg(F.min("key").alias("key"))
    mixed = written(mixed.select("key", "size"), "mixed-keys")
    # sets of linkable sizes are in one band or in neighbour bands
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(HUNDRED / need)))
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / CELL))
    member = own.join(mixed, "key").select("key", band.alias("band"), part.alias("part"), "node", "cluster", "n")
    member = written(member, "members", gone=[mixed])
    cells = member.groupBy("key", "band", "part").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), F.count("*").alias("members"))
    cells = written(cells.withColumn("cell", F.xxhash64("key", "band", "part")), "cells")
    if best:
        # what is of one cluster has nothing to find
        meets = cells.where("x <> y").select("key", "band", "part", F.col("cell").alias("meet"), "members")
        rows = member.join(meets, ["key", "band", "part"]).withColumn("side", F.lit(0))
        total = meets.agg(F.sum("members")).first()[0] or 0
    else:
        # pairs of cells, not of rows; a cell meets those after it in its band and all in the next
        ahead = cells.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("cell").alias("cell2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("members").alias("members2"))
        meets = cells.join(ahead, ["key", "band"]).where((F.col("band2") > F.col("band")) | (F.col("part2") >= F.col("part")))
        meets = meets.where((F.least("x", "x2") != F.greatest("y", "y2"))).withColumn("meet", F.xxhash64("cell", "cell2"))
        meets = written(meets.select("key", "band", "part", "band2", "part2", "meet", (F.col("cell") == F.col("cell2")).alias("self"), "members", "members2"), "meetings")
        left = member.join(meets.select("key", "band", "part", "meet"), ["key", "band", "part"]).withColumn("side", F.lit(0))
        right = meets.where(~F.col("self")).select("key", F.col("band2").alias("band"), F.col("part2").alias("part"), "meet")
        right = member.join(right, ["key", "band", "part"]).withColumn("side", F.lit(1))
        shape = ["meet", "side", "node", "cluster", "n"]
        rows = left.select(*shape).unionByName(right.select(*shape))
        total = meets.agg(F.sum(F.col("members") + F.when(F.col("self"), 0).otherwise(F.col("members2")))).first()[0] or 0
    rows = rows.select("meet", "side", "node", "cluster", "n").join(points.select("node", "vector"), "node")
    found = _in_batches(rows, total, BEST if best else None, need)
    return written(found, "candidates", gone=[member, cells] if best else [member, cells, meets])


def jaccard_classes(docs: DataFrame, like: Likeness = QUERY) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root), one row per row of ``docs``.

    ``root`` tells components apart; their smallest ids may be equal or null. It is null for the empty set.
    """
    ship_package(docs.sparkSession)
    shape = "doc_id long, text_hash long, n long, sum long, xor long, keys array<long>, vector array<int>"
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, like))
    sets = written(_hashed(docs).mapInArrow(partial(_described, like=like, common=common), shape).withColumn("row_id", F.monotonically_increasing_id()), "points")
    alike = ["n", "sum", "xor"]
    full = sets.where("n > 0")
    classes = full.groupBy(*alike).agg(F.min("row_id").alias("node"), F.min("doc_id").alias("least_id"))
    classes = written(classes, "classes")
    rows = written(sets.select("doc_id", "text_hash", *alike), "rows")
    nodes = full.join(classes.select(F.col("node").alias("row_id")), "row_id").withColumnRenamed("row_id", "node")
    nodes = written(nodes.select("node", "doc_id", "text_hash", "n", "keys", "vector"), "nodes", gone=[sets])

    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = written(heads, "heads")
    shared = written(keys.join(heads, "key").where("head < node").select("key", "node", "n", "head", "size"), "shared-keys", gone=[heads])
    points = written(nodes.drop("keys"), "points", gone=[nodes])
    stars = shared.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda x: points.select(*[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "vector")])
    near = stars.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    near = near.where(enough(bound(F.col("a_vector"), F.col("b_vector")), F.col("a_n"), F.col("b_n"), like.need)).select("a", "b")
    near = written(near, "candidates")
    found = [verified(docs, points, near, like)]
    discard(near)
    # a key's first set has met all others
    rest = written(shared.where("size > 2").select("key", "node", "n"), "rest", gone=[shared])
    for best in (True, False):
        clusters = components(reduce(DataFrame.unionByName, found))
        more = cross_pairs(rest, points, clusters.withColumnRenamed("root", "cluster"), best, like.need)
        found.append(verified(docs, points, more, like))
        discard(clusters, more)
    roots = components(reduce(DataFrame.unionByName, found))
    discard(rest, points, *found)
    known = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known.select(*alike, "least_id", "root"), "known", gone=[classes, roots])
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(known.join(least, "root").select(*alike, "component_id", "root"), "named", gone=[known])
    out = rows.join(named, alike, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), "root")


def one_of_each(docs: DataFrame, like: Likeness = QUERY) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id.

    Of rows that agree in doc_id and text one stays; texts without words are left as they are.
    """
    judged = jaccard_classes(docs, like).where("n_shingles > 0")
    first = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_hash")).alias("s"))
    first = first.select("s.doc_id", "s.text_hash")
    times = judged.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    stays = times.join(first, times["doc_id"].eqNullSafe(first["doc_id"]) & (times["text_hash"] == first["text_hash"]), "left_semi")
    stays = written(stays.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "times"), "stays")
    row = whole_row(docs).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("_id2"), F.xxhash64("text").alias("_hash"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    met = keyed.where("worded").join(stays, "_hash").where(F.col("_id").eqNullSafe(F.col("_id2")))
    single = met.where("times = 1").select("row")
    repeated = met.where("times > 1").dropDuplicates(["_hash", "_id2"]).select("row")
    return keyed.where("NOT worded").select("row").unionByName(single).unionByName(repeated).select("row.*")


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id")
