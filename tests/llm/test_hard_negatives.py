import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolemill.llm import hard_negatives as T
from tests.llm.helpers import same_as_sql

KIND = "vec_id long, embedding array<float>, label int"
SQL_KIND = "vec_id BIGINT, embedding FLOAT[], label INTEGER"


def mine(spark, rows, kind=KIND):
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return T.hard_negatives(spark.createDataFrame(rows, kind).repartition(5), F.col("vec_id") % 50 == 0, noisy)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(T, "ANCHORS", 7)


def test_like_sql_with_near_anchors_ties_and_odd_vectors(spark, small_blocks):
    rng = random.Random(6)
    centres = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(1500):
        near = rng.choice(centres)
        vector = [round(x + rng.uniform(-0.1, 0.1) * (i % 3), 2) for x in near]
        rows.append((i, vector[: rng.randrange(13)] if i % 31 == 0 else vector, rng.randrange(4) if i % 40 else None))
    rows += [(1550, None, 1), (1600, [float("nan")] * 12, 1), (1650, [float("inf")] + [0.0] * 11, 1), (1651, [None] + [0.5] * 11, 2), (1700, [], 1), (1701, [3.0] * 12, 1)]
    rows += [(None, centres[0], 1), (1750, centres[0], 77)]
    assert same_as_sql(mine(spark, rows), T.SQL, embeddings=(rows, SQL_KIND)) == ""


def test_one_vector_fills_a_third(spark):
    rng = random.Random(2)
    rows = [(i, [0.5, -0.25, 0.125] if i % 3 == 0 else [rng.uniform(0, 1) for _ in range(3)], rng.randrange(3)) for i in range(900)]
    assert same_as_sql(mine(spark, rows), T.SQL, embeddings=(rows, SQL_KIND)) == ""


def test_large_numbers_stay_exact_or_are_refused(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(2**18, 2**19)), float(i)], i % 2) for i in range(300)]
    assert same_as_sql(mine(spark, rows), T.SQL, embeddings=(rows, SQL_KIND)) == ""
    with pytest.raises(ValueError):
        mine(spark, [(0, [1e30], 1)])


def test_repeated_ids_empty_tables_and_extra_columns(spark):
    wide = KIND + ", row_id string, weights string, positives int"
    rows = [(50, [1.0], 1), (50, [1.0], 1), (3, [0.75], 2)]
    out = mine(spark, [(*r, "x", "y", 1) for r in rows], wide)
    assert [tuple(r) for r in out.collect()] == [(50, 50, 1, 3, 256 * 256, 256 * 192)] * 2
    assert mine(spark, []).count() == 0
    assert mine(spark, [(50, [1.0], 1)]).count() == 0
    assert mine(spark, [(50, [-1.0], 1), (51, [1.0], 1), (52, [0.6], 2)]).count() == 0


def tables(rng, anchors, rows):
    vectors = rng.integers(-200, 200, (rows, 6)) // rng.integers(1, 40, (rows, 1))
    own = np.concatenate([vectors[: anchors // 2], vectors[: anchors - anchors // 2] + rng.integers(-2, 3, (anchors - anchors // 2, 6))])
    block = pa.table({"anchor_row": np.arange(anchors) + 10**6, "anchor_id": np.arange(anchors), "anchor_label": rng.integers(0, 3, anchors), "anchor_weights": own.tolist(), "ab": np.zeros(anchors, int)})
    return T.tree_block(block, 6), pa.table({"vec_id": np.arange(rows), "row_id": np.arange(rows), "label": rng.integers(0, 3, rows), "weights": vectors.tolist()})


def test_tree_is_shortest_and_bounds_hold():
    rng = np.random.default_rng(1)
    tree, rows = tables(rng, 60, 300)
    vectors = T._matrix(tree["anchor_weights"], 6, np.float64)
    parent, edge = tree["parent"].to_numpy(), tree["edge"].to_numpy()
    assert parent[0] == -1 and (parent[1:] < np.arange(1, 60)).all() and (parent[1:] >= 0).all()
    true = np.linalg.norm(vectors[1:] - vectors[parent[1:]], axis=1)
    assert np.allclose(true, edge[1:]) and (edge[1:] >= true).all()
    # Kruskal: the same total length
    pairs = sorted((float(np.linalg.norm(vectors[i] - vectors[j])), i, j) for i in range(60) for j in range(i))
    group, total = list(range(60)), 0.0
    for length, i, j in pairs:
        a, b = group[i], group[j]
        if a != b:
            total += length
            group = [a if g == b else g for g in group]
    assert np.isclose(total, edge.sum())
    bounds = T.Bounds(tree, rows, 6, np.float64)
    scores = T._matrix(rows["weights"], 6, np.float64) @ vectors.T
    for a in range(60):
        low, high = bounds.inherit(a)
        assert (low <= scores[:, a]).all() and (scores[:, a] <= high).all()


def test_near_anchors_rescore_few_rows(monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.integers(-200, 200, 6)
    anchors = pa.table({"anchor_row": np.arange(50) + 10**6, "anchor_id": np.arange(50), "anchor_label": np.zeros(50, int), "anchor_weights": (centre + rng.integers(0, 2, (50, 6))).tolist(), "ab": np.zeros(50, int)})
    rows = pa.table({"vec_id": np.arange(2000), "row_id": np.arange(2000), "label": np.arange(2000) % 2, "weights": rng.integers(-200, 200, (2000, 6)).tolist()})
    seen = []
    kept = T.Bounds.score
    monkeypatch.setattr(T.Bounds, "score", lambda self, a, at=None: (seen.append(len(self.rows) if at is None else len(at)), kept(self, a, at))[1])
    T.positives_of_cell(T.tree_block(anchors, 6), rows, 5, 6, np.float64)
    assert sum(seen) < 2000 + 50 * 100
