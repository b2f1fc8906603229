from itertools import product

import numpy as np

from rolemill.llm import line_quality as Q
from tests.llm.helpers import by_id

GOOD = "The house by the river was built of stone, and the people of the town were fond of it."
BAD = "BUY!! NOW!! $$$ CLICK!! HERE!! $$$"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    emission, move = rng.normal(size=9), rng.normal(size=(2, 2))
    begin = np.array([0, 4, 4, 5, 9])
    got, pairs = Q.marginals(emission, begin, move)
    want, seen = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(begin, begin[1:]):
        if a == b:
            continue
        total, part, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in product((0, 1), repeat=b - a):
            weight = np.exp(sum(emission[a + i] * c for i, c in enumerate(labels)) + sum(move[x, y] for x, y in zip(labels, labels[1:])))
            total += weight
            part += weight * np.array(labels)
            for x, y in zip(labels, labels[1:]):
                moves[x, y] += weight
        want[a:b] = part / total
        seen += moves / total
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def test_long_chains_stay_in_range():
    p, _ = Q.marginals(np.tile([3.0, -3.0], 50_000), np.array([0, 100_000]), np.zeros((2, 2)))
    assert np.isfinite(p).all() and np.allclose(p[:2], [0.9525741, 0.0474259], atol=1e-4)


def test_learns_lines_and_scores_edges(spark):
    rows = [(i, "\n".join([GOOD] * (1 + i % 4)) if i % 2 else "\n".join([BAD] * (1 + i % 4))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, None), (None, 1)], "doc_id long, quality int")
    model = Q.learn_quality(docs, labels)
    odd = [(1, None), (2, ""), (3, " \n "), (4, GOOD), (5, BAD), (6, "\n\n" + GOOD + "\n\n"), (7, GOOD * 3000), (8, "\n".join([GOOD] * 8000)), (None, GOOD), (4, GOOD)]
    out = Q.score_quality(spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, score int"), model)
    assert out.count() == len(odd)
    got = by_id(out)
    assert [got[i].score for i in (1, 2, 3)] == [0, 0, 0]
    assert got[4].predicted == 1 and got[8].predicted == 1 and got[None].predicted == 1 and got[5].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.learn_quality(docs, labels) is None
    got = by_id(Q.score_quality(docs, None))
    assert (got[1].score, got[2].score) == (0.5, 0.0)
    assert Q.score_quality(docs.limit(0), None).count() == 0


def test_trains_on_all_lines_of_different_documents(spark, monkeypatch):
    """Rows of one document don't crowd out the other kind, and lines behind the 64th count."""
    seen = []
    monkeypatch.setattr(Q, "train", lambda features, begin, labels: seen.append((np.diff(begin).tolist(), labels.tolist())))
    monkeypatch.setattr(Q, "TRAIN_DOCS", 4)
    rows = [(1, "\n".join([GOOD] * 100))] * 50 + [(2, BAD), (2, BAD), (3, None), (4, "")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, quality int")
    Q.learn_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels)
    assert [sorted(zip(*s)) for s in seen] == [[(1, 0), (100, 1)]]


def test_lines_of_the_sample_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "train", lambda features, begin, labels: seen.append(int(begin[-1])))
    monkeypatch.setattr(Q, "TRAIN_LINES", 150)
    rows = [(i, "\n".join([GOOD] * 40)) for i in range(9)] + [(100, "\n".join([GOOD] * 200))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(101)], "doc_id long, quality int")
    Q.learn_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert seen == [120]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.quality_query(spark, sf).where("held_out").join(truth, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == c] for c in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
