from collections import defaultdict
from itertools import combinations

import numpy as np

from rolemill.llm import length_buckets as B

KIND = "doc_id long, text string"


def padding(edges, lengths):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def test_boundaries_are_optimal(spark):
    rng = np.random.default_rng(3)
    for buckets in (1, 2, 3, 4):
        lengths = rng.integers(1, 30, 40)
        values, counts = np.unique(lengths, return_counts=True)
        edges = B.best_boundaries(values, counts, values * counts, buckets)
        best = min(padding([*c, values[-1]], lengths) for k in range(buckets) for c in combinations(values[:-1].tolist(), k))
        assert padding(edges, lengths) == best


def test_every_row_is_packed_once_in_budget(spark):
    rows = [(i, "w " * (i * i % 97)) for i in range(1500)] + [(1, "w"), (1, "w"), (None, None), (7, "w " * 40_000)]
    out = B.pack(spark.createDataFrame(rows, KIND), B.Packing(buckets=6, batch_tokens=1000, batch_docs=20)).collect()
    assert len(out) == len(rows)
    assert sorted(r.n_tokens for r in out) == sorted(len((t or "").split()) for _, t in rows)
    batches = defaultdict(list)
    for r in out:
        assert r.bucket_len >= r.n_tokens and r.padding == r.bucket_len - r.n_tokens
        batches[r.batch_id].append(r)
    for rows_ in batches.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert len({r.bucket_len for r in rows_}) == 1
        assert len(rows_) == 1 or len(rows_) * rows_[0].bucket_len <= 1000
        assert len(rows_) <= 20
    assert len({r.bucket_len for r in out}) <= 6


def test_hot_length_is_spread_over_cells(spark):
    rows = [(i, "one two") for i in range(5000)]
    out = B.pack(spark.createDataFrame(rows, KIND)).collect()
    assert len({r.batch_id.rsplit("-", 1)[0] for r in out}) > 3


def test_length_bins_are_exact_first_and_few_later(spark):
    n = spark.createDataFrame([(i,) for i in [0, 1, 1024, 1025, 2048, 10**6, 2**62]], "n long")
    bins = [r[0] for r in n.select(B.length_bin(n.n)).collect()]
    assert bins[:3] == [0, 1, 1024] and bins == sorted(bins) and bins[-1] <= 1024 + 64 * 64


def test_empty_table(spark):
    assert B.pack(spark.createDataFrame([], KIND)).count() == 0


def test_whole_rows_are_carried(spark):
    from rolemill.llm.length_buckets import ADDED, pack

    rows = [(1, "a b", 5), (1, "a b", 5), (None, "c " * 30, 6), (2, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = pack(df, whole=True)
    assert out.columns == ["text", *ADDED]
    assert sorted((str(r.doc_id), str(r.text), r.n_tokens) for r in out.collect()) == sorted((str(i), str(t), len((t or "").split())) for i, t, _ in rows)
    assert pack(df.limit(0), whole=True).columns == out.columns
