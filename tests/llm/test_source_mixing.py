from collections import Counter

import numpy as np

from rolemill.llm import source_mixing as S
from tests.llm.helpers import same_as_sql

KIND = "doc_id long, source string, text string"
SQL_KIND = "doc_id BIGINT, source VARCHAR, text VARCHAR"


def corpus():
    sizes = {"big": 400, "mid": 60, "small": 6, None: 20}
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, source, "w " * (200 + 37 * (k % 11))))
            i += 1
    return [*rows, (i, "silent", None), (i + 1, "mid", ""), (i + 2, "mid", "v " * 9000)]


def test_like_sql_on_a_hot_source(spark):
    rows = corpus()
    df = S.mix_sources(spark.createDataFrame(rows, KIND)).select("doc_id", "source", "mix_pass", "mix_block")
    assert same_as_sql(df, S.SQL, documents=(rows, SQL_KIND)) == ""


def test_quotas_entropy_and_limit(spark):
    rows = corpus()
    words = Counter()
    for _, s, t in rows:
        words[s] += len((t or "").split())
    mix = S.Mix(target_entropy=0.9, max_repeats=50, block_tokens=256)
    taken = Counter()
    for r in S.mix_sources(spark.createDataFrame(rows, KIND), mix).collect():
        taken[r.source] += len((r.text or "").split())
    p = np.array([words[s] for s in ("big", "mid", "small", None)], float)
    p /= p.sum()
    grid = np.linspace(0, 1, 20001)
    w = p[None] ** grid[:, None]
    w /= w.sum(1, keepdims=True)
    h = -(w * np.log(w)).sum(1) / np.log(4)
    best = w[np.flatnonzero(h >= 0.9)[-1]]
    total = sum(words.values())
    for s, share in zip(("big", "mid", "small", None), best):
        # a quota is met but for less than the largest block, here the longest document and what shares its block
        assert share * total - 12_000 <= taken[s] <= share * total + 20, (s, share * total, taken[s])
    limited = S.mix_sources(spark.createDataFrame(rows, KIND), S.Mix(target_entropy=1.0, max_repeats=2.0, block_tokens=256))
    assert max(r.mix_pass for r in limited.collect()) <= 1


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a", "x y", 9), (1, "a", "x y", 9), (None, "b", "z", 9)]
    out = S.mix_sources(spark.createDataFrame(rows, KIND + ", mix_pass int"), S.Mix(target_entropy=0.1))
    assert out.columns == ["doc_id", "source", "text", "mix_pass", "mix_block"]
    assert out.count() == 3


def test_nothing_to_mix(spark):
    assert S.mix_sources(spark.createDataFrame([], KIND)).count() == 0
    assert S.mix_sources(spark.createDataFrame([(1, "a", None), (2, None, " ")], KIND)).count() == 0
