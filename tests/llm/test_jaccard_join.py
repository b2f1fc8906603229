import random
import re

import numpy as np
from pyspark.sql import functions as F

from rolemill.llm import jaccard_join as J
from rolemill.llm.components import components

KIND = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{position: (set size, smallest id)} over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)]


def got(spark, rows, parts=6):
    df = J.jaccard_classes(spark.createDataFrame(rows, KIND).repartition(parts))
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def varied(seed, families=25, copies=6, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = rng.choices(vocabulary, k=50)
    rows = []
    for f in range(families):
        size = rng.choice([1, 3, 4, 5, 8, 9, 10, 11, 30, 80, 300, 900])
        base = rng.choices(vocabulary, k=size)
        if f % 3 == 0:
            base = base + passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 12))):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
            rows.append((0, (" " if rng.random() < 0.7 else "\n").join(text)))
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_like_brute_force_on_edits(spark):
    for seed in (1, 2):
        rows = varied(seed)
        assert got(spark, rows) == sorted(brute(rows))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE "), (6, "one two three"), (7, "one two"), (8, "é è"), (9, "É è"), (10, "x " * 50_000), (11, "X " * 7), (12, "one"), (12, "one")]
    assert got(spark, rows) == sorted(brute(rows))


def test_chain_of_near_copies_and_a_hot_group(spark):
    words = [f"t{i}" for i in range(240)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(40)]
    rng = random.Random(9)
    hot = []
    for i in range(700):
        text = [f"h{k}" for k in range(120)]
        text[rng.randrange(120)] = f"v{i}"
        hot.append((1000 + i, " ".join(text)))
    rows = chain + hot + [(5000 + i, "same copy of a short text here") for i in range(300)]
    assert got(spark, rows) == sorted(brute(rows))


def test_tree_returns_every_pair_within_the_bound():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 6, (300, J.GROUPS))
    points = np.concatenate([base, np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0)]).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    q, p = J.CountTree(points, sizes).search(points, sizes)
    most = np.minimum(points[:, None, :], points[None]).sum(axis=2)
    want = np.argwhere(most * 185 >= (sizes[:, None] + sizes[None]) * 85)
    assert sorted(zip(q.tolist(), p.tolist())) == sorted(map(tuple, want.tolist()))


def test_pairs_apart_from_the_keys_first_set_are_found(spark, monkeypatch):
    """Sets that share keys but are not near the first set meet in cells, here of two sets."""
    monkeypatch.setattr(J, "CELL", 2)
    rng = random.Random(12)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for f in range(8):
        own = [f"f{f}x{i}" for i in range(60)]
        for _ in range(5):
            text = common + own
            text = text[:]
            text[rng.randrange(360)] = f"z{len(rows)}"
            rows.append((len(rows), " ".join(text)))
    assert got(spark, rows) == sorted(brute(rows))


def test_a_passage_of_half_of_all_texts_is_no_key(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(100)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]
    df = spark.createDataFrame(rows, KIND)
    common = J.common_shingles(df, J.QUERY)
    assert len(common.hashes) >= 97
    groups = {}
    for doc, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        own = J.shingle_sets(data, np.array([0, len(data)]), 4)[0]
        for key in J.keys_of(own, J.QUERY, common).tolist():
            groups.setdefault(key, set()).add(doc)
    assert max(len(g) for g in groups.values()) == 2
    assert got(spark, rows) == sorted(brute(rows))


def test_two_sets_that_link_share_a_key_in_any_order():
    rng = np.random.default_rng(5)
    for need in (80, 85, 95):
        like = J.Likeness(need=need)
        for n in (*range(5, 30), 100, 999):
            own = np.sort(rng.choice(10**6, n, replace=False).astype(np.uint64))
            lost = n - -(-need * n // 100)
            other = np.sort(rng.permutation(own)[lost:])
            common = J.Common(np.sort(rng.permutation(own)[: n // 2]), rng.integers(3, 9, n // 2))
            if len(other) >= like.lone:
                assert set(J.keys_of(own, like, common).tolist()) & set(J.keys_of(other, like, common).tolist())


def test_a_third_of_rows_repeated_is_one_node(spark):
    words = [f"t{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 300 + [(2, " ".join(words[1:]))] * 300 + [(10 + i, f"other {i} text with words {i}") for i in range(300)]
    assert got(spark, rows) == sorted(brute(rows[:1] + rows[300:301] + rows[600:]) + [(1, 57, 1)] * 299 + [(2, 56, 1)] * 299)
    docs = spark.createDataFrame(rows[:600], KIND).repartition(5)
    hashed = J._hashed(docs).select("doc_id", "text_hash").distinct().withColumn("node", F.col("doc_id"))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in J.verified(docs, hashed, pairs, J.QUERY).collect()] == [(1, 2)]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_one_of_each(spark):
    rows = [(2, "a b c d e", 1), (1, "A b c d  e", 2), (1, "A b c d  e", 2), (3, None, 3), (4, "", 4), (5, "other words", 5), (None, "other  words", 6), (None, "lone", 7)]
    out = J.one_of_each(spark.createDataFrame(rows, KIND + ", row int"))
    assert out.columns == ["doc_id", "text", "row"]
    assert sorted(r.row for r in out.collect()) == [2, 3, 4, 5, 7]


def test_one_of_each_keeps_unlinked_documents_whose_ids_are_null_or_equal(spark):
    rows = [(None, "red apples grow on old trees", 1), (None, "fast ships cross the cold sea", 2), (None, "Fast ships cross the cold  sea", 3), (7, "seven men went to the market", 4), (7, "nobody knows what rain will bring", 5)]
    out = [r.row for r in J.one_of_each(spark.createDataFrame(rows, KIND + ", row int")).collect()]
    assert len(out) == 4 and {1, 4, 5} < set(out)


def test_stage_links_five_word_shingles_at_four_fifths(spark):
    from rolemill.llm.stages import jaccard_stage

    words = [f"w{i}" for i in range(184)]
    other = [f"new{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]  # 160 of 200 shingles
    more = [f"new{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]  # below 0.8 with the first
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    assert [r.doc_id for r in jaccard_stage(spark, spark.createDataFrame(rows, KIND), "").collect()] == [1]
    far = [(1, " ".join(words)), (2, " ".join(more))]
    # four shingles of five, whatever the order of their hashes
    small = [(10 + 2 * k + j, " ".join(f"p{k}x{i}" for i in range(8 + j))) for k in range(30) for j in (0, 1)]
    got_ = sorted(r.doc_id for r in jaccard_stage(spark, spark.createDataFrame(far + small, KIND), "").collect())
    assert got_ == [1, 2] + [10 + 2 * k for k in range(30)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 400)] + [(0, i) for i in range(1000, 2000)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(90)]
    got_ = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got_ == {n: find(n) for n in list(root)}
