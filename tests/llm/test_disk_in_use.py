"""Tables and shuffle files that nothing reads any more don't stay on disk."""

import random
from pathlib import Path

import pytest

from rolemill.llm import jaccard_join as J
from rolemill.llm.common import discard, written
from rolemill.llm.components import components
from rolemill.llm.line_dedup import line_dedup
from rolemill.llm.source_mixing import mix_sources
from rolemill.session import durable_root
from tests.llm.test_jaccard_join import KIND, brute


@pytest.fixture
def left(spark):
    """Purposes of the written tables that are new since the test began."""
    root = Path(durable_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    return lambda: sorted(p.name.rpartition("-")[0] for p in set(root.iterdir()) - before)


def near_copies(seed, families=30, copies=7):
    """Copies share keys with others of their family than its first, and families share a passage."""
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(60)], []
    for f in range(families):
        base = passage + [f"f{f}x{i}" for i in range(120)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(180)] = f"v{rng.randrange(10**6)}"
            rows.append((f * copies + c, " ".join(text)))
    return rows


def test_a_discarded_table_is_gone(spark, left):
    table = written(spark.range(3), "one")
    other = written(table.selectExpr("id + 1 AS id"), "two", gone=[table])
    assert left() == ["two"] and sorted(r.id for r in other.collect()) == [1, 2, 3]
    discard(other)
    assert left() == []


def test_components_leave_their_roots_only(spark, left):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
    assert left() == ["roots"]


def test_the_jaccard_join_leaves_only_what_its_result_reads(spark, left):
    rows = near_copies(3)
    out = J.jaccard_classes(spark.createDataFrame(rows, KIND).repartition(6))
    assert left() == ["named", "rows"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == sorted(brute(rows))


def test_sets_that_met_their_keys_first_set_do_not_meet_again(spark, monkeypatch):
    """Keys of two sets are done after the first step."""
    given = []
    found = J._in_batches
    monkeypatch.setattr(J, "_in_batches", lambda rows, total, best, need: given.append(rows.count()) or found(rows, total, best, need))
    words = [f"w{i}" for i in range(30)]
    apart = [(j, " ".join(words + [f"own{j}x{k}" for k in range(60)])) for j in (0, 1)]
    out = J.jaccard_classes(spark.createDataFrame(apart, KIND))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == sorted(brute(apart))
    assert given == [0, 0]


def test_shuffle_files_go_with_their_run(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, "false")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for f in folders for p in Path(f).rglob("shuffle_*")}
    there = files()
    written(spark.range(1000).groupBy("id").count(), "counts")
    assert files() <= there
    assert spark.conf.get(conf, "false") == before


def test_line_dedup_and_mixing_leave_only_what_their_results_read(spark, left):
    rows = [(i, f"a line of its own number {i}\nand one that all of these texts have in it", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sum(r.lines_dropped for r in line_dedup(docs).collect()) == 19
    assert left() == ["dropped"]
    mix_sources(docs).collect()
    assert left() == ["dropped", "mix"]
