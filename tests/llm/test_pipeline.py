"""The pipeline and the registered queries on the given tables."""

import pytest

import corpus_pipeline
from rolemill.llm.common import written
from rolemill.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tests.llm.test_jaccard_join import brute
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == ""


def test_url_query_covers_all_pages(spark):
    assert QUERIES["op3_url_graph"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()


def test_jaccard_query_like_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op5_jaccard_join"](spark, SF_DIR).collect())
    assert got == sorted(brute(docs))


def test_packing_query_covers_all_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    packed = QUERIES["op9_length_buckets"](spark, SF_DIR)
    assert sorted(r.doc_id for r in packed.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


ROWS = [
    (1, "the cat sat on the mat and looked at the red moon\nfirst line of its own", "en", "a", 70),
    (2, "the cat sat on the mat and looked at the old moon\nsecond text has this", "en", "a", 70),
    (3, "the cat sat on the mat and looked at the red moon", "en", "b", 50),
    (4, None, "en", "b", None),
    (5, "12345 !!!", None, None, 9),
    (6, "der hund lief durch den wald und bellte laut", "de", "b", 44),
    (7, "second text has this\nand something else that is new to all of them here", "en", "c", 60),
]


def test_stages_on_a_small_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    shapes = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        shapes[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(shapes["language ID"]) == {1, 2, 3, 6, 7}
    lines = shapes["line dedup"]
    assert set(lines) == {1, 2, 6, 7}
    assert lines[2].text == "second text has this" and lines[2].n_chars == len(lines[2].text)
    assert lines[7].text.startswith("and something")
    assert set(shapes["jaccard join"]) == {1, 2, 6, 7}
    assert set(shapes["packing"]) == set(shapes["mixing"]) <= {1, 2, 6, 7}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        assert docs.count() == 0


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
    ids = lambda df: sorted((r.doc_id, r.n_tokens, r.bucket_len) for r in df.collect())
    assert ids(corpus_pipeline.run(spark, SF_DIR)) == ids(docs)
