import numpy as np

from rolemill.llm import language_id as G
from tests.llm.helpers import by_id

KIND = "doc_id long, text string, lang string"


def brute_vector(text):
    """One n-gram after the other, by the definition."""
    first, second, third = G._letters()
    table = G._symbols()
    symbols = [0]
    for ch in text.lower():
        s = int(table[ord(ch)])
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(G.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        total += first[a].astype(float) * second[b] * third[c]
    return total


def test_vectors_by_definition():
    texts = ["The cat, the dog!", "Öl für Ärzte 42", "a", "   ", None, "z" * 3000, "日本語 text"]
    got = G.text_vectors(texts)
    for text, vector in zip(texts, got):
        assert np.allclose(vector, brute_vector(text or "")), text


def test_parts_of_a_long_text_add_up(monkeypatch):
    text = "lorem ipsum dolor " * 400
    whole = G.text_vectors([text])
    monkeypatch.setattr(G, "CHUNK_CHARS", 18 * 50)  # cut between words
    parts = G.text_vectors([text])  # only the n-grams over a cut are missing
    assert (parts @ whole.T)[0, 0] / np.linalg.norm(parts) / np.linalg.norm(whole) > 0.9999


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !?", "en"), (5, "the dog", None), (6, "", "de"), (1, "the cat and the dog", "en")]
    docs = spark.createDataFrame(rows, KIND).withColumn("score", G.F.lit("x"))
    prototypes = G.learn_prototypes(docs)
    assert sorted(prototypes) == ["de", "en"]
    out = G.identify(docs, prototypes)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = by_id(out)
    assert {i: got[i].lang_pred for i in got} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "en", 6: "und"}
    assert got[3].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert out.count() == len(rows)


def test_nothing_learned_and_nothing_to_judge(spark):
    docs = spark.createDataFrame([(1, "words", None)], KIND)
    assert G.identify(docs, G.learn_prototypes(docs)).first().lang_pred == "und"
    assert G.identify(docs.limit(0), G.learn_prototypes(docs.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    judged = G.language_query(spark, sf).where("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    assert judged.join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_many_short_texts_are_counted_in_bounded_portions():
    import random

    from rolemill.llm import language_id as L

    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(3000)]
    sizes = [(len(p), len(L.ngram_counts(p)[0])) for _, p in L._portions(texts)]
    assert sum(n for n, _ in sizes) == 3000 and max(n * codes for n, codes in sizes) <= 2 * L.CHUNK_COUNTS
    assert len(sizes) > 3
