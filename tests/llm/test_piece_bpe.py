import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rolemill.llm import piece_bpe as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["ab ", "the anioestr", "aeiou▁ \n\t", "abcdefghijklmnopqrstuvwxyz", "éàçñ日本語 𝄞​", "=-_*#/ ", "0123456789 ,."]
ODD = ["", " ", "  ", "▁", "▁ a", "a\x00b", "語𝄞 é", " " * 3000, "a" * 5000, "x" + " " * 37 + "y   z ", "</s><unk><0x41>", "\n\n\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return T.load_vocabulary(MODEL)


def coded(texts, vocabulary, window=T.WINDOW):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    ids, ends = T.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, vocabulary, window)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], [t.decode() for t in T.decode(ids, ends, vocabulary)]


@pytest.mark.parametrize("window", [T.WINDOW, 50])
def test_like_the_library(library, vocabulary, window):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choices(a, k=rng.randrange(60))) for a in ALPHABETS for _ in range(400)]
    ids, decoded = coded(texts, vocabulary, window)
    want = [library.encode(t) + [library.eos_id()] for t in texts]
    assert ids == want
    assert decoded == [library.decode(w) for w in want]


def test_decodes_any_ids_like_the_library(library, vocabulary):
    rng = random.Random(4)
    lists = [rng.choices(range(0, 400), k=rng.randrange(12)) for _ in range(500)] + [[2, 28705], [1, 1, 259, 28705], [3 + 0xE8], [3 + 0xE8, 3 + 0xAA, 28705]]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    have = T.decode(np.array([i for x in lists for i in x], np.int32), ends, vocabulary)
    assert [h.decode() for h in have] == [library.decode(x) for x in lists]


def test_a_new_pair_that_is_due_first_is_merged_first(vocabulary):
    blank = vocabulary.of_char[0x2581]
    run = [int(blank)] * 70
    rank = vocabulary.pair_dict[run[0] * (vocabulary.size + T._CHARS) + run[0]][0]
    assert [vocabulary.surface_at[i + 1] - vocabulary.surface_at[i] for i in T.sweep(run, rank, vocabulary)][0] == 16


def test_bytes_that_are_no_utf8(vocabulary):
    ids, decoded = coded([b"a\xffb", "ok"], vocabulary)
    assert decoded == ["a�b", "ok"] and ids[1] == coded(["ok"], vocabulary)[0][0]


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (3, None, None), (3, "twice", "y"), (3, "twice", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(3)
    out = T.decode_ids(T.encode_texts(df, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    have = sorted((str(r.doc_id), r.text or "", r.ids, r.decoded) for r in out.collect())
    want = sorted((str(i), t or "", (w := library.encode(t or "") + [2]), library.decode(w)) for i, t, _ in rows)
    assert have == want
    assert sorted(map(str, T.encode_texts(df, MODEL, decoded=True).collect())) == sorted(map(str, out.collect()))
    assert T.decode_ids(T.encode_texts(df.limit(0), MODEL), MODEL).count() == 0


def test_query_like_the_library(spark, library):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    have = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in T.piece_query(spark, sf_dir).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = library.encode(t) + [2]
        want[i] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
    assert have == want


def test_other_kinds_of_model_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as kinds

    model = kinds.ModelProto()
    with open(MODEL, "rb") as data:
        model.ParseFromString(data.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        T.load_vocabulary(str(path))
