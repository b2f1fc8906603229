"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted by its place; a text's vector bundles (adds) its n-grams' vectors, and a
language's prototype bundles those of its training texts. A text is given the language whose
prototype has the largest cosine with it; that cosine, from 0 up, is the score.

Bundling is linear, so texts are counted first and vectors added once per different n-gram. Training
sums n-gram counts per language in Spark (at most 64**3 rows each); a language's counts become one
vector in one task, and the driver gets one vector per language.

Letters are what Unicode calls alphabetic, in lower case: a to z have vectors of their own, others
share 37 more by code point; runs of anything else are one word boundary.

Defined results: `und` with score 0 where the text is null or has no letters, or where there is
nothing to learn from; ties go to the first language by name; texts of any length are read whole;
rows with null language are not learned from; an empty table gives no rows; extra columns are kept, but
for ones named lang_pred or score, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import read
from rolemill.session import ship_package

SYMBOLS = 64
CODES = SYMBOLS**3
DIMENSIONS = 1024
#: Characters counted at a time, and n-gram vectors made at a time.
CHUNK_CHARS, CHUNK_CODES = 1 << 19, 8192
#: Counts (texts x n-grams) held at a time, 12 bytes each; short texts are many to a portion.
CHUNK_COUNTS = 1 << 24
#: Languages whose counts a training task holds before it passes them on.
HELD_LANGUAGES = 32


@cache
def _symbols() -> np.ndarray:
    """Code point to letter number; 0 is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x80, 0x110000):
        if chr(cp).isalpha():
            table[cp] = 27 + cp % 37
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    return table


@cache
def _letters(dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as they stand in first, second and third place of an n-gram."""
    base = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return (first[codes >> 12] * second[(codes >> 6) & 63] * third[codes & 63]).astype(np.float32)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): the n-grams that occur, and how often in each text (texts x codes)."""
    sizes = np.array([len(t) + 2 for t in texts])
    joined = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, owner = _symbols()[joined], np.repeat(np.arange(len(texts)), sizes)
    keep = symbols != 0
    keep[1:] |= (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[0] = True
    symbols, owner = symbols[keep].astype(np.int32), owner[keep]
    grams = (symbols[:-2] << 12) | (symbols[1:-1] << 6) | symbols[2:]
    inside = (owner[:-2] == owner[2:]) & (grams != 0)
    grams, owner = grams[inside], owner[:-2][inside]
    seen = np.zeros(CODES, bool)
    seen[grams] = True
    codes = np.flatnonzero(seen)
    rank = np.zeros(CODES, np.int32)
    rank[codes] = np.arange(len(codes))
    counts = np.bincount(owner * len(codes) + rank[grams], minlength=len(texts) * len(codes))
    return codes, counts.reshape(len(texts), len(codes)).astype(np.float32)


def _portions(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts, and whose they are: about CHUNK_CHARS characters, and no more than CHUNK_COUNTS counts, at a time."""
    rows, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), CHUNK_CHARS):
            piece = text[at : at + CHUNK_CHARS]
            rows.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= CHUNK_CHARS or len(pieces) * min(held, CODES) >= CHUNK_COUNTS:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if pieces:
        yield rows, pieces


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """A row of DIMENSIONS numbers for each text; zero where it has no letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for rows, pieces in _portions(texts):
        codes, counts = ngram_counts(pieces)
        vectors = np.zeros((len(pieces), DIMENSIONS), np.float32)
        for at in range(0, len(codes), CHUNK_CODES):
            vectors += counts[:, at : at + CHUNK_CODES] @ ngram_vectors(codes[at : at + CHUNK_CODES])
        np.add.at(out, rows, vectors)
    return out


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CODES, np.int64))

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(counts[codes])], ["lang", "code", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for rows, pieces in _portions(texts):
            codes, counts = ngram_counts(pieces)
            of = np.array([langs[i] for i in rows], dtype=object)
            for lang in set(of):
                held[lang][codes] += counts[of == lang].sum(axis=0).astype(np.int64)
                if len(held) >= HELD_LANGUAGES:
                    yield from passed_on()
    yield from passed_on()


def _bundle(group: pd.DataFrame) -> pd.DataFrame:
    """A language's n-gram counts (at most 64**3 rows) to its prototype, of length 1."""
    codes, n = group["code"].to_numpy(), group["n"].to_numpy()
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(codes), CHUNK_CODES):
        total += n[at : at + CHUNK_CODES].astype(float) @ ngram_vectors(codes[at : at + CHUNK_CODES]).astype(float)
    size = np.linalg.norm(total)
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "vector": [(total / size if size else total).tolist()]})


def learn_prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """A vector per language from (text, lang)."""
    ship_package(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = rows.mapInArrow(_count_languages, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").applyInPandas(_bundle, "lang string, vector array<double>").collect()
    return {r.lang: np.array(r.vector) for r in sorted(found, key=lambda r: r.lang)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to the rows, or replace them."""
    ship_package(docs.sparkSession)
    names = sorted(prototypes)
    table = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = text_vectors(batch.column(text_col).to_pylist())
            sizes = np.linalg.norm(vectors, axis=1)
            known = (sizes > 0) & bool(names)
            cosines = (vectors @ table.T) / np.where(sizes > 0, sizes, 1)[:, None] if names else np.zeros((len(vectors), 1))
            best = cosines.argmax(axis=1)
            langs = [names[b] if k else "und" for b, k in zip(best, known)]
            scores = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], schema=pa.schema([*batch.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    docs = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.where(~F.coalesce(held_out(), F.lit(False))))
    judged = identify(docs.select("doc_id", "text"), prototypes)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
