import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from rolemill.llm import fill_in_middle as T
from tests.llm.helpers import same_as_sql

KIND = "doc_id long, text string"


def plain_python(doc_id, text):
    """(n, form, prefix characters, middle characters, output) by lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(rng, many):
    letters = ["a", "é", "語", "𝄞", "\n", "\n", "\r", "<", "P", "S", ">", " ", "\x85", "\t"]
    return ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 7, 8, 9, 40, 300]))) for _ in range(many)]


def test_like_lists_of_lines_and_like_sql(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 400)))
    rows += [(900, None), (901, ""), (902, "\n"), (903, "a<M>b\n"), (904, "no end"), (905, "x\n" * 70000), (906, "<P\n>\n<S\n<"), (-3, "a\nb\nc\n"), (None, "a\nb"), (None, None)]
    rows += rows[:50]
    out = T.fill_in_middle(spark.createDataFrame(rows, KIND).repartition(3)).withColumn("back", T.restored())
    key = lambda r: tuple((x is not None, x) for x in r)
    have = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=key)
    want = sorted(((i, t, *plain_python(i, t), t or "") for i, t in rows), key=key)
    assert have == want
    digests = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))
    assert same_as_sql(digests, T.SQL, documents=(rows, "doc_id BIGINT, text VARCHAR")) == ""


def test_rank_and_select_like_positions():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([10, 11, 0x8A, 0x0B, 0, 255, 0x0A], np.uint8), size)
        marks = T.unit_ends(T._words(data), np.array([0, size]))
        places = np.flatnonzero((data == 10) | (np.arange(size) == size - 1))
        assert np.array_equal(marks.select(np.arange(1, len(places) + 1)), places)
        at = np.arange(size + 1)
        assert np.array_equal(marks.rank(at), np.searchsorted(places, at))


def test_clashing_and_extra_columns_and_rates(spark):
    rows = [(i, f"a{i}\nb\nc\n", "x", 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, OUTPUT string, h1 double")
    out = T.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "h1", *T.ADDED]
    assert {r.h1 for r in out.collect()} == {1.5}
    assert {r.form for r in T.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in T.fill_in_middle(df, spm_rate=0).collect()} == {"psm"}
    assert T.fill_in_middle(df.limit(0)).count() == 0
