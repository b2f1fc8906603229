import random

import pytest

from rolemill.llm import line_dedup as D
from tests.llm.helpers import by_id, same_as_sql

KIND = "doc_id long, text string"
SQL_KIND = "doc_id BIGINT, text VARCHAR"
BASE = "one two three four five six seven eight nine ten"


def edits():
    words = BASE.split()
    return [
        BASE,
        BASE.upper() + "  ",
        " ".join(["zero", *words]),
        " ".join(words[:4] + ["new"] + words[5:]),
        " ".join(words[:4] + words[5:]),
        " ".join(words[1:]),
        " ".join(words + ["eleven", "twelve"]),
        " ".join(reversed(words)),
        "short line here",
        "short line there",
        "a b c d e f g h",
        "a b c d e f g",
        "a b c d e f x",
        "a b c d e f x h",
    ]


def test_like_sql_on_edits_in_any_order(spark):
    rng = random.Random(5)
    lines = edits() * 2 + ["", " \t", "é È é"]
    rows = []
    for i in range(60):
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines[: rng.randrange(0, 12)])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, BASE + "\n"), (104, "\r\n" + BASE)]
    df = D.line_dedup(spark.createDataFrame(rows, KIND).repartition(5))
    assert same_as_sql(df, D.SQL, documents=(rows, SQL_KIND)) == ""


def test_long_lines_and_texts(spark):
    long = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:9_000] + ["x"] + long[9_001:])), (3, " ".join(long[:9_000] + ["x", "y"] + long[9_002:]))]
    out = by_id(D.line_dedup(spark.createDataFrame(rows, KIND)))
    assert [out[i].lines_dropped for i in (1, 2, 3)] == [0, 1, 1]  # the third is one edit from the second


def test_hot_line(spark):
    rows = [(i, f"{BASE}\nown words of the document number {i} are kept by it {i * 7}") for i in range(2000)]
    out = by_id(D.line_dedup(spark.createDataFrame(rows, KIND).repartition(8)))
    assert out[0].lines_dropped == 0
    assert all(out[i].lines_dropped == 1 for i in range(1, 2000))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "only line", 5), (1, "only line", 5), (None, "only line", 6), (1, "other text\nonly line", 7)]
    out = D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lines_dropped int"))
    assert out.columns == ["doc_id", "text", "lines_dropped"]
    got = sorted((r.doc_id or -1, r.text, r.lines_dropped) for r in out.collect())
    assert got == [(-1, "", 1), (1, "only line", 0), (1, "only line", 0), (1, "other text", 1)]


@pytest.mark.parametrize("doc", [None, 4])
def test_rows_of_null_or_equal_ids_and_other_texts(spark, doc):
    near = BASE.replace("seven", "new")
    clean = [f"{w} is a line that no other document of this table has" for w in ("alpha", "beta", "gamma")]
    lines = [f"{BASE}\n{clean[0]}", f"{BASE}\n{clean[1].upper()} or any", f"{near}\n{clean[2]} at all, we hope so", "zebras graze far away from the other animals here"]
    rows = [(doc, t) for t in lines]
    for parts in (1, 3):
        out = D.line_dedup(spark.createDataFrame(rows, KIND).repartition(parts)).collect()
        texts = "\n".join(r.text for r in out).split("\n")
        # of three lines at number 0, two equal and one near, the first stays (an equal one, or the near one)
        assert sum(t in (BASE, near) for t in texts) == 1
        assert sum(r.lines_dropped for r in out) == 2
        assert all(t in texts for text in lines for t in text.split("\n") if t not in (BASE, near))


def test_empty_table(spark):
    assert D.line_dedup(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize(
    "a, b, near",
    [
        ("a b c d e f g h", "a b c d e f g", True),
        ("a b c d e f g h", "b c d e f g h", True),
        ("a b c d e f g h", "b c d e f g h x", False),
        ("a b c d e f g h", "a x c d e f g h", True),
        ("a b c d e f g h", "a x c d e f g y", False),
        ("a b c d e f g", "a b c d e f x", False),
    ],
)
def test_edit_bound(spark, a, b, near):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(a, b)], "a string, b string").select(D.within_one_edit(F.col("a"), F.col("b")).alias("x"), D.within_one_edit(F.col("b"), F.col("a")).alias("y")).first()
    assert (row.x, row.y) == (near, near)
