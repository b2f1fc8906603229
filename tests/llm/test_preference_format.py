from rolemill.llm import preference_format as P
from tests.llm.helpers import by_id, same_as_sql

KIND = "conv_id long, turn long, role string, text string"
SQL_KIND = "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"
ROWS = [
    (0, 0, "user", "hi"),
    (0, 1, "assistant", "one"),
    (0, 2, "user", "more"),
    (0, 3, "assistant", "two"),
    (0, 4, "user", "bye"),
    (1, 0, "system", None),
    (1, 1, None, "who"),
    (1, 2, "assistant", "other"),
    (2, 0, "user", "no answer"),
    (3, 0, "assistant", "same"),
    (4, 0, "user", "a"),
    (4, 0, "user", "a"),
    (4, 1, "assistant", "b" * 50_000),
    (5, None, "assistant", "late"),
    (5, 7, "user", "early"),
    (None, 0, "user", "lost"),
]


def test_like_sql(spark):
    df = P.format_preferences(P.reply_pairs(spark.createDataFrame(ROWS, KIND)))
    assert same_as_sql(df, P.SQL, conversations=(ROWS, SQL_KIND)) == ""


def test_prefix_is_rendered_once_and_only_replies_carry_loss(spark):
    out = by_id(P.format_preferences(P.reply_pairs(spark.createDataFrame(ROWS, KIND))), "conv_id")
    assert out[0].n_common == 3
    assert out[0].prompt.count("<|end|>") == 3
    start, end = map(int, out[0].chosen_spans.split("-"))
    assert out[0].chosen_completion[start:end] == "two<|end|>\n"
    start, end = map(int, out[0].rejected_spans.split("-"))
    assert out[0].rejected_completion[start:end] == "other<|end|>\n"
    assert not out[2].has_preference and out[2].chosen_completion == ""


def test_one_side_is_a_prefix_of_the_other(spark):
    turns = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a")]), (2, [], [("user", "a")]), (3, [], [])]
    out = by_id(P.format_preferences(spark.createDataFrame(rows, f"id long, chosen {turns}, rejected {turns}")), "id")
    assert (out[1].n_common, out[1].rejected_completion) == (1, "")
    assert (out[2].n_common, out[2].prompt) == (0, "")
    assert (out[3].n_common, out[3].has_preference) == (0, False)


def test_empty_table(spark):
    assert P.format_preferences(P.reply_pairs(spark.createDataFrame([], KIND))).count() == 0


def test_columns_of_clashing_names(spark):
    from rolemill.llm.preference_format import ADDED, format_preferences

    turn = "array<struct<role string, text string>>".replace("role string", "role:string").replace("text string", "text:string")
    rows = [(1, [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")], "p", 7, "x")]
    df = spark.createDataFrame(rows, f"id long, chosen {turn}, rejected {turn}, PROMPT string, n_common int, row string")
    out = format_preferences(df)
    assert out.columns == ["id", "row", *ADDED]
    r = out.first()
    assert (r.id, r.row, r.n_common, r.has_preference) == (1, "x", 1, True) and "yes" in r.chosen_completion
