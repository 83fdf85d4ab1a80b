from pyspark.sql import functions as F

from tests.helpers import lines_of, rows
from tidemark.functions.words import clean_word, edge_flags
from tidemark.operators import words
from tidemark.sources import sinks
from tidemark.sources.text import read_lines


def counts(spark, *lines):
    return dict(rows(words.word_counts(lines_of(spark, *lines))))


def preds(spark, *lines):
    return rows(words.word_predecessors(lines_of(spark, *lines)), "word", "pred")


def test_clean_word_and_flags(spark):
    df = spark.createDataFrame([("'Don't,",), ("12",), ("Play",), ("(x",)], "t string")
    got = rows(df.select(clean_word("t"), edge_flags("t").starts, edge_flags("t").ends))
    assert got == [("don't", True, True), ("", True, True), ("play", False, False), ("x", True, False)]


def test_word_before_a_non_word_is_not_counted(spark):
    assert counts(spark, "a b 12") == {"a": 1}
    assert counts(spark, "a b") == {"a": 1, "b": 1}


def test_blanks_inside_and_at_the_end(spark):
    # the empty token between two blanks is no word; blanks at the end are dropped
    assert counts(spark, "a  b") == {"b": 1}
    assert counts(spark, "a b   ", "", "   ") == {"a": 1, "b": 1}


def test_marks_hide_predecessors(spark):
    assert preds(spark, "i (play) it, now then") == [("then", "now", 1)]
    assert preds(spark, "don't go", "don't go") == [("go", "don't", 2)]


def test_bigrams_keep_line_ends(spark):
    got = rows(words.bigrams(lines_of(spark, "A b")).select("first", "second"), F.col("first").asc_nulls_first())
    assert got == [(None, "a"), ("a", "b"), ("b", None)]


def test_report_keeps_words_without_visible_predecessor(spark, tmp_path):
    report = words.word_freq_report(lines_of(spark, "x y y", "z, y"))
    # y: after x, after y, and hidden after the comma; x and z only open lines, so one empty line stands below them
    want = ["y:3", "\tx:1", "\ty:1", "x:1", "\t", "z:1", "\t"]
    assert [r.line for r in report.orderBy(*words.report_order()).collect()] == want
    sinks.write_lines(report, str(tmp_path / "out"), order=words.report_order())
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "out")).collect()) == sorted(want)


def test_report_leaves_commas_and_brackets_inside_words(spark):
    report = words.word_freq_report(lines_of(spark, "a b(c,d)e"))
    assert "b(c,d)e:1" in [r.line for r in report.collect()]


def test_plain_tokens_are_judged_by_one_search(spark):
    lines = lines_of(spark, "ab\r c\u00e9 d'e f.")
    plan = words.bigrams(lines)._jdf.queryExecution().analyzed().toString()
    assert r"^[a-zA-Z]+\z" in plan and plan.index(r"^[a-zA-Z]+\z") < plan.index("regexp_replace")
    got = rows(words.bigrams(lines).select("second", "second_starts", "second_ends").filter("second is not null"))
    assert got == [("ab", False, False), ("c", False, True), ("d'e", False, False), ("f", False, True)]
