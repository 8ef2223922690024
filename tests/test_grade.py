"""Golden strings for answer grading, with the letter that the rule gives each."""

import pytest
from pyspark.sql import functions as F

from fedsearch.functions import grade as G

#: output, letter located in it, cleaned tail after the closing phrase
GOLDEN = [
    ("B", "B", "B"), (" C", "C", "C"), ("B or C", "B", "B or C"),
    ('{"answer_choice": "D"}', "D", "{answer_choice: D}"),
    ('"answer_choice": "A" then "answer_choice": "C"', "C", "answer_choice: A then answer_choice: C"),
    ("The answer: Because", "B", "The answer: Because"), ("option Dog", "D", "option Dog"),
    ("D.", "D", "D"), ("A, B", "A", "A, B"), ("C and D", "C", "C and D"), ("B\n", "B", "B"),
    ("\u00a0A", "A", "A"), ("\u2003B ", "B", "B"), ("\u3000C", "C", "C"), ("D\u0085", "D", "D"),
    ("a", "", "a"), ("", "", ""), ("nothing useful here", "", "nothing useful here"), ("A/B", "A", "A/B"),
    ('C"', "C", "C"), ("D: yes", "D", "D: yes"), ("Option B is right", "B", "Option B is right"),
    ("The best answer is C.", "", "C"), ('The best answer is "D"', "", "D"),
    ("The best answer is A. The best answer is B", "", "B"), ("\x1cB\x1d", "B", "B"), ("x: \u00a0A", "A", "x: \u00a0A"),
]


@pytest.mark.parametrize("gold", ["A", "B", "C", "D", "E"])
def test_golden_strings(spark, gold):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(GOLDEN)], "i int, out string").withColumn("gold", F.lit(gold))
    got = df.select("i", G.letter_from_json_answer("out").alias("pred"), G.letter_from_tail("out").alias("tail"),
                    G.grade_letter_json("out", "gold").alias("ok_json"),
                    G.grade_letter_tail("out", "gold").alias("ok_tail")).collect()
    for r in got:
        _, letter, tail = GOLDEN[r.i]
        assert (r.pred, r.tail) == (letter, tail), GOLDEN[r.i]
        assert r.ok_json == (gold in "ABCD" and letter == gold)
        assert r.ok_tail == (tail == gold)


def test_no_gold_counts_as_correct(spark):
    assert spark.range(1).select(G.grade_none().alias("g")).first().g is True


def test_word_initial_letters_match_as_in_the_rule(spark):
    df = spark.createDataFrame([("The answer: Because",), ("option Dog",)], "out string")
    preds = [r.p for r in df.select(G.letter_from_json_answer("out").alias("p")).collect()]
    assert preds == ["B", "D"]
