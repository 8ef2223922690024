"""Operator 10: after any edits the tree's sum is that of the whole text encoded anew."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.llm import edit_counts as E, queries

PIECES = ["a", " ", "  ", "\n", "it's", "\xa0", " the", "1 2", "é", "\x1c", "  ", "'", "s", "ll", " 'll", "日本", "\r\n", "\t", "."]
TEXTS = ["", "a", "  \n ", "x\xa0 y \x0b z", "a\x1c b.\x1c c", " .\x85 q", "日本 語 テキスト\n\n  x", "it's  we'll  don't\t\n",
         "word " * 400, "x" * 3000, " " * 500, "a b. " * 300 + "\xa0" + " c" * 300]


@pytest.fixture(scope="module")
def counter():
    with open(E.VOCABULARY, "rb") as f:
        return E.Counter(f.read())


def full(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def apply(text, at, remove, insert):
    at = min(max(at, 0), len(text))
    return text[:at] + insert + text[min(at + max(remove, 0), len(text)):]


def test_trees_follow_random_edits(counter, documents):
    rng = random.Random(1)
    for text in TEXTS + [documents[d].text for d in sorted(documents)[:80]]:
        tree = E.Tree(text, counter)
        assert "".join(E.units(text)) == text and tree.tokens == full(counter, text)
        for _ in range(20):
            at, remove = rng.randint(-2, len(tree.text) + 2), rng.choice([0, 0, 1, 2, 5, 50, 700])
            insert = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 200])))
            text = apply(tree.text, at, remove, insert)
            tree.edit(at, remove, insert)
            assert tree.text == text and tree.tokens == full(counter, text)
            leaves = E.walk(tree.root)
            assert sum(c for c, _ in leaves) == len(text) and sum(t for _, t in leaves) == tree.tokens


def test_long_runs_of_white_space(counter):
    """Runs around the length from which they are cut out, and far beyond what the library's matcher takes."""
    n = E.LONG_BLANK
    for k in (n - 1, n, n + 1, n + 2, 3000):
        for run in (" " * k, "\n" * k, " \n" * (k // 2) + "\t", "\u3000" * k, " " * (k - 1) + "\xa0"):
            for text in (run, run + "a", "a" + run, "a." + run + ".b" + run + "c", run + "\x1c" + run):
                assert counter._tokens(text) == full(counter, text)
                assert E.Tree(text, counter).tokens == full(counter, text)
    tree = E.Tree("a" + " " * 1_000_000 + "b", counter)
    tree.edit(500_000, 10, "x")
    assert sum(c for c, _ in E.walk(tree.root)) == len(tree.text) == 999_993


def test_only_the_region_is_encoded(counter):
    text = "some words to fill the text " * 5000
    tree = E.Tree(text, counter)
    tree.edit(len(text) // 2, 3, "new")
    assert tree.encoded < 3 * E.LEAF_UNITS * 8
    for i in range(200):  # repeated edits keep the tree shallow
        tree.edit(i * 7, 0, "word after word " * 100)

    def depth(n):
        return 0 if n.left is None else 1 + max(depth(n.left), depth(n.right))

    assert depth(tree.root) < 40 and tree.tokens == full(counter, tree.text)


def test_query(spark, documents, counter):
    rows = queries.op10_edit_counts(spark, SF01).collect()
    assert len(rows) == len(documents)
    for r in rows:
        d = documents[r.doc_id]
        n, text = len(d.text), d.text
        text = apply(text, 0, 0, f"From {d.source} in {d.lang} \n")
        text = apply(text, n // 2, 40, "")
        text = apply(text, n // 3, 7, " [revised 2024] ")
        text = apply(text, n, 0, "\nEnd.")
        assert (r.n_tokens, r.edited_tokens, r.n_edits) == (full(counter, d.text), full(counter, text), 4)


def test_kept_trees_and_edit_tables(spark, edge, none, counter):
    kept = E.trees(edge)
    edits = spark.createDataFrame([(1, 2, 5, 3, "X Y"), (1, 1, 0, 0, "Start "), (3, 1, 9, 9, "new"), (8, 1, 100, 50, None),
                                   (8, 2, None, 1, "q"), (2, 1, 0, 0, "nothing"), (77, 1, 0, 0, "x"), (None, 1, 0, 0, "x")],
                                  "doc_id long, seq int, at long, remove long, insert string")
    rows = E.apply_edits(E.with_edits(kept, edits)).collect()
    assert len(rows) == edge.count()
    old = {r.doc_id: r.text for r in edge.collect()}
    want = dict(old)
    want[1] = apply(apply(old[1], 0, 0, "Start "), 5, 3, "X Y")
    want[3] = "new"
    want[8] = apply(apply(old[8], 100, 50, ""), 0, 1, "q")
    for r in rows:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id]
        assert r.n_tokens == (full(counter, r.text) if r.text is not None else 0)
        assert sum(r.leaf_tokens or []) == r.n_tokens
    assert E.trees(none).count() == 0 and E.apply_edits(E.with_edits(E.trees(none), edits)).count() == 0


def test_clashing_columns(spark, clashing, counter):
    made = clashing.withColumn("n_tokens", F.lit("own")).withColumn("edits", F.array().cast(E.EDITS))
    rows = E.count_with_edits(made).collect()
    assert {r.key for r in rows} == {"own key"}
    assert all(r.n_tokens == r.edited_tokens == full(counter, r.text or "") for r in rows)
