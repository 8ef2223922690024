"""Operator 13: SQL parity, and hits, removed spans and dropped documents against a plain loop."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.llm import decontamination as D
from fedsearch.llm import queries
from oracle_compare import compare, duck

LOWER = str.maketrans(D._UPPER, D._LOWER)
LONG = "One two three four five six seven eight nine ten eleven twelve thirteen."
ITEMS = [(1, LONG), (2, "one two THREE four, five six seven eight nine ten!"), (3, "short item"), (4, "Ärger"), (5, None), (6, ""), (7, " .,- "),
         (None, "an item that has no id but holds ten words of its own"), (3, "short item"), (10, "short item")]
DOCS = [(1, f"Before this. {LONG} After that. {LONG} {LONG}"), (2, "ONE-two-three-four-five-six-seven-eight-nine-ten? short... item short item"),
        (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "ärger Ärger ÄRGER"), (6, "ärger Ärger ÄRGER"),
        (7, "clean text without any of it"), (None, "x short item"), (None, "y"), (8, "we met an item that has no id but holds ten words of its own"),
        (9, "word " * 30_000 + LONG), (9, "another text of the same id, short item"), (11, "x" * 50_000)]


def words(text):
    return re.findall(D.WORD, (text or "").translate(LOWER))


def plain(docs, items, window=10):
    """(words, hit places, item ids) of every document."""
    grams = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[p:p + n]), set()).add(i)
    lengths = {len(g) for g in grams}
    for i, text in docs:
        w, places, found = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[p:p + n])):
                    places |= set(range(p, p + n))
                    found |= ids
        yield i, len(w), sorted(places), sorted(str(x) for x in found if x is not None)


def cut(text, places):
    out, at = [], 0
    for k, m in enumerate(re.finditer(D.WORD_ANY_CASE, text)):
        if k in places:
            out.append(text[at:m.start()] if k - 1 not in places else "")
            at = m.end()
            following = re.compile(D.WORD_ANY_CASE).search(text, at)
            at = following.start() if following else len(text)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, gram int")


@pytest.fixture(scope="module")
def docs(spark):
    made = ("_row", "places", "items", "n_words", "digest", "row", "w", "h", "k", "gram", "_id")
    return (spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
            .withColumns({c: F.lit(f"own {c}") for c in made}))


def as_key(x):
    return str(x)


def test_query_equals_sql(spark):
    name = "op13_benchmark_decontamination"
    r = compare(spark, duck(SF01), name, queries.QUERIES[name], queries.ORACLE[name], SF01)
    assert r["ok"], r


@pytest.mark.parametrize(("window", "set_rows"), [(10, 1_000_000), (10, 2), (3, 5)])
def test_brute_force(docs, bench, window, set_rows):
    rows = D.report(docs, bench, window, set_rows).collect()
    got = sorted(((r.doc_id, r.n_words, r.places, r["items"]) for r in rows), key=as_key)
    want = sorted(plain(DOCS, ITEMS, window), key=as_key)
    assert got == want
    assert sum(bool(w[2]) for w in want) >= 7


def test_spans_go(docs, bench):
    out = D.decontaminate(docs, bench, set_rows=3)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in docs.columns[2:])
    want = Counter()
    for (i, text), (_, _, places, _) in zip(DOCS, plain(DOCS, ITEMS)):
        want[i, cut(text, set(places)) if places else text] += 1
    assert Counter((r.doc_id, r.text) for r in rows) == want
    assert want[1, "Before this. After that. "] == 1 and want[7, "clean text without any of it"] == 1


def test_documents_go(docs, bench):
    kept = sorted(r.doc_id or 0 for r in D.decontaminate(docs, bench, remove="documents").collect())
    assert kept == sorted(i or 0 for (i, _), (_, _, places, _) in zip(DOCS, plain(DOCS, ITEMS)) if not places)
    some = {r.text for r in D.decontaminate(docs, bench, remove="documents", max_share=0.5).collect()}
    assert DOCS[11][1] in some and DOCS[0][1] not in some


def test_empty_tables(spark, docs, bench, none):
    assert D.report(none, bench).count() == 0 and D.decontaminate(none, bench).count() == 0
    rows = D.report(docs, bench.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.places or r["items"] for r in rows)
    assert D.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
