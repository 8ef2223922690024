"""Operator 11: SQL parity, a plain walk over all orders, and the merges against sets."""

import random
import re
from itertools import permutations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from conftest import SF01
from fedsearch.llm import filter_audit as A
from fedsearch.llm import queries
from oracle_compare import compare, duck

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
lists = st.lists(st.lists(st.integers(0, 60), unique=True).map(sorted), max_size=5)


def plain_fails(docs):
    """docs: (doc_id, text, source); the failing letters of each."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": i is not None and least[text] < i}
        yield source or "", {f for f, bad in tests.items() if bad}, i


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = list(plain_fails(docs))
    out = {}
    for part in {p for p, _, _ in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(f, i) for p, f, i in rows if p == part]
            whole = left
            for s, name in enumerate(order):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                shapley[name] += len(gone)
                out[part, "".join(order), s + 1] = [
                    len(left), len(gone), sum(name in f for f, _ in whole) - len(gone), sum(f == {name} for f, _ in whole),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), name]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_query_equals_sql(spark):
    r = compare(spark, duck(SF01), "op11", queries.op11_filter_audit, queries.ORACLE["op11_filter_audit"], SF01)
    assert r["ok"], r


@pytest.mark.parametrize("range_rows", [1, 3, 65_536])
def test_edges(spark, clashing, labels, range_rows):
    docs = [(r.doc_id, r.text, r.source) for r in clashing.collect()]
    want = plain_audit(docs, [tuple(r) for r in labels.collect()])
    assert got(A.audit(clashing, labels, range_rows)) == want
    assert {p for p, _, _ in want} == {"", "a", "b", "c"}


def test_empty_and_unlabelled(spark, edge, none, no_labels):
    assert A.audit(none, no_labels).count() == 0
    assert got(A.audit(edge, no_labels)) == plain_audit([(r.doc_id, r.text, r.source) for r in edge.collect()], [])


def test_one_part_and_one_id_hold_most_rows(spark, no_labels):
    texts = ["plain words", "A B C", "a # b", "word " * 300]
    docs = [(7 if i % 3 else i, texts[i % 4], "hot" if i % 10 else None) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert got(A.audit(df, no_labels, 50)) == plain_audit(docs, [])


@given(lists)
def test_union_and_difference(ids):
    assert A.union(ids) == sorted(set().union(*ids))
    if ids:
        rest = A.union(ids[1:])
        assert A.difference_size(ids[0], rest) == len(set(ids[0]) - set(rest))


def test_gallop_is_bisect():
    ids = sorted(random.Random(1).sample(range(500), 200))
    for at in (0, 5, 199, 200):
        for x in range(-1, 502, 7):
            assert A.gallop(ids, at, x) == next((i for i in range(at, 200) if ids[i] >= x), max(at, 200))
