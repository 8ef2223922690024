"""Operator 1: apportionment against a naive highest-quotient loop, targets against reshare rounds."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.llm import mixing, queries


def highest_quotients(votes, seats):
    won = {k: 0 for k in votes}
    for _ in range(seats):
        k = min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
        won[k] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_equals_naive_loop(spark, seed):
    rng = random.Random(seed)
    groups = {g: ({i: rng.choice([0, 1, 1, 5, rng.randint(1, 10 ** 6)]) for i in range(rng.randint(1, 9))},
                  rng.choice([0, 1, 3, 50, 700])) for g in range(6)}
    groups = {g: (v, s) for g, (v, s) in groups.items() if any(v.values())}
    rows = [(g, i, v, s) for g, (vs, s) in groups.items() for i, v in vs.items()]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, votes long, seats long"),
                              ["g"], "i", "votes", "seats").collect()
    for g, (vs, s) in groups.items():
        assert {r.i: r.won for r in got if r.g == g} == highest_quotients(vs, s)


def reshared(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    free = list(names)
    while free:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 3, None: 50}, {"a": 5}, {"é": 0, "z": 9, "Z": 1000},
                                   {"a": 0, None: 0}])
def test_targets_equal_rounds_of_resharing(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_query(spark, documents):
    rows = queries.op1_mix_sources(spark, SF01).collect()
    sizes = {d: len(r.text.encode().split()) for d, r in documents.items()}
    assert {r.doc_id: r.size for r in rows} == sizes
    per = {}
    for r in rows:
        per.setdefault(r.source, [0, 0, r.source_size, r.target])
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = reshared({s: v[2] for s, v in per.items()})
    for s, (size, taken, source_size, target) in per.items():
        assert size == source_size and abs(target - want[s]) < 1e-6
        assert abs(taken - target) <= 0.005 * target + 32
    assert sorted(map(tuple, queries.op1_mix_sources(spark, SF01).collect())) == sorted(map(tuple, rows))


def test_edges(spark, edge, none, clashing):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count()
    assert all(r.taken <= 2 * r.size and (r.size or not r.taken) for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0
    out = mixing.mixed_texts(clashing)
    assert out.columns == clashing.columns
    assert out.where(~F.col("score").eqNullSafe("own score")).count() == 0


def test_mixed_texts_hold_the_taken_words(spark, edge):
    taken = {}
    for r in mixing.mix(edge).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = {}
    for r in mixing.mixed_texts(edge).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == {d: n for d, n in taken.items() if n}
