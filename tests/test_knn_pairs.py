"""The search by built-in expressions: few pairs are scored, and odd vectors rank as they would among all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsearch.functions.vectors import score
from fedsearch.operators import retrieve as K

CORPUS, QUERIES = "source_id int, vec_id long, v array<double>", "source_id int, qid long, qv array<double>"


def test_scored_pairs_do_not_grow_with_queries_times_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(0, i, rng.normal(size=6).tolist()) for i in range(2000)], CORPUS)
    queries = spark.createDataFrame([(0, i, rng.normal(size=6).tolist()) for i in range(50)], QUERIES)
    want = sorted(K.knn(queries, corpus, 3).select("qid", "vec_id", "score", "local_rank").collect())
    scored = spark.sparkContext.accumulator(0)

    def counted(qv, v, score_fn):
        def dot(a, b):
            scored.add(1)
            total = 0.0
            for x, y in zip(a, b):
                total += x * y
            return total
        return F.udf(dot, "double")(qv, v)

    monkeypatch.setattr(K, "score_expr", counted)
    assert sorted(K.knn(queries, corpus, 3).select("qid", "vec_id", "score", "local_rank").collect()) == want
    assert 0 < scored.value < 0.05 * 50 * 2000, scored.value


def odd(rng, width=3):
    u = rng.random()
    v = [float(x) for x in rng.integers(-2, 3, width if u < 0.8 else int(rng.integers(0, 5)))]
    if u < 0.05:
        return None
    if u < 0.1:
        v[0] = None
    elif u < 0.13:
        v = [0.0] * width
    elif u < 0.17:
        v[-1] = float(rng.choice([np.nan, np.inf, -np.inf, 1e200]))
    return v


@pytest.mark.parametrize("fn,higher", [("dot", True), ("dot", False), ("cos_sim", True), ("cos_sim", False)])
def test_odd_vectors_and_keys_rank_as_among_all_pairs(spark, fn, higher):
    """Null, short, zero, infinite and equal vectors; keys that repeat or are null."""
    rng = np.random.default_rng(2)
    key = lambda n, p: int(rng.integers(0, n)) if rng.random() > p else None
    corpus = spark.createDataFrame([(key(3, 0.05), key(400, 0.02), odd(rng)) for _ in range(300)], CORPUS).repartition(3)
    queries = spark.createDataFrame([(key(4, 0.0), key(40, 0.05), odd(rng)) for _ in range(40)], QUERIES).repartition(2)
    every = corpus.join(queries, "source_id").select("qid", "source_id", "vec_id", score("qv", "v", fn).alias("score"))
    plain = K.topk(every, ["qid", "source_id"], "score", 7, "local_rank", higher)
    got = K.knn(queries, corpus, 7, fn, higher, tile_rows=11, block_queries=4)
    shown = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
    assert shown(got) == shown(plain) and got.schema == plain.schema


def test_tiles_of_one_source_are_joined_under_several_keys(spark):
    """A join on the source alone gives a source one task, however large it is."""
    rng = np.random.default_rng(3)
    corpus = spark.createDataFrame([(0, i, rng.normal(size=4).tolist()) for i in range(600)], CORPUS)
    queries = spark.createDataFrame([(0, i, rng.normal(size=4).tolist()) for i in range(20)], QUERIES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = K.knn_arrow(queries, corpus, 3, tile_rows=20, block_queries=8)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        got = sorted(hits.select("qid", "vec_id", "score", "local_rank").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "SortMergeJoin" in x and "Inner" in x]
    assert joins and all("share" in x for x in joins), plan
    assert got == sorted(K.knn(queries, corpus, 3).select("qid", "vec_id", "score", "local_rank").collect())
