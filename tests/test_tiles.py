"""Stored tiles: the same rows as the plain search, tiles left out, vectors added while a stream runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsearch.operators import retrieve as K
from fedsearch.operators import tiles as T
from fedsearch.streaming import gather as S

SCHEMA = "source_id int, vec_id long, v array<double>"


def clustered(n_clusters=12, per=150, width=8, seed=0):
    """Tight clusters far apart, over three sources; some vectors twice."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, width)) * 5
    rows, i = [], 0
    for c in range(n_clusters):
        for x in centres[c] + rng.normal(size=(per, width)) * 0.05:
            for _ in range(1 + (i % 7 == 0)):
                rows.append((c % 3, i, x.tolist()))
                i += 1
    return rows, centres


def plain(rows, queries, k):
    ids, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for qid, q in queries:
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += x[:, d] * q[d]
        order = np.lexsort((ids, -s))[:k]
        out += [(qid, int(ids[o]), r + 1) for r, o in enumerate(order)]
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, centres = clustered()
    path = f"file://{tmp_path_factory.mktemp('tiles')}/t"
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    T.add_vectors(df.where("vec_id % 2 = 0"), path, tile_rows=20, pivots=30)
    T.add_vectors(df.where("vec_id % 2 = 1"), path, tile_rows=20, pivots=30)
    rng = np.random.default_rng(3)
    queries = [(i, (centres[i % len(centres)] + rng.normal(size=centres.shape[1]) * 0.1).tolist()) for i in range(40)]
    return rows, path, queries, spark.createDataFrame(queries, "qid long, qv array<double>")


def test_tiles_hold_every_vector_in_its_ball(spark, made):
    rows, path, _, _ = made
    seen = []
    tiles = T.read_tiles(spark, path).collect()
    for t in tiles:
        x, c = K._matrix(t.data, t.width), np.frombuffer(t.centre)
        assert t.n == len(x) <= 20 and np.sqrt(((x - c) ** 2).sum(axis=1)).max() <= t.radius * (1 + 1e-12)
        seen += [(t.source_id, int(i), tuple(v)) for i, v in zip(np.frombuffer(t["keys"], "<i8"), x)]
    assert sorted(seen) == sorted((s, i, tuple(v)) for s, i, v in rows)
    assert len({t.tile for t in tiles}) == len(tiles)


@pytest.mark.parametrize("k", [1, 10, 45])
def test_pruned_search_is_exact_and_skips_tiles(spark, made, k):
    rows, path, queries, q = made
    tiles = T.read_tiles(spark, path)
    got = sorted((r.qid, r.vec_id, r["rank"]) for r in T.knn_pruned(q, tiles, k).collect())
    assert got == plain(rows, queries, k)
    _, further = T.pruned_visits(q, tiles, k)
    n, every = further.count(), tiles.count() * len(queries)
    assert n < 0.25 * every, (n, every)


def test_many_packs_and_more_hits_than_vectors(spark, made, monkeypatch):
    rows, path, queries, q = made
    monkeypatch.setattr(T, "PACK_BALLS", 7)
    tiles = T.read_tiles(spark, path)
    got = sorted((r.qid, r.vec_id, r["rank"]) for r in T.knn_pruned(q, tiles, 5).collect())
    assert got == plain(rows, queries, 5)
    few = spark.createDataFrame(queries[:2], "qid long, qv array<double>")
    assert T.knn_pruned(few, tiles, 10_000).count() == 2 * len(rows)
    assert T.knn_pruned(few.limit(0), tiles, 5).count() == 0


def test_a_vector_added_between_batches_is_found(spark, tmp_path):
    path, src = f"file://{tmp_path}/t", f"{tmp_path}/in"
    T.add_vectors(spark.createDataFrame([(0, i, [0.1, 0.0]) for i in range(5)], SCHEMA), path)
    queries = "qid long, qv array<double>, source_id int"

    def ask(qid):
        spark.createDataFrame([(qid, [1.0, 1.0], 0)], queries).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(queries).parquet(src)
        return S.retrieve_stream(stream, path, 1, f"{tmp_path}/hits", f"{tmp_path}/check").where(F.col("qid") == qid).collect()

    assert [r.vec_id for r in ask(1)] == [0]
    T.add_vectors(spark.createDataFrame([(0, 99, [5.0, 5.0])], SCHEMA), path)
    assert [r.vec_id for r in ask(2)] == [99]


def test_a_batch_packs_no_corpus(spark, made):
    _, path, _, q = made
    plan = K.knn_tiles(q.withColumn("source_id", F.lit(0)), T.read_tiles(spark, path), 3)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "Scan parquet" in x)
    assert "keys" in scan and "centre" not in scan
    assert plan.count("MapInArrow") == 2  # the queries' blocks and the scores


def test_rows_do_not_grow_with_queries_times_tiles(spark, tmp_path, monkeypatch):
    """Vectors without clusters: most tiles must be searched, yet no row stands for a query and a further tile."""
    rng = np.random.default_rng(5)
    rows = [(i % 3, i, x.tolist()) for i, x in enumerate(rng.normal(size=(900, 16)))]
    queries = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 16)))]
    path = f"file://{tmp_path}/t"
    T.add_vectors(spark.createDataFrame(rows, SCHEMA), path, tile_rows=10, pivots=20)
    tiles, q = T.read_tiles(spark, path), spark.createDataFrame(queries, "qid long, qv array<double>")
    seen, visit = [], T._visit

    def counted(visits, *rest):
        seen.append(visits.count())
        return visit(visits, *rest)

    monkeypatch.setattr(T, "_visit", counted)
    monkeypatch.setattr(T, "SLAB_QUERIES", 7)
    got = sorted((r.qid, r.vec_id, r["rank"]) for r in T.knn_pruned(q, tiles, 4).collect())
    assert got == plain(rows, queries, 4)
    assert 0 < sum(seen) <= 4 * len(queries) < 0.1 * tiles.count() * len(queries), seen


def test_query_ids_that_repeat_are_one_query(spark, made):
    """Rows of equal id and vector rank together: the best vectors, each several times."""
    rows, path, queries, _ = made
    asked = [(1, queries[0][1]), (1, queries[0][1])]
    found = T.knn_pruned(spark.createDataFrame(asked, "qid long, qv array<double>"), T.read_tiles(spark, path), 6).collect()
    assert {r.qid for r in found} == {1} and len(found) == 6
    got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"])]
    best = [v for _, v, _ in sorted(plain(rows, queries[:1], 6), key=lambda x: x[2])]
    assert list(dict.fromkeys(got)) == best[:len(set(got))] and len(set(got)) < 6
