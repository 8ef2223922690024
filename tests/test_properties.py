"""Properties of the operators on small generated inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fedsearch.operators import metrics as M
from fedsearch.operators import retrieve, routing
from fedsearch.operators.positions import global_position, group_position, prefix_sums
from fedsearch.operators.train import group_split
from fedsearch.operators.workflow import assign_shard

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _vectors(spark, n, dim, seed, id_col="vec_id", vec_col="v", sources=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(i % sources), [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{id_col} bigint, source_id int, {vec_col} array<double>")


def test_knn_tiers_agree_and_routed_subset_of_all(spark):
    corpus = _vectors(spark, 300, 16, 1)
    q = _vectors(spark, 12, 16, 2, "qid", "qv").drop("source_id")
    sources = spark.createDataFrame([(i,) for i in range(4)], "source_id int")
    every = routing.route_all(q, sources)
    t1 = retrieve.knn(every, corpus, 5).select("qid", "source_id", "vec_id", "local_rank")
    t2 = retrieve.knn_arrow(every, corpus, 5, tile_rows=17, block_queries=5).select("qid", "source_id", "vec_id", "local_rank")
    assert sorted(t1.collect()) == sorted(t2.collect())
    routed = routing.route_by_rule(q, 4, lambda a, s: (a + s) % 2 == 0)
    r = retrieve.knn(routed, corpus, 5).select("qid", "vec_id")
    assert r.subtract(t1.select("qid", "vec_id")).count() == 0


def test_all_routing_then_merge_equals_global_topk(spark):
    corpus = _vectors(spark, 200, 8, 3)
    q = _vectors(spark, 10, 8, 4, "qid", "qv").drop("source_id")
    sources = spark.createDataFrame([(i,) for i in range(4)], "source_id int")
    g = retrieve.knn_global(q, corpus, sources, 7).select("qid", "vec_id", "rank").toPandas()
    qp, cp = q.toPandas(), corpus.toPandas()
    for _, row in qp.iterrows():
        s = np.array([np.dot(row.qv, v) for v in cp.v])
        order = sorted(range(len(s)), key=lambda i: (-s[i], cp.vec_id[i]))[:7]
        got = g[g.qid == row.qid].sort_values("rank").vec_id.tolist()
        assert got == [int(cp.vec_id[i]) for i in order]


def test_topk_prefix_stable(spark):
    corpus = _vectors(spark, 150, 8, 5)
    q = _vectors(spark, 6, 8, 6, "qid", "qv").drop("source_id")
    sources = spark.createDataFrame([(i,) for i in range(4)], "source_id int")
    h = retrieve.knn(routing.route_all(q, sources), corpus, 10)
    a = retrieve.merge_topk(h, 3).select("qid", "vec_id", "rank")
    b = retrieve.merge_topk(h, 8).where("rank <= 3").select("qid", "vec_id", "rank")
    assert sorted(a.collect()) == sorted(b.collect())


@SETTINGS
@given(n=st.integers(1, 60), parts=st.integers(1, 7))
def test_global_position_is_dense_and_ordered(spark, n, parts):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(n)], "id bigint, k bigint")
    p = global_position(df, [F.col("k"), F.col("id")], "pos", num_partitions=parts).toPandas()
    exp = sorted(range(n), key=lambda i: ((i * 37) % 11, i))
    assert p.sort_values("pos").id.tolist() == exp
    assert p.pos.tolist() and sorted(p.pos) == list(range(1, n + 1))


@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_prefix_sums_match_pandas(spark, vals):
    rows = [(g, o, c, i) for i, (g, o, c) in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, o int, c bigint, i int")
    got = prefix_sums(df, ["g"], [F.col("o"), F.col("i")], ["c"], num_partitions=3).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "o", "c", "i"]).sort_values(["g", "o", "i"])
    pdf["cum"] = pdf.groupby("g").c.cumsum()
    m = got.merge(pdf, on=["g", "o", "i"])
    assert (m.cum_c == m.cum).all() and len(m) == len(rows)


@SETTINGS
@given(x=st.lists(st.floats(-50, 50, allow_nan=False), min_size=1, max_size=50))
def test_exact_quantiles_match_numpy(spark, x):
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    q = M.exact_quantiles(df, ["g"], "x").toPandas().sort_values("p")
    assert np.allclose(q.q.values, np.percentile(np.array(x), [25, 50, 75]), rtol=1e-9, atol=1e-9)


def test_exact_quantiles_of_large_groups(spark):
    """Groups above and below the size that the sketch serves, with ties, a hot value and nulls."""
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=30_000), "b": np.repeat([1.0, 2.0, 7.0], 4_000), "c": rng.exponential(size=2_001).round(2),
              "d": rng.normal(size=1_999), "e": np.concatenate([np.zeros(9_000), rng.normal(size=3_000)]), "f": np.array([4.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(9)
    got = M.exact_quantiles(df, ["g"], "x", (0.0, 0.25, 0.5, 0.999, 1.0)).toPandas()
    for g, xs in groups.items():
        mine = got[got.g == g].sort_values("p").q.to_numpy()
        assert np.allclose(mine, np.percentile(xs, [0, 25, 50, 99.9, 100]), rtol=1e-12), g


def test_auc_invariant_to_monotone_maps_and_matches_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, prob double, label int")
    a1 = M.roc_auc(df).first().auc
    a2 = M.roc_auc(df.withColumn("prob", F.col("prob") * 3 + 1)).first().auc
    pos = [p for _, p, y in rows if y == 1]
    neg = [p for _, p, y in rows if y == 0]
    ref = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a1 - a2) < 1e-12 and abs(a1 - ref) < 1e-12


def test_reduction_plus_positive_rate_is_one(spark):
    df = spark.createDataFrame([(0.1 * i, i % 3 == 0) for i in range(10)], "prob double, y boolean") \
        .withColumn("label", F.col("y").cast("int"))
    r = M.route_reduction(df, 0.5).first()
    pos_rate = df.where("prob > 0.5").count() / df.count()
    assert abs(r.reduction + pos_rate - 1) < 1e-12


@SETTINGS
@given(n=st.integers(1, 80))
def test_split_disjoint_complete_exact_sizes(spark, n):
    ids = spark.createDataFrame([(i,) for i in range(n)], "qid bigint")
    s = group_split(ids, [(F.col("qid") * 7919) % 1009, F.col("qid")], 0.6, 0.1).toPandas()
    assert sorted(s.qid) == list(range(n))
    n_test = int(np.ceil(0.6 * n))
    assert (s.split == "test").sum() == n_test
    assert (s.split == "val").sum() == int(np.ceil(0.1 * (n - n_test)))


@SETTINGS
@given(n=st.integers(1, 50), k=st.integers(1, 5))
def test_shards_partition_the_set(spark, n, k):
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "id bigint, pos bigint")
    s = assign_shard(df, k).toPandas()
    assert sorted(s.id) == list(range(n)) and set(s.shard) <= set(range(k))


def test_group_position_splits_a_hot_group(spark):
    rows = [(0 if i % 3 else 1, i) for i in range(300)]   # group 0 holds two thirds
    df = spark.createDataFrame(rows, "g int, i bigint")
    p = group_position(df, ["g"], [F.col("i")], "pos").toPandas()
    for g, part in p.groupby("g"):
        assert part.sort_values("i").pos.tolist() == list(range(1, len(part) + 1))


def test_mlp_router_hook_matches_numpy(spark):
    from fedsearch.functions.hooks import mlp_router_scores
    rng = np.random.default_rng(0)
    d = 6
    w = {"fc1.w": rng.normal(size=(256, d)), "fc1.b": rng.normal(size=256),
         "ln1.g": rng.normal(size=256), "ln1.b": rng.normal(size=256),
         "fc2.w": rng.normal(size=(128, 256)), "fc2.b": rng.normal(size=128),
         "ln2.g": rng.normal(size=128), "ln2.b": rng.normal(size=128),
         "fc3.w": rng.normal(size=(1, 128)), "fc3.b": rng.normal(size=1)}
    x = rng.normal(size=(5, d))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, f array<double>")
    got = [r.p for r in df.select("i", mlp_router_scores(w)("f").alias("p")).orderBy("i").collect()]

    def ln(h, g, b):
        return (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * g + b
    h = np.maximum(ln(x @ w["fc1.w"].T + w["fc1.b"], w["ln1.g"], w["ln1.b"]), 0)
    h = np.maximum(ln(h @ w["fc2.w"].T + w["fc2.b"], w["ln2.g"], w["ln2.b"]), 0)
    ref = 1 / (1 + np.exp(-(h @ w["fc3.w"].T + w["fc3.b"]).ravel()))
    assert np.allclose(got, ref)


def test_answer_hook(spark):
    from fedsearch.functions.hooks import answer_with
    df = spark.createDataFrame([(1, "x"), (2, "y")], "qid bigint, user string")
    out = {r.qid: r.answer for r in answer_with(df, lambda ps: [p.upper() for p in ps]).collect()}
    assert out == {1: "X", 2: "Y"}


def test_hashed_bow_vectors_unit_and_deterministic(spark):
    from fedsearch.functions.hooks import hashed_bow_vectors
    df = spark.createDataFrame([(1, "Le chat, le CHAT!"), (2, ""), (3, "chat le le chat")], "id bigint, t string")
    v = {r.id: r.v for r in hashed_bow_vectors(df, ["id"], "t", 16).collect()}
    assert len(v[1]) == 16 and abs(sum(x * x for x in v[1]) - 1) < 1e-12
    assert v[1] == v[3] and all(x == 0 for x in v[2])


def test_tiles_of_any_size_agree_with_ties(spark):
    """Equal vectors tie exactly; ties end in the lower id in both tiers."""
    corpus = _vectors(spark, 60, 8, 11)
    twice = corpus.unionByName(corpus.withColumn("vec_id", F.col("vec_id") + 1000))
    q = _vectors(spark, 9, 8, 12, "qid", "qv").drop("source_id")
    routed = routing.route_by_rule(q, 4, lambda a, s: (a + s) % 2 == 1)
    cols = ["qid", "source_id", "vec_id", "local_rank", "score"]
    for fn, higher in (("dot", True), ("cos_sim", True), ("dot", False)):
        want = sorted(retrieve.knn(routed, twice, 5, fn, higher).select(*cols).collect())
        for tile, block in ((1, 1), (7, 3), (2048, 256)):
            got = retrieve.knn_arrow(routed, twice, 5, fn, higher, tile, block).select(*cols).collect()
            assert sorted(got) == want


def test_tiles_are_packed_where_vectors_are_read(spark):
    from conftest import SF01
    from fedsearch.plans import fixtures as fx
    tiles = retrieve.pack_vectors(fx.corpus(spark, SF01), "vec_id", "v", 2048)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan
    joined = retrieve.knn_arrow(fx.routed(spark, SF01), fx.corpus(spark, SF01), 5)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("rows,parts", [(20_000, 8), (1_000_000, 8), (1_000_000, 200)])
def test_positions_are_dense_at_size_with_payload(spark, rows, parts):
    df = spark.range(rows, numPartitions=13).select(
        ((F.col("id") * 7919) % rows).alias("k"), (F.col("id") % 3).alias("g"), F.repeat(F.lit("x"), 20).alias("payload"))
    p = global_position(df, [F.col("k")], num_partitions=parts)
    r = p.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"),
              F.count_if(F.col("pos") != F.col("k") + 1).alias("wrong")).first()
    assert (r.n, r.d, r.a, r.b, r.wrong) == (rows, rows, 1, rows, 0)
    g = group_position(df, ["g"], [F.col("k")], "pos").groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert all(x.n == x.d == x.b and x.a == 1 for x in g)
    s = prefix_sums(df.withColumn("one", F.lit(1)), [], [F.col("k")], ["one"], parts)
    assert s.where(F.col("cum_one") != F.col("k") + 1).count() == 0


def test_split_sizes_are_exact_with_payload(spark):
    df = spark.range(100_000).select(F.col("id"), (F.col("id") % 2).alias("bank"), F.repeat(F.lit("t"), 30).alias("text"))
    got = {r.split: r["count"] for r in group_split(df, [(F.col("id") * 7919) % 100_003, F.col("id")], 0.6, 0.1)
           .groupBy("split").count().collect()}
    assert got == {"test": 60_000, "val": 4_000, "train": 36_000}


def test_content_id(spark):
    from fedsearch.functions.text import content_id
    ids = spark.createDataFrame([("q", "x"), ("q", "x"), ("q", None)], "a string, b string") \
        .select(content_id("a", "b").alias("i")).collect()
    assert ids[0].i == ids[1].i != ids[2].i and len(ids[0].i) == 64


def test_own_pooling_over_runs(spark, monkeypatch):
    """A pooling of one's own, here the mean of the unmasked tokens, equals the built-in one at any cut."""
    from fedsearch.operators import pooling as P
    rng = np.random.default_rng(2)
    rows = [(g, p, int(rng.random() < 0.7), rng.normal(size=3).tolist()) for g in ("a", "b") for p in range(50)]
    df = spark.createDataFrame(rows, "g string, pos int, mask int, vec array<double>").repartition(4)

    def partial(pos, mask, vecs):
        return np.append((vecs * mask[:, None]).sum(axis=0), mask.sum())

    for run in (7, 4_096):
        monkeypatch.setattr(P, "RUN", run)
        own = {r.g: r.vec for r in P.pool_with(df, ["g"], partial, lambda s: s.sum(axis=0), lambda s: s[:-1] / max(s[-1], 1e-9)).collect()}
        want = {r.g: r.vec for r in P.pack(P.pool(df, ["g"], "mean"), ["g"]).collect()}
        assert all(np.allclose(own[g], want[g]) for g in ("a", "b"))


def test_models_are_loaded_only_where_a_source_uses_them(spark):
    from fedsearch.functions.hooks import encode_once_per_encoder, model_encoder
    q = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(99, None)], "qid long, text string")
    sources = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "source string, encoder string")

    def never():
        raise RuntimeError("loaded")

    def lengths(width):
        return lambda: lambda texts: np.array([[len(t)] * width for t in texts])

    encoders = {"one": model_encoder(lengths(2)), "two": model_encoder(lengths(3), batch_size=4), "three": model_encoder(never)}
    got = {(r.qid, r.encoder): r.qv for r in encode_once_per_encoder(q, sources, "text", encoders).collect()}
    assert len(got) == 42 and got[3, "one"] == [6.0, 6.0] and got[12, "two"] == [7.0] * 3 and got[99, "one"] == [0.0, 0.0]
    with pytest.raises(ValueError, match="no model"):
        encode_once_per_encoder(q, sources, "text", {"one": encoders["one"]})


def test_many_small_files_in_few_tasks(spark, tmp_path):
    from fedsearch.sources import readers as R
    from fedsearch.sources import sinks as S
    n = 2_000
    q = spark.range(n).select(F.col("id"), F.to_json(F.array(F.concat(F.lit("d"), "id"), F.lit("x"))).alias("docs"))
    root = f"file://{tmp_path}/hits"
    S.write_files(q.select(F.concat(F.lit("top_2_"), "id", F.lit("_texts.json")).alias("name"), F.col("docs").alias("content")), root)
    S.write_files(q.select(F.concat(F.lit("top_2_"), "id", F.lit("_scores.txt")).alias("name"), F.lit("0.5\n0.25\n").alias("content")), root)
    hits = R.read_cached_hits(spark, f"{root}/*_texts.json", f"{root}/*_scores.txt", 1)
    assert hits.where("doc = concat('d', query_id) and score = 0.5 and local_rank = 0").count() == n == hits.count()
    raw = R._small_files(spark.read.text(f"{root}/*_texts.json", wholetext=True))
    assert raw.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_files_are_named_with_their_file_system(spark, tmp_path):
    from fedsearch.session import open_filesystem, qualified
    assert qualified(spark, f"{tmp_path}/x").startswith("file:/")
    with pytest.raises(ValueError, match="name the file system"):
        open_filesystem("/tmp/x")
    with pytest.raises(Exception):
        open_filesystem("nosuch://a/b")
