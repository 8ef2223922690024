"""The router network: gradient against finite differences, training jobs against a plain loop, quality on test pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.functions import mlp
from fedsearch.functions.vectors import dot
from fedsearch.operators import metrics as M
from fedsearch.operators import router_training as R
from fedsearch.plans import fixtures as fx
from fedsearch.plans import q_learned as Q


def block(n=7, width=5, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)), (rng.random(n) < 0.4).astype(float), rng.integers(-2**60, 2**60, n)


@pytest.mark.parametrize("rate", [0.0, 0.4])
def test_gradient_equals_finite_differences(rate):
    x, y, keys = block()
    hidden = (6, 4)
    v = mlp.flat(mlp.initial(x.shape[1], hidden, 3))

    def loss(params):
        return mlp.loss_and_gradient(x, y, keys, mlp.unflat(params, x.shape[1], hidden), pos_weight=2.5, rate=rate, epoch=4)

    got = mlp.flat(loss(v)[1])
    for i in range(v.size):
        step = np.zeros_like(v)
        step[i] = 1e-6
        want = (loss(v + step)[0] - loss(v - step)[0]) / 2e-6
        assert abs(got[i] - want) < 1e-4 * max(1.0, abs(want)), (i, got[i], want)


def test_masks_depend_on_the_row_alone():
    keys = np.arange(-500, 500)
    whole = mlp.keep_mask(keys, 64, 1, 2, 3, 0.4)
    assert np.array_equal(whole[::-1], mlp.keep_mask(keys[::-1].copy(), 64, 1, 2, 3, 0.4))
    assert abs((whole == 0).mean() - 0.4) < 0.01 and not np.array_equal(whole, mlp.keep_mask(keys, 64, 1, 3, 3, 0.4))


def test_schedules():
    assert [round(mlp.cyclic_rate(s), 6) for s in (0, 10, 20, 30, 40)] == [1e-3, 5e-3, 1e-3, 3e-3, 1e-3]
    assert mlp.stepped_rate(49) == 1e-3 and mlp.stepped_rate(50) == pytest.approx(5e-5)


def made(spark, n, width=4, parts=5):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] * x[:, 1] > 0.3).astype(int)
    split = np.where(np.arange(n) % 5 == 0, "val", "train")
    rows = [(int(i), 0, int(y[i]), str(split[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "qid long, source_id int, label int, split string, scaled array<double>").repartition(parts)


def test_training_equals_a_plain_loop(spark):
    df = made(spark, 300)
    rows = df.withColumn("key", F.xxhash64("qid", "source_id")).orderBy("qid").collect()
    got = R.train_router(df, hidden=(8, 4), epochs=6, block_rows=16)
    x, y = np.array([r.scaled for r in rows]), np.array([float(r.label) for r in rows])
    keys, train = np.array([r.key for r in rows]), np.array([r.split == "train" for r in rows])
    weight = (y[train] == 0).sum() / (y[train] == 1).sum()
    v = mlp.flat(mlp.initial(4, (8, 4), 0))
    adam = mlp.Adam(v.size)
    want = []
    for epoch in range(6):
        w = mlp.unflat(v, 4, (8, 4))
        z = mlp.logits(x[~train], w)[0]
        want.append((mlp.row_losses(z, y[~train], weight).mean(), ((z > 0) == (y[~train] == 1)).mean(), v))
        _, g = mlp.loss_and_gradient(x[train], y[train], keys[train], w, pos_weight=weight, epoch=epoch)
        v = adam.step(v, mlp.clipped(mlp.flat(g) / train.sum(), R.MAX_NORM), R.learning_rate(epoch, epoch, 6))
    assert [h[2] for h in got.history] == pytest.approx([w[0] for w in want])
    assert [h[7] for h in got.history] == pytest.approx([w[1] for w in want])
    best = min(range(6), key=lambda e: (want[e][0], e))
    assert got.best_epoch == best and np.allclose(mlp.flat(got.weights), want[best][2])
    kept = M.best_epoch(got.history_frame(spark).withColumn("run", F.lit(1)), ["run"]).first()
    assert kept.best_epoch == best


def test_batches_learn_and_cover_all_rows(spark):
    df = made(spark, 600)
    r = R.train_router(df, hidden=(16, 8), epochs=12, batches=4, dropout=0.0)
    assert r.history[-1][2] < 0.8 * r.history[0][2]
    keys = np.random.default_rng(0).integers(-2**62, 2**62, 1000)
    assert set(R._batch_of(keys, 3, 4)) == {0, 1, 2, 3}


def test_saved_weights_score_alike(spark, tmp_path):
    df = made(spark, 60)
    r = R.train_router(df, hidden=(8, 4), epochs=2)
    r.save(spark, f"file://{tmp_path}/r")
    w = R.load_weights(spark, f"file://{tmp_path}/r")
    assert all(np.array_equal(w[n], r.weights[n]) for n in r.weights)
    rows = R.predict_router(w, df).collect()
    z = mlp.logits(np.array([x.scaled for x in rows]), r.weights)[0]
    assert np.allclose([x.prob for x in rows], 1 / (1 + np.exp(-z)))


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        R.train_router(made(spark, 60).where("false"))


@pytest.mark.parametrize("folder", [SF01, "/root/testdata/sf0.1"])
def test_learned_router_reaches_the_dot_score(spark, folder):
    test = Q.learned_route(spark, folder)
    auc = M.roc_auc(test).first().auc
    pairs = fx.examples(spark, folder).where("split = 'test'").select("label", dot("qv", "centroid").alias("prob"))
    assert auc >= M.roc_auc(pairs).first().auc - 5e-4
    history = Q.router_history(spark, folder).collect()
    assert len(history) == R.EPOCHS and sum(h.kept for h in history) == 1
    assert min(history, key=lambda h: (h.val_loss, h.epoch)).kept
    by_bank = Q.router_by_bank(spark, folder).collect()
    assert len(by_bank) == 4 and sum(b.tp + b.fn for b in by_bank) == test.where("label = 1").count()
    routed = test.where("routed").select("qid", "source_id").distinct()
    hits = Q.learned_route_topk(spark, folder)
    assert hits.join(routed, ["qid", "source_id"], "left_anti").count() == 0 and hits.where("rank > 10").count() == 0


def test_time_per_row_stays_flat(spark):
    """Twice the rows take at most about twice the time (jobs have a fixed part)."""
    took = {}
    for n in (4_000, 8_000):
        df = made(spark, n, 64, 4)
        t0 = time.perf_counter()
        R.train_router(df, epochs=3)
        took[n] = time.perf_counter() - t0
    assert took[8_000] < 2.5 * took[4_000]


def test_rows_that_come_in_one_partition_are_trained_on_by_many_tasks(spark):
    blocks = R.pack_blocks(made(spark, 6_000, parts=1))
    assert blocks.groupBy(F.input_file_name()).count().count() >= min(8, spark.sparkContext.defaultParallelism)
    assert blocks.agg(F.sum("n")).first()[0] == 6_000
