"""Catalogue: the learned router end to end (N1-N5, G20, F3 'learned'). Rows-only:
network training is iterative, so no SQL oracle states it. (The router's forward
pass with given weights, the threshold rule and the predictions file have
oracles of their own: ``score_route``, ``youden_threshold``, ``predictions``;
``tests/test_router_training.py`` holds the gradient, the history and the test
AUC against independent computations.)"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.functions.text import join_sources
from fedsearch.functions.vectors import dot
from fedsearch.operators import metrics as M
from fedsearch.operators import retrieve
from fedsearch.operators import router_training as R
from fedsearch.operators import train as T
from fedsearch.operators.rerank import merge_desc
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query
from fedsearch.session import scratch_path, store

_TRAINED: dict[tuple, str] = {}


def learned_examples(spark, d) -> DataFrame:
    """Every pair with two features, scaled with the train split: the query's dot with the source's centroid, and
    how far it lies above the mean of the query's dots with all sources.

    The query, the centroid and the one-hot source as they are (C3) let the
    network learn the few train queries by heart: its test AUC is then that of
    chance; README has the figures.
    """
    every = Window.partitionBy("qid")  # one row per source
    pairs = fx.examples(spark, d).select("qid", "source_id", "label", "split", dot("qv", "centroid").alias("near"))
    ex = pairs.withColumn("features", F.array("near", F.col("near") - F.avg("near").over(every)))
    ex = store(ex.drop("near"), "router-features")
    return store(T.scale_features(ex, T.fit_scaler(ex)).drop("features"), "router-examples")


def trained(spark, d) -> str:
    """The training step, run once per application and folder: fits the network, tunes its threshold on validation
    (Youden) and stores weights, history, threshold and the scored examples; returns their folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        root = scratch_path(spark, "router")
        ex = learned_examples(spark, d)
        router = R.train_router(ex)
        router.save(spark, root)
        R.predict_router(R.load_weights(spark, root), ex).drop("scaled").write.parquet(os.path.join(root, "scored"))
        M.youden_threshold(scored(spark, root).where("split = 'val'")).select("threshold").write.parquet(f"{root}/threshold")
        _TRAINED[key] = root
    return _TRAINED[key]


def scored(spark, root: str) -> DataFrame:
    """``qid, source_id, label, split, prob`` of every pair."""
    return spark.read.parquet(f"{root}/scored")


def routed(spark, d) -> DataFrame:
    """Test pairs with probability and the tuned ``threshold``."""
    root = trained(spark, d)
    return scored(spark, root).where("split = 'test'").withColumn("threshold", spark.read.parquet(f"{root}/threshold").scalar())


@query("learned_route")
def learned_route(spark, d):
    """Router probability and decision for every test pair."""
    return routed(spark, d).select("qid", "source_id", "label", F.round("prob", 6).alias("prob"),
                                   (F.col("prob") > F.col("threshold")).alias("routed"))


@query("predict_sources")
def predict_sources(spark, d):
    """Per test query: the sources the learned router would search."""
    s = routed(spark, d).where(F.col("prob") > F.col("threshold"))
    return s.groupBy("qid").agg(join_sources(F.collect_list(F.col("source_id").cast("string"))).alias("sources"),
                                F.count(F.lit(1)).alias("n_sources"))


@query("router_history")
def router_history(spark, d):
    """Losses, counts and metric of every epoch of the training run, the kept epoch marked."""
    h = spark.read.parquet(f"{trained(spark, d)}/history").withColumn("run", F.lit("router"))
    best = M.best_epoch(h, ["run"])
    return h.join(best, "run").select(
        "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"),
        "tp", "fp", "tn", "fn", "accuracy", "f1", (F.col("epoch") == F.col("best_epoch")).alias("kept"))


@query("router_by_bank")
def router_by_bank(spark, d):
    """Confusion, rates, AUC and saved requests of the fitted router on the test pairs of each bank."""
    s = routed(spark, d).withColumn("bank", F.floor(F.col("qid") / 10) % 4)
    yes = s.withColumn("over", (F.col("prob") > F.col("threshold")).cast("double"))
    b = M.binary_metrics(M.confusion(yes, 0.5, ["bank"], prob="over"))
    saved = M.route_reduction(yes, 0.5, prob="over", by=["bank"])
    return (b.join(M.roc_auc(s, ["bank"]), "bank").join(saved, "bank")
            .select("bank", "pairs", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in (
                "accuracy", "precision", "recall", "f1", "auc", "reduction", "best_reduction")]))


@query("learned_route_topk")
def learned_route_topk(spark, d):
    """Test queries searched in the sources that the router picks, merged to ten (F3 'learned', H1, H2)."""
    picked = routed(spark, d).where(F.col("prob") > F.col("threshold")).select("qid", "source_id")
    pairs = picked.join(fx.queries(spark, d).select("qid", "qv"), "qid")
    hits = retrieve.knn_arrow(pairs, fx.corpus(spark, d), fx.HITS_K)
    return merge_desc(hits, 10).select("qid", "source_id", "vec_id", F.round("score", 6).alias("score"), "rank")
