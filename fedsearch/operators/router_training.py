"""Distributed training of the router network (survey N2, N5, G20, F3 'learned').

One epoch is ``batches`` Spark jobs. Each task runs the network forward and
back over its blocks of rows (``functions.mlp``) and hands on one partial
gradient in pieces; Spark adds the pieces up in two levels, and the driver,
which holds what is as large as the network and nothing else, takes an Adam
step. The same pass sums loss and confusion counts of the validation rows, so
every epoch leaves a row of history and the best one is kept.

Scale. Rows are packed once into blocks of ``block_rows`` (key, label, features
as bytes), dealt out over all cores and stored in the shared folder: a lost executor costs a re-read of its
blocks, and masks that depend on the row's key only make the recomputed
gradient the same. A block belongs to a task, never a key or a group. Weights
travel as a broadcast whose size the layer widths fix (0.4 to 2.1 million
numbers for the reference's inputs). Time is ``epochs x rows``; an epoch of
several batches takes as many steps over rows chosen by hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsearch.functions import mlp
from fedsearch.functions.hooks import mlp_router_scores
from fedsearch.operators.train import class_weights
from fedsearch.session import store

BLOCK_ROWS = 4_096
#: Rows of a training task: below the first, none is split further; above the second, there are more tasks than cores.
TASK_ROWS = (512, 65_536)
PIECE = 65_536
EPOCHS = 30
#: Epoch from which the stepped learning rate replaces the cyclic one (a fixed value, as a share of all epochs).
CYCLIC_SHARE = 115 / 150
MAX_NORM = 1.0
_STATS = ("loss", "n", "tp", "fp", "tn", "fn")
HISTORY = ("epoch int, train_loss double, val_loss double, tp long, fp long, tn long, fn long, "
           "accuracy double, f1 double, metric double")


@dataclass
class Router:
    """A trained network: ``weights`` of the best epoch, and the ``history`` of all."""

    weights: mlp.Weights
    history: list[tuple]
    best_epoch: int

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)  # a row per epoch

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights and history as Parquet, one row per parameter matrix."""
        rows = [(n, list(w.shape), w.ravel().tolist()) for n, w in self.weights.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").write.parquet(f"{path}/weights")
        self.history_frame(spark).write.parquet(f"{path}/history")


def load_weights(spark: SparkSession, path: str) -> mlp.Weights:
    """The weights that :meth:`Router.save` wrote: as many numbers as the network has."""
    return {r.name: np.array(r.cells).reshape(r.shape) for r in spark.read.parquet(f"{path}/weights").collect()}


def pack_blocks(examples: DataFrame, features: str = "scaled", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Train and validation rows as stored blocks ``split, n, keys, labels, cells``.

    Rows are dealt out by key: a small table that comes in few partitions would
    else be trained on by as few tasks. A block holds rows of one split.
    """
    rows = examples.where(F.col("split").isin("train", "val")).select(
        "split", F.xxhash64("qid", "source_id").alias("key"), F.col("label").cast("double").alias("label"),
        F.col(features).cast("array<double>").alias("x"))

    n = rows.count()
    parts = max(min(-(-n // TASK_ROWS[0]), rows.sparkSession.sparkContext.defaultParallelism), -(-n // TASK_ROWS[1]), 1)

    def pack(batches):
        held: dict[str, list] = {}

        def block(split, parts):
            keys, labels, cells = (np.concatenate(p) for p in zip(*parts))
            return pa.record_batch({"split": [split], "n": pa.array([len(keys)], pa.int32()), "keys": [keys.tobytes()],
                                    "labels": [labels.tobytes()], "cells": [cells.tobytes()]})

        for batch in batches:
            # at most `block_rows` rows at a time
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                splits = part.column("split").to_numpy(zero_copy_only=False)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                for split in np.unique(splits):
                    mine = splits == split
                    held.setdefault(split, []).append((part.column("key").to_numpy()[mine], part.column("label").to_numpy()[mine], x[mine]))
                    if sum(len(k) for k, _, _ in held[split]) >= block_rows:
                        yield block(split, held.pop(split))
        for split, parts in held.items():
            yield block(split, parts)

    return store(rows.repartition(parts, "key").mapInArrow(pack, "split string, n int, keys binary, labels binary, cells binary"), "router-blocks")


def _sums(blocks: DataFrame, weights, width: int, hidden: tuple[int, int], *, epoch: int, batch: int, batches: int,
          pos_weight: float, rate: float, seed: int) -> tuple[np.ndarray | None, dict[str, np.ndarray]]:
    """Gradient sum over the train rows of a batch, and sums of :data:`_STATS` for train and val rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def stats(z, y):
        yes, pos = z > 0, y == 1
        return np.array([mlp.row_losses(z, y, pos_weight).sum(), len(y), (yes & pos).sum(), (yes & ~pos).sum(),
                         (~yes & ~pos).sum(), (~yes & pos).sum()], dtype=float)

    def run(batch_iter):
        w = mlp.unflat(weights.value, width, hidden)
        total, seen = None, {"train": np.zeros(len(_STATS)), "val": np.zeros(len(_STATS))}
        for b in batch_iter:
            for split, keys, labels, cells in zip(*(b.column(c).to_pylist() for c in ("split", "keys", "labels", "cells"))):
                keys, y = np.frombuffer(keys, np.int64), np.frombuffer(labels)
                x = np.frombuffer(cells).reshape(len(y), width)
                if split == "val":
                    if batch == 0:
                        seen["val"] += stats(mlp.logits(x, w)[0], y)
                    continue
                if batches > 1:  # the rows of this step, by a hash that differs per epoch
                    mine = _batch_of(keys, epoch, batches) == batch
                    keys, y, x = keys[mine], y[mine], x[mine]
                    if not len(y):
                        continue
                loss, grad = mlp.loss_and_gradient(x, y, keys, w, pos_weight=pos_weight, rate=rate, epoch=epoch, seed=seed)
                seen["train"] += np.array([loss, len(y), 0, 0, 0, 0])
                total = mlp.flat(grad) if total is None else total + mlp.flat(grad)
        pieces = [(-1, seen["train"]), (-2, seen["val"])]
        if total is not None:
            pieces += [(at // PIECE, total[at:at + PIECE]) for at in range(0, len(total), PIECE)]
        yield pa.record_batch({"piece": pa.array([p for p, _ in pieces], pa.int32()), "cells": [c.tolist() for _, c in pieces]})

    parts = blocks.mapInArrow(run, "piece int, cells array<double>").select("piece", array_to_vector("cells").alias("v"))
    # two levels: no task adds up the pieces of all others
    some = parts.groupBy("piece", (F.spark_partition_id() % 32).alias("g")).agg(Summarizer.sum(F.col("v")).alias("v"))
    added = some.groupBy("piece").agg(Summarizer.sum(F.col("v")).alias("v")).select("piece", vector_to_array("v").alias("cells"))
    found = {r.piece: np.array(r.cells) for r in added.collect()}  # as many numbers as the network has
    gradient = [found[p] for p in sorted(p for p in found if p >= 0)]
    none = np.zeros(len(_STATS))
    return (np.concatenate(gradient) if gradient else None), {"train": found.get(-1, none), "val": found.get(-2, none)}


def _batch_of(keys: np.ndarray, epoch: int, batches: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys.view(np.uint64) + np.uint64(epoch + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(batches)).astype(int)


def learning_rate(epoch: int, step: int, epochs: int) -> float:
    """Cyclic first, stepped at the end, as the reference's two schedules."""
    first = round(CYCLIC_SHARE * epochs)
    return mlp.cyclic_rate(step) if epoch < first else mlp.stepped_rate(epoch - first)


def train_router(examples: DataFrame, features: str = "scaled", *, hidden: tuple[int, int] = mlp.HIDDEN, epochs: int = EPOCHS,
                 batches: int = 1, dropout: float = mlp.DROPOUT, seed: int = 0, block_rows: int = BLOCK_ROWS,
                 schedule: Callable[[int, int, int], float] = learning_rate) -> Router:
    """Fit the network on the ``train`` rows of ``examples`` (``qid, source_id, label, split`` and features).

    Positives weigh negatives over positives. The epoch with the smallest
    validation loss is kept (``metric`` is its negative; the earliest wins
    ties); without validation rows, the one with the smallest training loss.
    """
    spark = examples.sparkSession
    blocks = pack_blocks(examples, features, block_rows)
    first = blocks.select("n", F.octet_length("cells").alias("b")).first()
    if first is None:
        raise ValueError("no rows to train on")
    width = first.b // 8 // first.n
    weight = class_weights(examples.where("split = 'train'")).first()["neg_over_pos"] or 1.0
    params = mlp.flat(mlp.initial(width, hidden, seed))
    adam, history, best = mlp.Adam(params.size), [], None
    for epoch in range(epochs):
        start, train = params, np.zeros(len(_STATS))
        for batch in range(batches):
            sent = spark.sparkContext.broadcast(params)
            gradient, sums = _sums(blocks, sent, width, hidden, epoch=epoch, batch=batch, batches=batches,
                                   pos_weight=weight, rate=dropout, seed=seed)
            sent.destroy()
            train += sums["train"]
            if batch == 0:
                val = sums["val"]
            if gradient is not None:
                mean = gradient / sums["train"][1]
                params = adam.step(params, mlp.clipped(mean, MAX_NORM), schedule(epoch, epoch * batches + batch, epochs))
        row = _history_row(epoch, train, val)
        history.append(row)
        if best is None or row[-1] > best[0]:
            best = (row[-1], epoch, start)
    return Router(mlp.unflat(best[2], width, hidden), history, best[1])


def _history_row(epoch: int, train: np.ndarray, val: np.ndarray) -> tuple:
    """Losses and validation counts of the weights that the epoch started from."""
    train_loss = float(train[0] / train[1]) if train[1] else None
    tp, fp, tn, fn = (int(x) for x in val[2:])
    n = int(val[1])
    val_loss = float(val[0] / n) if n else None
    metric = -val_loss if n else -(train_loss or 0.0)
    return (epoch, train_loss, val_loss, tp, fp, tn, fn, (tp + tn) / n if n else None,
            2 * tp / (2 * tp + fp + fn) if tp else 0.0, metric)


def predict_router(weights: mlp.Weights, examples: DataFrame, features: str = "scaled") -> DataFrame:
    """``examples`` with ``prob``: the network's probability that the source is needed."""
    return examples.withColumn("prob", mlp_router_scores(weights)(F.col(features)))
