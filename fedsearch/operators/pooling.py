"""Masked pooling of ordered token vectors into one vector per group (survey G15, M6).

tokens (group..., pos INT, mask INT, vec ARRAY<DOUBLE>) -> (group..., dim, value)

Whole vectors are summed (or their maxima taken) per task and merged, so a
long sequence is pooled by many tasks and one vector per group leaves each;
only the pooled vector is exploded to (dim, value) rows, which ``pack`` turns
back into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("cls", "max", "mean", "mean_sqrt", "weighted", "last")
MASKED_MAX = -1e9      # value a masked position takes in max pooling
MIN_DENOMINATOR = 1e-9  # floor for a mask sum
RUN = 4_096             # positions that one call of a pooling of one's own sees


def _cells(tokens: DataFrame, by: list[str]) -> DataFrame:
    return tokens.select(*by, "pos", "mask", F.posexplode("vec").alias("dim", "x"))


def pool(tokens: DataFrame, by: list[str], mode: str) -> DataFrame:
    """One pooled value per (group, dim) in the given mode."""
    if mode not in MODES:
        raise ValueError(f"unknown pooling mode {mode!r}")
    # cls and last pool one position of a group: its vector is chosen whole and exploded afterwards
    if mode == "cls":
        # first position, whatever its mask; one vector per group leaves a task
        first = tokens.groupBy(*by).agg(F.min_by("vec", "pos").alias("vec"))
        return first.select(*by, F.posexplode("vec").alias("dim", "value"))
    if mode == "last":
        # the position before the first masked one; with no masked position
        # that index is -1, clamped to 0, i.e. the first token
        first_zero = F.min(F.when(F.col("mask") == 0, F.col("pos")))
        chosen = tokens.groupBy(*by).agg(F.greatest(F.coalesce(first_zero, F.lit(0)) - 1, F.lit(0)).alias("pos"))
        return _cells(tokens.join(chosen, [*by, "pos"], "left_semi"), by).select(
            *by, "dim", (F.col("x") * F.col("mask").cast("double")).alias("value"))
    m = F.col("mask").cast("double")
    if mode == "max":
        shown = F.transform("vec", lambda x: F.when(F.col("mask") > 0, x).otherwise(F.lit(MASKED_MAX)))
        return _pooled(tokens, by, shown, "max", F.lit(0.0), lambda x, _: x)
    weight = m * (F.col("pos") + 1).cast("double") if mode == "weighted" else m
    den = F.greatest(F.col("_w"), F.lit(MIN_DENOMINATOR))
    den = F.sqrt(den) if mode == "mean_sqrt" else den
    return _pooled(tokens, by, F.transform("vec", lambda x: x * weight), "sum", weight, lambda x, _: x / den)


def _pooled(tokens: DataFrame, by: list[str], vec: Column, metric: str, weight: Column, finish) -> DataFrame:
    """Element-wise ``metric`` of ``vec`` per group, with ``_w`` the sum of ``weight``; a row per element."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    rows = tokens.select(*by, array_to_vector(vec).alias("_x"), weight.alias("_m"))
    merged = rows.groupBy(*by).agg(getattr(Summarizer, metric)(F.col("_x")).alias("_s"), F.sum("_m").alias("_w"))
    return merged.select(*by, F.posexplode(F.transform(vector_to_array("_s"), finish)).alias("dim", "value"))


def pool_with(tokens: DataFrame, by: list[str], partial, merge, finish) -> DataFrame:
    """A pooling of one's own (M6): ``(group..., vec)``.

    ``partial(pos, mask, vecs)`` turns the tokens of a group that a task has
    at hand (arrays in no particular order) into a state, a flat array of
    numbers; ``merge(states)`` turns a matrix of states into one, ``finish(state)``
    the last one into the pooled vector. Groups are cut into runs of
    positions first, so one of any length is many tasks.
    """
    import numpy as np
    import pyarrow as pa

    fields = tokens.select(*by).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def vectors(column) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def row(table: pa.Table, values) -> pa.Table:
        out = table.select(by).slice(0, 1)
        return out.append_column("vec", pa.array([np.asarray(values, float)], pa.list_(pa.float64())))

    def first(table: pa.Table) -> pa.Table:
        return row(table, partial(table["pos"].to_numpy(), table["mask"].to_numpy(), vectors(table["vec"])))

    def last(table: pa.Table) -> pa.Table:
        return row(table, finish(merge(vectors(table["vec"]))))

    runs = tokens.select(*by, "pos", "mask", F.col("vec").cast("array<double>").alias("vec"), F.floor(F.col("pos") / RUN).alias("_run"))
    states = runs.groupBy(*by, "_run").applyInArrow(lambda t: first(t), f"{schema}, vec array<double>")
    return states.groupBy(*by).applyInArrow(last, f"{schema}, vec array<double>")


def pool_many(tokens: DataFrame, by: list[str], modes: list[str]) -> DataFrame:
    """Concatenate several poolings: dims of mode i are offset by i * width."""
    width = tokens.select(F.max(F.size("vec")).alias("w")).scalar()
    out = None
    for i, mode in enumerate(modes):
        p = pool(tokens, by, mode).withColumn("dim", F.col("dim") + F.lit(i) * width)
        out = p if out is None else out.unionByName(p)
    return out


def pack(pooled: DataFrame, by: list[str]) -> DataFrame:
    """(group..., dim, value) -> (group..., vec ARRAY<DOUBLE>) in dim order."""
    return (pooled.groupBy(*by)
                  .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_v"))
                  .select(*by, F.transform("_v", lambda s: s["value"]).alias("vec")))
