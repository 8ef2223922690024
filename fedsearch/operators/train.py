"""Preparing router training (survey H8, G11, G12, C9).

examples (qid, source_id, features ARRAY<DOUBLE>, label INT, split STRING)
  -> fit_scaler on the train split only -> scale -> ``router_training``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.functions.vectors import apply_scaler
from fedsearch.operators.positions import global_position, group_position


def group_split(ids: DataFrame, order: list[Column], test_frac: float, val_frac: float,
                group_cols: list[str] | None = None) -> DataFrame:
    """Split whole queries: first ``ceil(test_frac*n)`` in ``order`` are test,
    the next ``ceil(val_frac*rest)`` validation, the rest train (H8).

    Positions come from a range-partitioned numbering, so a bank holding most
    queries is still split across tasks. Exact sizes, no sampling.
    """
    groups = group_cols or []
    if groups:
        p = group_position(ids, groups, order, "split_pos")
    else:
        # one group: the size is a scalar, no join on a constant key
        p = global_position(ids, order, "split_pos") \
            .withColumn("group_size", ids.agg(F.count(F.lit(1))).scalar())
    n = F.col("group_size")
    n_test = F.ceil(F.lit(test_frac) * n)
    n_val = F.ceil(F.lit(val_frac) * (n - n_test))
    out = p.withColumn("split", F.when(F.col("split_pos") <= n_test, "test")
                                  .when(F.col("split_pos") <= n_test + n_val, "val")
                                  .otherwise("train"))
    return out


def min_group_size(df: DataFrame, group_col: str, minimum: int) -> DataFrame:
    """Drop groups with fewer than ``minimum`` rows (E5)."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.join(sizes.select(group_col), group_col, "left_semi")


def fit_scaler(examples: DataFrame, features: str = "features", split_col: str = "split",
               train_value: str = "train") -> DataFrame:
    """(pos, mean, std) per feature position on the train split only.

    Population std; a zero std becomes 1 (Q10). Whole vectors are summed per
    task and the sums merged: no row per cell.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    train = examples.where(F.col(split_col) == train_value)
    s = train.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(features)).alias("s"))
    n = F.col("s.count")
    cells = F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))
    long = s.where(n > 0).select(n.alias("n"), F.posexplode(cells).alias("pos", "c"))
    std = F.sqrt(F.col("c.variance") * (F.col("n") - 1) / F.col("n"))  # of the population, from the sample's
    return long.select(F.col("pos").cast("int").alias("pos"), F.col("c.mean").alias("mean"),
                       F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def scaler_packed(scaler: DataFrame):
    """The fitted scaler as one sorted array of (pos, mean, std): a scalar
    subquery of ``width`` values, evaluated once."""
    return scaler.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s")).scalar()


def scale_features(examples: DataFrame, scaler: DataFrame, features: str = "features",
                   out: str = "scaled") -> DataFrame:
    # the subquery lands in its own column first: Spark does not allow a
    # subquery inside a lambda
    s = F.col("_scaler")
    mean = F.transform(s, lambda r: r["mean"])
    std = F.transform(s, lambda r: r["std"])
    return (examples.withColumn("_scaler", scaler_packed(scaler))
                    .withColumn(out, apply_scaler(features, mean, std))
                    .drop("_scaler"))


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """The three weight forms: neg/pos, 5*neg/(pos+1e-6), all/pos."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return labels.agg(
        pos.alias("n_pos"), neg.alias("n_neg"),
        F.try_divide(neg.cast("double"), pos.cast("double")).alias("neg_over_pos"),
        (F.lit(5.0) * neg / (pos + F.lit(1e-6))).alias("scaled_neg_over_pos"),
        F.try_divide(F.count(F.lit(1)).cast("double"), pos.cast("double")).alias("all_over_pos"))
