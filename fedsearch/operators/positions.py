"""Global positions and running sums without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition runs in one task. At
scale we instead range-partition on the order keys (Spark samples the bounds,
so a hot key range is split), number rows inside each partition, and add the
row count of all earlier partitions.

The sampled bounds differ from one execution of a plan to the next, and column
pruning can make two uses of one frame two executions. So the partitioned
frame is written once, with the partition and the place inside it as columns:
the numbering and the offsets are read from the same stored rows, whatever the
frame's other columns, and a recomputed task reads them too. The
per-partition count table has one row per partition.

The order keys must be unique (add an id as the last key): ties would make
the order inside a partition depend on shuffle fetch order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.session import store


def _partitions(df: DataFrame) -> int:
    """Range partitions: the session's shuffle partition count (sized for the cluster)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _laid_out(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """``df`` stored in ``keys`` order with its partition (``_pid``) and 0-based place in it (``_local``)."""
    part = (df.repartitionByRange(num_partitions or _partitions(df), *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id()))
    # the place inside the partition: the id's low 33 bits
    place = F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return store(part.withColumn("_local", place), "positions")


def global_position(df: DataFrame, order: list[Column], col: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based BIGINT position in ``order`` (survey A4, E7, H7, H8)."""
    part = _laid_out(df, order, num_partitions)
    counts = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (part.join(F.broadcast(offsets), "_pid")  # one row per partition
                .withColumn(col, (F.col("_off") + F.col("_local") + 1).cast("bigint"))
                .drop("_pid", "_local", "_off"))


def group_position(df: DataFrame, group_cols: list[str], order: list[Column],
                   col: str = "pos") -> DataFrame:
    """1-based position inside each group, even when one group holds most rows."""
    g = global_position(df, [F.col(c) for c in group_cols] + order, "_gpos")
    first = g.groupBy(*group_cols).agg(F.min("_gpos").alias("_first"),
                                       F.count(F.lit(1)).alias("group_size"))
    return (g.join(first, group_cols)
             .withColumn(col, (F.col("_gpos") - F.col("_first") + 1).cast("bigint"))
             .drop("_gpos", "_first"))


def prefix_sums(df: DataFrame, group_cols: list[str], order: list[Column],
                value_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of non-negative ``value_cols`` inside each group,
    in ``order`` (``cum_<col>``), plus the group totals (``tot_<col>``).

    Range partitioning on (group, order) splits a large group over many tasks;
    each partition is summed alone and the totals of the earlier ones are
    added. Only one row per partition and one row per group travel back.
    """
    keys = [F.col(c) for c in group_cols] + order
    part = _laid_out(df, keys, num_partitions)
    local_w = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = part.groupBy("_pid").agg(*[F.sum(v).alias(f"_pt_{v}") for v in value_cols])
    # one row per partition: ordered in a single small task
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_pt_{v}").over(before), F.lit(0)).alias(f"_off_{v}")
                                      for v in value_cols])
    out = part.join(F.broadcast(offsets), "_pid")
    for v in value_cols:
        out = out.withColumn(f"_g_{v}", F.col(f"_off_{v}") + F.sum(v).over(local_w))
    if group_cols:
        # running total just before each group's first row = min of the exclusive prefix
        starts = out.groupBy(*group_cols).agg(
            *[F.min(F.col(f"_g_{v}") - F.col(v)).alias(f"_start_{v}") for v in value_cols],
            *[F.max(F.col(f"_g_{v}")).alias(f"_end_{v}") for v in value_cols])
        out = out.join(starts, group_cols)
        for v in value_cols:
            out = (out.withColumn(f"cum_{v}", F.col(f"_g_{v}") - F.col(f"_start_{v}"))
                      .withColumn(f"tot_{v}", F.col(f"_end_{v}") - F.col(f"_start_{v}")))
    else:
        grand = totals.agg(*[F.sum(f"_pt_{v}").alias(v) for v in value_cols])
        for v in value_cols:
            out = (out.withColumn(f"cum_{v}", F.col(f"_g_{v}"))
                      .withColumn(f"tot_{v}", grand.select(v).scalar()))
    drop = ["_pid", "_local"] + [f"{p}_{v}" for v in value_cols for p in ("_off", "_g", "_start", "_end")]
    return out.drop(*[c for c in drop if c in out.columns])
