"""Source selection: which sources each query searches (survey F1-F3, E3, H6).

Pairs are built without a cross join: the source ids are a fixed-size
dimension, read once as a sorted array (a scalar subquery, one row) and
exploded next to each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_id_array(sources: DataFrame) -> Column:
    """All source ids as one sorted array (scalar subquery over the dimension)."""
    return sources.agg(F.array_sort(F.collect_set("source_id")).alias("ids")).scalar()


def route_all(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every query with every source (F1 candidate pairs, F3 'all')."""
    return queries.select("*", F.explode(source_id_array(sources)).alias("source_id"))


def route_none(queries: DataFrame) -> DataFrame:
    """No source at all (F3 'none'); an empty relation that AQE propagates."""
    return queries.select("*", F.lit(None).cast("int").alias("source_id")).where(F.lit(False))


def route_by_rule(queries: DataFrame, n_sources: int, keep) -> DataFrame:
    """Sources 0..n-1 kept by a per-pair predicate ``keep(qid_col, source_col)``."""
    ids = F.filter(F.sequence(F.lit(0), F.lit(n_sources - 1)), lambda s: keep(F.col("qid"), s))
    return queries.select("*", F.explode(ids).alias("source_id"))


def route_random(queries: DataFrame, sources: DataFrame, n: int,
                 order: Column | None = None, seed: int = 42) -> DataFrame:
    """n distinct sources per query in a hash order (H6, F3 'random').

    ``order`` defaults to ``xxhash64(qid, source_id, seed)``: uniform, but fixed
    for a given seed so reruns and recomputed tasks pick the same sources.
    Ties end in the lower source id. Group size is the number of sources.
    """
    pairs = route_all(queries, sources)
    key = order if order is not None else F.xxhash64("qid", "source_id", F.lit(seed))
    w = Window.partitionBy("qid").orderBy(key.asc(), F.col("source_id").asc())
    return (pairs.withColumn("pick", F.row_number().over(w))
                 .where(F.col("pick") <= n)
                 .withColumn("pick", F.col("pick").cast("bigint")))


def route_threshold(scored: DataFrame, threshold, prob_col: str = "prob") -> DataFrame:
    """Keep pairs whose probability is strictly above the threshold.

    ``threshold`` is a number or a column (e.g. from the sources dimension).
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.where(F.col(prob_col) > t)


def attach_encoder(pairs: DataFrame, sources: DataFrame, query_vecs: DataFrame) -> DataFrame:
    """Pick each pair's query vector by the encoder of its source (F2).

    ``query_vecs(qid, encoder, qv)`` holds one vector per distinct encoder, so a
    query is encoded once per encoder, not once per source.
    """
    enc = sources.select("source_id", "encoder")
    return pairs.join(enc, "source_id").join(query_vecs, ["qid", "encoder"])


def distinct_encoders(sources: DataFrame) -> DataFrame:
    """Sources grouped under each distinct encoder."""
    return sources.groupBy("encoder").agg(
        F.array_sort(F.collect_list("source")).alias("sources"),
        F.count(F.lit(1)).alias("n_sources"))
