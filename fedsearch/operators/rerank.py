"""Merging per-source results into one ranked list (survey H2-H4, F9).

All rerankers are ``DataFrame -> DataFrame`` with the same output columns, so
they can be swapped (survey M3). Groups are one query's hits: k per source,
bounded by k x sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.operators.retrieve import merge_topk

UNJUDGED = 1 << 62


def merge_desc(hits: DataFrame, k: int) -> DataFrame:
    """Higher score first, cut at k; ties to the lower vec_id (H2)."""
    return merge_topk(hits, k, higher_is_better=True)


def merge_asc(hits: DataFrame, k: int) -> DataFrame:
    """Lower score first (distance-like), cut at k (H3)."""
    return merge_topk(hits, k, higher_is_better=False)


def qrels_positions(qrels: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each judged doc (``keys``) in the judged order: rel desc, file order on ties.

    A doc judged twice keeps its last position.
    """
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("ord").asc())
    return (qrels.withColumn("judged_pos", (F.row_number().over(w) - 1).cast("bigint"))
                 .groupBy(*keys).agg(F.max("judged_pos").alias("judged_pos")))


def attach_qrels(hits: DataFrame, qrels: DataFrame, doc_key: str = "vec_id",
                 with_source: bool = False) -> DataFrame:
    """Left join of judged positions onto the hits of the same query (F9);
    ``with_source`` where a document id is unique only inside its source."""
    keys = ["qid", doc_key] + (["source_id"] if with_source else [])
    return hits.join(qrels_positions(qrels, keys), keys, "left")


def merge_by_qrels(hits: DataFrame, qrels: DataFrame, k: int, doc_key: str = "vec_id") -> DataFrame:
    """Judged docs first in judged order (rel 0 still counts as judged), then the
    unjudged in arrival order, stated as (source_id, local_rank) (H4)."""
    j = attach_qrels(hits, qrels, doc_key)
    w = Window.partitionBy("qid").orderBy(
        F.coalesce(F.col("judged_pos"), F.lit(UNJUDGED)).asc(),
        F.col("source_id").asc(), F.col("local_rank").asc())
    return (j.withColumn("rank", F.row_number().over(w))
             .where(F.col("rank") <= k)
             .withColumn("rank", F.col("rank").cast("bigint")))


RERANKERS: dict[str, Callable[..., DataFrame]] = {
    "medrag": merge_desc,
    "wikipedia": merge_asc,
    "feb4rag": merge_by_qrels,
}
