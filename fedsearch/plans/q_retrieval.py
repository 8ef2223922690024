"""Catalogue: routing, routed top-k retrieval and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.operators import rerank, retrieve, routing
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

R6 = 6  # scores are compared after rounding to 6 decimals


def _ranked(df):
    return df.select("qid", "source_id", "vec_id", F.round("score", R6).alias("score"), "rank")


@query("routed_topk_merge", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM hits)
WHERE rank <= 10""")
def routed_topk_merge(spark, d):
    """Search only the routed sources, 5 per source, merge to 10 (flagship)."""
    return _ranked(rerank.merge_desc(fx.hits(spark, d), 10))


@query("knn_builtin", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM hits)
WHERE rank <= 10""")
def knn_builtin(spark, d):
    """The flagship through the tier of built-in expressions."""
    h = retrieve.knn(fx.routed(spark, d), fx.corpus(spark, d), fx.HITS_K)
    return _ranked(rerank.merge_desc(h, 10))


@query("knn_arrow", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, local_rank FROM hits""")
def knn_arrow(spark, d):
    """Five best of each routed pair by tiles against query blocks of small size."""
    h = retrieve.knn_arrow(fx.routed(spark, d), fx.corpus(spark, d), fx.HITS_K, tile_rows=64, block_queries=16)
    return h.select("qid", "source_id", "vec_id", F.round("score", R6).alias("score"), "local_rank")


@query("route_all_topk", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT * FROM (
      SELECT q.qid, c.source_id, c.vec_id, list_inner_product(q.qv, c.v) AS score,
             row_number() OVER (PARTITION BY q.qid, c.source_id
                                ORDER BY list_inner_product(q.qv, c.v) DESC, c.vec_id) AS lr
      FROM q JOIN corpus c ON true) WHERE lr <= 5))
WHERE rank <= 10""")
def route_all_topk(spark, d):
    """Routing 'all': every source searched, 5 each, merged to 10."""
    q = routing.route_all(fx.queries(spark, d).select("qid", "qv"), fx.sources(spark, d))
    h = retrieve.knn_arrow(q, fx.corpus(spark, d), 5)
    return _ranked(rerank.merge_desc(h, 10))


@query("route_none", """
SELECT q.qid, count(h.vec_id) AS n_hits FROM q
LEFT JOIN (SELECT * FROM hits WHERE false) h ON h.qid = q.qid GROUP BY q.qid""")
def route_none(spark, d):
    """Routing 'none': nothing searched; every query still reports, with 0 hits."""
    q = fx.queries(spark, d).select("qid", "qv")
    h = retrieve.knn(routing.route_none(q), fx.corpus(spark, d), 5)
    return (q.select("qid").join(h, "qid", "left")
             .groupBy("qid").agg(F.count("vec_id").alias("n_hits")))


@query("route_random_n", """
SELECT qid, source_id, pick FROM (
  SELECT q.qid, s.source_id,
         row_number() OVER (PARTITION BY q.qid
                            ORDER BY (q.qid * 31 + s.source_id * 17) % 101, s.source_id) AS pick
  FROM q CROSS JOIN seeds s) WHERE pick <= 2""")
def route_random_n(spark, d):
    """Random routing with n = 2, in a stated hash order."""
    q = fx.queries(spark, d).select("qid")
    order = (F.col("qid") * 31 + F.col("source_id") * 17) % 101
    return routing.route_random(q, fx.sources(spark, d), 2, order=order).select("qid", "source_id", "pick")


@query("global_topk", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM gtop WHERE rank <= 10""")
def global_topk(spark, d):
    """Nearest 10 over all sources (the 'all' baseline, F6)."""
    q = fx.queries(spark, d).select("qid", "qv")
    return _ranked(retrieve.knn_global(q, fx.corpus(spark, d), fx.sources(spark, d), 10))


@query("global_topk_pruned", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM gtop WHERE rank <= 10""")
def global_topk_pruned(spark, d):
    """The same from the stored tiles, those left out whose ball lies too far."""
    from fedsearch.operators import tiles
    q = fx.queries(spark, d).select("qid", "qv")
    return _ranked(tiles.knn_pruned(q, tiles.read_tiles(spark, fx.tiles(spark, d)), 10))


@query("routing_recall", """
SELECT g.qid, count(r.qid) AS n_kept, round(count(r.qid) / 10.0::DOUBLE, 6) AS recall
FROM (SELECT * FROM gtop WHERE rank <= 10) g
LEFT JOIN routed r ON r.qid = g.qid AND r.source_id = g.source_id
GROUP BY g.qid""")
def routing_recall(spark, d):
    """Share of each query's global top 10 that its routed sources hold."""
    q = fx.queries(spark, d).select("qid", "qv")
    g = retrieve.knn_global(q, fx.corpus(spark, d), fx.sources(spark, d), 10)
    r = fx.routed(spark, d).select("qid", "source_id", F.lit(1).alias("kept"))
    return (g.join(r, ["qid", "source_id"], "left").groupBy("qid")
             .agg(F.count("kept").alias("n_kept"),
                  F.round(F.count("kept") / F.lit(10.0), R6).alias("recall")))


@query("merge_desc", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM hits)
WHERE rank <= 8""")
def merge_desc(spark, d):
    return _ranked(rerank.merge_desc(fx.hits(spark, d), 8))


@query("merge_asc", """
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score ASC, vec_id) AS rank FROM hits)
WHERE rank <= 10""")
def merge_asc(spark, d):
    return _ranked(rerank.merge_asc(fx.hits(spark, d), 10))


@query("merge_by_qrels", """
WITH pos AS (
  SELECT qid, vec_id, max(p) AS judged_pos FROM (
    SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, ord) - 1 AS p FROM qrels)
  GROUP BY qid, vec_id)
SELECT qid, vec_id, source_id, judged_pos, rank FROM (
  SELECT h.qid, h.vec_id, h.source_id, p.judged_pos,
         row_number() OVER (PARTITION BY h.qid
                            ORDER BY coalesce(p.judged_pos, 4611686018427387904), h.source_id, h.local_rank) AS rank
  FROM hits h LEFT JOIN pos p ON p.qid = h.qid AND p.vec_id = h.vec_id)
WHERE rank <= 10""")
def merge_by_qrels(spark, d):
    m = rerank.merge_by_qrels(fx.hits(spark, d), fx.qrels(spark, d), 10)
    return m.select("qid", "vec_id", "source_id", "judged_pos", "rank")


@query("fetch_docs_left", """
SELECT h.qid, h.source_id, h.vec_id, h.local_rank, d.source AS doc_source, d.lang,
       d.n_chars, CAST(strlen(d.text) AS BIGINT) AS text_bytes
FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id""")
def fetch_docs_left(spark, d):
    """Documents for the winners only; a missing document keeps a null row (F8)."""
    docs = fx.read(spark, d, "documents").select(
        "doc_id", F.col("source").alias("doc_source"), "lang", "n_chars",
        F.octet_length("text").cast("bigint").alias("text_bytes"))
    h = fx.hits(spark, d).select("qid", "source_id", "vec_id", "local_rank")
    return retrieve.fetch_docs(h, docs)
