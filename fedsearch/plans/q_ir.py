"""Catalogue: retrieval quality of the routed, merged top 10 against qrels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.operators import metrics as M
from fedsearch.operators import rerank
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

KS = (1, 3, 5, 10)

_PER_K_SQL = """
WITH res AS (SELECT qid, vec_id, rank FROM (
    SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM hits)
  WHERE rank <= 10),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
ann AS (SELECT DISTINCT vec_id FROM qrels),
r AS (SELECT res.qid, res.vec_id, res.rank, coalesce(j.rel, 0) AS rel,
             CASE WHEN coalesce(j.rel, 0) > 0 THEN 1 ELSE 0 END AS isrel,
             CASE WHEN a.vec_id IS NULL THEN 1 ELSE 0 END AS hole
      FROM res LEFT JOIN qrels j ON j.qid = res.qid AND j.vec_id = res.vec_id
      LEFT JOIN ann a ON a.vec_id = res.vec_id),
r2 AS (SELECT *, sum(isrel) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS rel_upto FROM r),
per AS (SELECT r2.qid, ks.k, sum(rel / log2(rank + 1)) AS dcg, sum(isrel) AS hits,
               sum(CASE WHEN isrel = 1 THEN rel_upto / rank ELSE 0.0 END) AS ap_sum,
               min(CASE WHEN isrel = 1 THEN rank END) AS first_rel, sum(hole) AS holes
        FROM r2 JOIN ks ON r2.rank <= ks.k GROUP BY r2.qid, ks.k),
ideal AS (SELECT i.qid, ks.k, sum(rel / log2(ir + 1)) AS idcg FROM (
    SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, vec_id) AS ir FROM qrels) i
  JOIN ks ON i.ir <= ks.k GROUP BY i.qid, ks.k),
nrel AS (SELECT qid, count_if(rel > 0) AS n_rel FROM qrels GROUP BY qid),
nq AS (SELECT count(DISTINCT qid) AS n FROM qrels),
m AS (SELECT per.k,
             CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg,
             CASE WHEN n_rel > 0 THEN ap_sum / n_rel ELSE 0.0 END AS ap,
             CASE WHEN n_rel > 0 THEN hits / n_rel ELSE 0.0 END AS recall,
             hits / per.k AS precision,
             coalesce(1.0 / first_rel, 0.0) AS rr,
             CASE WHEN least(n_rel, per.k) > 0 THEN hits / least(n_rel, per.k) ELSE 0.0 END AS rcap,
             holes / per.k AS hole_frac
      FROM per LEFT JOIN ideal ON ideal.qid = per.qid AND ideal.k = per.k
      JOIN nrel ON nrel.qid = per.qid),
agg AS (SELECT k, avg(ndcg) AS ndcg, avg(ap) AS map, avg(recall) AS recall, avg(precision) AS precision,
               sum(rr) / (SELECT n FROM nq) AS mrr, sum(rcap) / (SELECT n FROM nq) AS r_cap,
               sum(hole_frac) / (SELECT n FROM nq) AS hole
        FROM m GROUP BY k)
"""


def _metrics(spark, d):
    res = rerank.merge_desc(fx.hits(spark, d), 10).select("qid", "vec_id", "rank")
    return M.ir_metrics(res, fx.qrels(spark, d).select("qid", "vec_id", "rel"), KS)


def _register(name: str, cols: tuple[str, ...], doc: str):
    sql = _PER_K_SQL + "SELECT k, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + " FROM agg"

    @query(name, sql)
    def fn(spark, d):
        m = _metrics(spark, d)
        return m.select("k", *[F.round(F.col(c), 6).alias(c) for c in cols])
    fn.__doc__ = doc
    return fn


ndcg_at_k = _register("ndcg_at_k", ("ndcg",), "NDCG@k with graded gain rel / log2(rank + 1).")
map_at_k = _register("map_at_k", ("map",), "MAP@k: precision at each relevant hit / relevant count.")
precision_recall_at_k = _register("precision_recall_at_k", ("precision", "recall"), "P@k and R@k.")
mrr = _register("mrr", ("mrr",), "Reciprocal rank of the first relevant hit within k.")
recall_cap = _register("recall_cap", ("r_cap",), "Hits / min(relevant, k).")
hole = _register("hole", ("hole",), "Share of the top k never judged for any query.")
