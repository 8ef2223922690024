"""Catalogue: router quality on scored (query, source) pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.functions.vectors import dot
from fedsearch.operators import metrics as M
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

THRESHOLD = 0.5
_RATES = ("accuracy", "precision", "recall", "f1")


def _r(c, n=6):
    return F.round(c, n)


_CONF_SQL = """CAST(count_if(prob > 0.5 AND label = 1) AS BIGINT) AS tp,
       CAST(count_if(prob > 0.5 AND label <> 1) AS BIGINT) AS fp,
       CAST(count_if(prob <= 0.5 AND label <> 1) AS BIGINT) AS tn,
       CAST(count_if(prob <= 0.5 AND label = 1) AS BIGINT) AS fn"""

_RATES_SQL = """round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0
             THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
             ELSE 0.0 END, 6) AS f1"""


@query("confusion", f"SELECT {_CONF_SQL} FROM scored")
def confusion(spark, d):
    """TP, FP, TN, FN at probability > 0.5."""
    return M.confusion(fx.scored(spark, d), THRESHOLD)


@query("binary_metrics", f"""
SELECT tp, fp, tn, fn, {_RATES_SQL} FROM (SELECT {_CONF_SQL} FROM scored)""")
def binary_metrics(spark, d):
    """Accuracy, precision, recall, F1; 0 where undefined."""
    b = M.binary_metrics(M.confusion(fx.scored(spark, d), THRESHOLD))
    return b.select("tp", "fp", "tn", "fn", *[_r(F.col(c)).alias(c) for c in _RATES])


_HIST_SQL = """h AS (SELECT {g}prob AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg
                 FROM {src} GROUP BY {g}prob),
c AS (SELECT {g}score, pos, neg,
             sum(pos) OVER (PARTITION BY {p} ORDER BY score) AS cum_pos,
             sum(neg) OVER (PARTITION BY {p} ORDER BY score) AS cum_neg,
             sum(pos) OVER (PARTITION BY {p}) AS tot_pos, sum(neg) OVER (PARTITION BY {p}) AS tot_neg FROM h),
pts AS (SELECT {g}score, pos, neg, cum_pos, cum_neg, tot_pos, tot_neg,
               CASE WHEN tot_pos > 0 THEN (tot_pos - cum_pos + pos) / tot_pos ELSE 0.0 END AS tpr,
               CASE WHEN tot_neg > 0 THEN (tot_neg - cum_neg + neg) / tot_neg ELSE 0.0 END AS fpr FROM c),
auc AS (SELECT {g}CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0
                     THEN sum(pos * (cum_neg - neg + neg / 2.0)) / (max(tot_pos) * max(tot_neg))
                     ELSE 0.0 END AS auc FROM pts {gb})"""


def _hist_sql(src: str = "scored", group: str | None = None) -> str:
    return _HIST_SQL.format(g=f"{group}, " if group else "", p=group or "true", src=src,
                            gb=f"GROUP BY {group}" if group else "")


@query("roc_curve", f"""
WITH {_hist_sql()}
SELECT score AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM pts""")
def roc_curve(spark, d):
    """TPR and FPR of ``score >= t`` at every distinct score."""
    p = M.roc_points(fx.scored(spark, d))
    return p.select(F.col("score").alias("threshold"), _r(F.col("tpr")).alias("tpr"), _r(F.col("fpr")).alias("fpr"))


@query("roc_auc", f"""
WITH {_hist_sql()}
SELECT round(auc, 6) AS auc FROM auc""")
def roc_auc(spark, d):
    """Rank AUC, ties counted half."""
    return M.roc_auc(fx.scored(spark, d)).select(_r(F.col("auc")).alias("auc"))


@query("youden_threshold", f"""
WITH {_hist_sql()}
SELECT score AS threshold, round(tpr - fpr, 6) AS j, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (
  SELECT *, row_number() OVER (ORDER BY tpr - fpr DESC, score DESC) AS rn FROM pts) WHERE rn = 1""")
def youden_threshold(spark, d):
    """Score with the largest TPR - FPR; the highest one on ties."""
    y = M.youden_threshold(fx.scored(spark, d))
    return y.select("threshold", _r(F.col("j")).alias("j"), _r(F.col("tpr")).alias("tpr"),
                    _r(F.col("fpr")).alias("fpr"))


@query("metrics_by_bank", f"""
WITH s AS (SELECT (qid // 10) % 4 AS bank, * FROM scored),
{_hist_sql('s', 'bank')}
SELECT m.bank, tp, fp, tn, fn, {_RATES_SQL}, round(a.auc, 6) AS auc
FROM (SELECT bank, {_CONF_SQL} FROM s GROUP BY bank) m JOIN auc a ON a.bank = m.bank""")
def metrics_by_bank(spark, d):
    """Confusion, rates and AUC for each bank of queries."""
    s = fx.scored(spark, d).withColumn("bank", F.floor(F.col("qid") / 10) % 4)
    b = M.binary_metrics(M.confusion(s, THRESHOLD, ["bank"]))
    a = M.roc_auc(s, ["bank"])
    return b.join(a, "bank").select("bank", "tp", "fp", "tn", "fn",
                                    *[_r(F.col(c)).alias(c) for c in _RATES], _r(F.col("auc")).alias("auc"))


@query("route_reduction", """
SELECT count(*) AS pairs, round(1 - avg(CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS reduction,
       round(1 - avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS best_reduction FROM scored""")
def route_reduction(spark, d):
    """Share of source requests saved by the router, and the best possible."""
    r = M.route_reduction(fx.scored(spark, d), THRESHOLD)
    return r.select("pairs", _r(F.col("reduction")).alias("reduction"),
                    _r(F.col("best_reduction")).alias("best_reduction"))


@query("log_loss", """
WITH e AS (SELECT s.*, p.split, 4.0 * list_inner_product(q.qv, d.seed) AS z FROM scored s
           JOIN split p ON p.qid = s.qid JOIN q ON q.qid = s.qid JOIN seeds d ON d.source_id = s.source_id),
pw AS (SELECT count_if(label = 0) / count_if(label = 1) AS w FROM e WHERE split = 'train'),
c AS (SELECT e.*, 1.0 / (1.0 + exp(-z)) AS p, pw.w FROM e CROSS JOIN pw)
SELECT split, count(*) AS n,
       round(avg(-(w * label * ln(p) + (1.0 - label) * ln(1.0 - p))), 6) AS loss,
       round(avg(CASE WHEN (CASE WHEN z > 0 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM c GROUP BY split""")
def log_loss(spark, d):
    """Class-weighted cross-entropy and accuracy per split."""
    from fedsearch.operators.train import class_weights
    seeds = fx.seeds(fx.embeddings(spark, d))
    e = (fx.scored(spark, d).join(fx.split(spark, d), "qid").join(fx.queries(spark, d).select("qid", "qv"), "qid")
         .join(seeds, "source_id").withColumn("logit", F.lit(fx.PROB_SLOPE) * dot("qv", "seed")))
    pw = class_weights(e.where(F.col("split") == "train")).select("neg_over_pos").scalar()
    # the weight lands in a column first: no subquery inside an aggregate
    r = M.log_loss(e.withColumn("_pw", pw), F.col("_pw"), ["split"])
    return r.select("split", "n", _r(F.col("loss")).alias("loss"), _r(F.col("accuracy")).alias("accuracy"))


@query("best_epoch", """
WITH h AS (SELECT event_type AS run, user_id AS epoch, count(*) AS metric FROM events GROUP BY event_type, user_id)
SELECT run, epoch AS best_epoch, metric AS best_metric FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS rn FROM h) WHERE rn = 1""")
def best_epoch(spark, d):
    """Earliest epoch with the best metric per run; runs/epochs/metric from ``events``."""
    e = fx.read(spark, d, "events")
    h = e.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("epoch")) \
        .agg(F.count(F.lit(1)).alias("metric"))
    return M.best_epoch(h, ["run"])
