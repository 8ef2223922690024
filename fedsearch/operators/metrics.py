"""Aggregations: router quality, retrieval quality, latency and volume (survey 2.G).

Design rules kept throughout:
  * every metric is a grouped aggregate with partial (map-side) combine;
  * anything order-dependent (ROC, AUC, quantiles) first collapses rows to a
    histogram by value, then uses ``prefix_sums`` - range-partitioned running
    sums - so no single task ever holds a whole group;
  * ratios use ``try_divide``/guards: ANSI mode raises on division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.functions.vectors import cosine
from fedsearch.operators.positions import prefix_sums


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---- confusion matrix and binary metrics (G5, G6, G10, G21) ----------------

def confusion(scored: DataFrame, threshold: float = 0.5, by: list[str] | None = None,
              prob: str = "prob", label: str = "label") -> DataFrame:
    """TP/FP/TN/FN with the positive rule ``prob > threshold`` (strict, Q12)."""
    pred = F.col(prob) > F.lit(threshold)
    y = F.col(label) == 1
    aggs = [F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
            F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn")]
    return scored.groupBy(*(by or [])).agg(*aggs)


def binary_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from a confusion row; 0 when undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    return (conf.withColumn("accuracy", _safe_div(tp + tn, tp + fp + tn + fn))
                .withColumn("precision", precision)
                .withColumn("recall", recall)
                .withColumn("f1", _safe_div(F.lit(2.0) * precision * recall, precision + recall)))


def route_reduction(scored: DataFrame, threshold: float = 0.5, prob: str = "prob",
                    label: str = "label", by: list[str] | None = None) -> DataFrame:
    """1 - share of pairs searched: predicted, and the best possible (true labels)."""
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.lit(1.0) - F.avg((F.col(prob) > F.lit(threshold)).cast("double"))).alias("reduction"),
        (F.lit(1.0) - F.avg((F.col(label) == 1).cast("double"))).alias("best_reduction"))


# ---- ROC, AUC, Youden (G7-G9) ----------------------------------------------

def score_histogram(scored: DataFrame, by: list[str], prob: str = "prob",
                    label: str = "label") -> DataFrame:
    """(by..., score, pos, neg): one row per distinct score, partially aggregated."""
    return scored.groupBy(*by, F.col(prob).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_points(scored: DataFrame, by: list[str] | None = None, prob: str = "prob",
               label: str = "label") -> DataFrame:
    """At each distinct score t: TPR and FPR of the rule ``score >= t``."""
    by = by or []
    hist = score_histogram(scored, by, prob, label)
    ps = prefix_sums(hist, by, [F.col("score").asc()], ["pos", "neg"])
    # counts with score >= t = total - (inclusive ascending prefix) + own count
    ge_pos = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    ge_neg = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return ps.select(*by, "score", "pos", "neg", "cum_pos", "cum_neg", "tot_pos", "tot_neg",
                     _safe_div(ge_pos, F.col("tot_pos")).alias("tpr"),
                     _safe_div(ge_neg, F.col("tot_neg")).alias("fpr"))


def roc_auc(scored: DataFrame, by: list[str] | None = None, prob: str = "prob",
            label: str = "label") -> DataFrame:
    """Rank AUC with ties counted half; 0 when a group has one class only."""
    by = by or []
    pts = roc_points(scored, by, prob, label)
    # negatives strictly below this score, plus half of the tied ones
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    agg = pts.groupBy(*by).agg(
        F.sum(F.col("pos") * below).alias("_u"),
        F.max("tot_pos").alias("_p"), F.max("tot_neg").alias("_n"))
    return agg.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                  F.col("_u") / (F.col("_p") * F.col("_n")))
                      .otherwise(F.lit(0.0)).alias("auc"))


def youden_threshold(scored: DataFrame, by: list[str] | None = None, prob: str = "prob",
                     label: str = "label") -> DataFrame:
    """Threshold maximising TPR - FPR; the first maximum = the highest such score."""
    by = by or []
    pts = roc_points(scored, by, prob, label).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.max_by(F.struct("score", "j", "tpr", "fpr"), F.struct(F.col("j"), F.col("score")))
    return pts.groupBy(*by).agg(best.alias("b")).select(*by, "b.score", "b.j", "b.tpr", "b.fpr") \
        .withColumnRenamed("score", "threshold")


# ---- losses and model selection (G19, G20) ----------------------------------

def log_loss(scored: DataFrame, pos_weight: Column, by: list[str] | None = None,
             logit: str = "logit", label: str = "label") -> DataFrame:
    """Weighted binary cross-entropy of logits; exact for saturated rows, nothing is clipped."""
    z, y = F.col(logit), F.col(label).cast("double")
    softplus = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))  # log(1 + exp(-z))
    loss = (F.lit(1.0) - y) * z + (F.lit(1.0) + (pos_weight - F.lit(1.0)) * y) * softplus
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"),
        F.avg(((z > 0).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def best_epoch(history: DataFrame, by: list[str], epoch: str = "epoch",
               metric: str = "metric") -> DataFrame:
    """Epoch with the best metric; strict improvement, so the earliest wins ties."""
    key = F.struct(F.col(metric), (-F.col(epoch)).alias("_neg"))
    return history.groupBy(*by).agg(
        F.max_by(F.col(epoch), key).alias("best_epoch"),
        F.max(F.col(metric)).alias("best_metric"))


# ---- answers and latency (G2, G3, G4, G23) ----------------------------------

def accuracy(graded: DataFrame, by: list[str], correct: str = "correct",
             rollup: bool = False) -> DataFrame:
    """total, correct, accuracy per group; ``rollup`` adds subtotal rows (NULL keys)."""
    g = graded.rollup(*by) if rollup else graded.groupBy(*by)
    c = F.col(correct).cast("int")
    return g.agg(F.count(F.lit(1)).alias("total"), F.sum(c).cast("bigint").alias("n_correct"),
                 F.avg(c.cast("double")).alias("accuracy"))


#: Relative rank error of the sketch that guides :func:`exact_quantiles` is one over this.
SKETCH_ACCURACY = 10_000
#: Share of a group's ranks taken on each side of a target: with the error and the two places that a quantile needs,
#: enough for groups of ``SMALL_GROUP`` rows and more; smaller ones are taken whole.
SLACK, SMALL_GROUP = 0.002, 2_000


def exact_quantiles(df: DataFrame, by: list[str], value: str,
                    probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Linear-interpolation quantiles (``percentile``/``quantile_cont``), exact.

    A mergeable sketch per group (partially aggregated) gives an interval
    around each target that is sure to hold it. A second pass counts what is
    below each interval and collapses the few rows inside to a histogram;
    only this histogram is ordered (range-partitioned prefix counts).
    Output: by..., p, q.
    """
    rows = df.where(F.col(value).isNotNull())
    ends = [0.0, 1.0, *(max(p - SLACK, 0.0) for p in probs), *(min(p + SLACK, 1.0) for p in probs)]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                   F.percentile_approx(value, F.array(*map(F.lit, ends)), SKETCH_ACCURACY).alias("e"))
    small = F.col("n") < SMALL_GROUP

    def end(whole: int, place: int) -> Column:
        return F.get("e", F.when(small, F.lit(whole)).otherwise(F.lit(place)))

    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), end(0, 2 + i).alias("low"), end(1, 2 + len(probs) + i).alias("high"))
                        for i, p in enumerate(probs)])
    near = rows.select(*by, F.col(value).alias("_x")).join(sketch.select(*by, "n", targets.alias("_all")), by).select(
        *by, "n", "_x", F.explode(F.filter("_all", lambda t: F.col("_x") <= t["high"])).alias("_t"))
    # rows below an interval have no value of their own: one row per task and target after the map-side combine
    hist = near.groupBy(*by, "n", F.col("_t.p").alias("p"), F.when(F.col("_x") >= F.col("_t.low"), F.col("_x")).alias("x")) \
        .agg(F.count(F.lit(1)).alias("c"))
    ps = prefix_sums(hist, [*by, "p"], [F.col("x").asc_nulls_first()], ["c"]).where("x is not null")
    at = ps.withColumn("rn", (F.col("n") - 1).cast("double") * F.col("p"))

    def value_at(j: Column) -> Column:
        return F.max(F.when((F.col("cum_c") - F.col("c") <= j) & (j < F.col("cum_c")), F.col("x")))

    vals = at.groupBy(*by, "p").agg(value_at(F.floor("rn")).alias("v_lo"), value_at(F.ceil("rn")).alias("v_hi"),
                                    F.max(F.col("rn") - F.floor("rn")).alias("frac"))
    return vals.select(*by, "p", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("q"))


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the last points within 1.5 IQR,
    outlier count (G3, G4)."""
    q = exact_quantiles(df, by, value)
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name)
                                for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    wide = wide.withColumn("iqr", F.col("q3") - F.col("q1"))
    x, iqr = F.col(value), F.lit(1.5) * F.col("iqr")
    inside = (x >= F.col("q1") - iqr) & (x <= F.col("q3") + iqr)
    return df.join(wide, by).groupBy(*by, "q1", "median", "q3", "iqr").agg(
        F.count(x).alias("n"),
        F.min(F.when(inside, x)).alias("whisker_lo"),
        F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def comm_volume(df: DataFrame, by: list[str], payload: Column) -> DataFrame:
    """Items and bytes moved per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"),
                               F.sum(payload).cast("bigint").alias("bytes"))


# ---- source statistics and labels (G13, G16, F10) ---------------------------

def source_centroids(corpus: DataFrame, vec: str = "v") -> DataFrame:
    """(source_id, pos, mean): mean vector per source in long form."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    # whole vectors are summed per task and source; no row per cell
    mean = corpus.groupBy("source_id").agg(Summarizer.mean(array_to_vector(vec)).alias("m"))
    return mean.select("source_id", F.posexplode(vector_to_array("m")).alias("pos", "mean"))


def source_stats(corpus: DataFrame, vec: str = "v") -> DataFrame:
    """(source_id, centroid, num_documents, density).

    density is our definition (the reference reads it but never defines it):
    the mean cosine of a source's vectors to its centroid.
    """
    cent = (source_centroids(corpus, vec)
            .groupBy("source_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("_c"))
            .select("source_id", F.transform("_c", lambda s: s["mean"]).alias("centroid")))
    # one centroid per source: bounded by the federation size
    dens = corpus.join(cent, "source_id").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("num_documents"),
        F.avg(cosine(vec, "centroid")).alias("density"))
    return cent.join(dens, "source_id")


def relevant_sources(ranked: DataFrame, top: int) -> DataFrame:
    """Sources that hold a query's merged top ``top``."""
    return (ranked.where(F.col("rank") <= top).select("qid", "source_id").distinct())


def label_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """label = 1 when the source is in the query's relevant set."""
    lab = labels.select("qid", "source_id", F.lit(1).alias("_hit"))
    return pairs.join(lab, ["qid", "source_id"], "left") \
        .withColumn("label", F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit")


# ---- retrieval quality (G14) --------------------------------------------------

def ir_per_query(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...],
                 doc: str = "vec_id") -> DataFrame:
    """Per (qid, k): dcg, idcg, hits, ap_sum, first relevant rank, holes, n_rel.

    ``results`` is (qid, doc, rank 1..); ``qrels`` is (qid, doc, rel). Relevant
    means rel > 0; gain is rel; discount log2(rank + 1).
    """
    kk = F.array(*[F.lit(k) for k in ks])
    annotated = qrels.select(doc).distinct().withColumn("_ann", F.lit(1))
    r = (results.select("qid", doc, "rank")
                .join(qrels.select("qid", doc, "rel"), ["qid", doc], "left")
                .join(annotated, doc, "left"))
    relv = F.coalesce(F.col("rel"), F.lit(0))
    isrel = (relv > 0).cast("int")
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_rel_upto", F.sum(isrel).over(w)) \
         .withColumn("_gain", relv / F.log2(F.col("rank") + 1)) \
         .withColumn("_prec", F.when(isrel == 1, F.col("_rel_upto") / F.col("rank"))) \
         .withColumn("_isrel", isrel) \
         .withColumn("_hole", F.col("_ann").isNull().cast("int"))
    r = r.withColumn("k", F.explode(kk)).where(F.col("rank") <= F.col("k"))
    per = r.groupBy("qid", "k").agg(
        F.sum("_gain").alias("dcg"), F.sum("_isrel").alias("hits"),
        F.sum(F.coalesce(F.col("_prec"), F.lit(0.0))).alias("ap_sum"),
        F.min(F.when(F.col("_isrel") == 1, F.col("rank"))).alias("first_rel"),
        F.sum("_hole").alias("holes"))
    wi = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col(doc))
    ideal = (qrels.withColumn("_ir", F.row_number().over(wi))
                  .withColumn("k", F.explode(kk)).where(F.col("_ir") <= F.col("k"))
                  .groupBy("qid", "k").agg(F.sum(F.col("rel") / F.log2(F.col("_ir") + 1)).alias("idcg")))
    nrel = qrels.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("n_rel"))
    return per.join(ideal, ["qid", "k"], "left").join(nrel, "qid")


def ir_metrics(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10),
               doc: str = "vec_id") -> DataFrame:
    """Mean over queries, per k: ndcg, map, recall, precision, mrr, r_cap, hole.

    The first four average over queries with both results and judgements; the
    last three sum over result queries and divide by the judged query count.
    """
    per = ir_per_query(results, qrels, ks, doc)
    n_judged = qrels.select("qid").distinct().agg(F.count(F.lit(1)).alias("_nq")).scalar()
    k = F.col("k").cast("double")
    per = per.select(
        "k",
        _safe_div(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        _safe_div(F.col("ap_sum"), F.col("n_rel")).alias("ap"),
        _safe_div(F.col("hits"), F.col("n_rel")).alias("recall"),
        (F.col("hits") / k).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first_rel"), F.lit(0.0)).alias("rr"),
        _safe_div(F.col("hits"), F.least(F.col("n_rel"), F.col("k"))).alias("rcap"),
        (F.col("holes") / k).alias("hole_frac"))
    return per.groupBy("k").agg(
        F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"),
        F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
        (F.sum("rr") / n_judged).alias("mrr"), (F.sum("rcap") / n_judged).alias("r_cap"),
        (F.sum("hole_frac") / n_judged).alias("hole"))


def max_width(vectors: DataFrame, vec: str = "v", by: list[str] | None = None) -> DataFrame:
    """Widest vector (per group): the padding target across encoders."""
    return vectors.groupBy(*(by or [])).agg(F.max(F.size(vec)).alias("max_width"))
