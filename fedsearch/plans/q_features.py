"""Catalogue: vectors, features, source statistics, scaler and labels (2.C, G11-G13, G16, H8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.functions import vectors as V
from fedsearch.operators import metrics as M
from fedsearch.operators import train as T
from fedsearch.operators.routing import route_all
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

PAD = 96


def _r(c, n=6):
    return F.round(c, n)


@query("pad_and_onehot", """
SELECT qid, source_id, CAST(len(f) AS INTEGER) AS width,
       round(list_sum(list_slice(f, 1, 96)), 6) AS sum_q,
       round(list_sum(list_slice(f, 97, 192)), 6) AS sum_c,
       round(list_sum(list_slice(f, 193, 202)), 6) AS sum_s
FROM (SELECT q.qid, c.source_id,
             list_concat(list_concat(list_resize(q.qv, 96, 0.0), list_resize(c.centroid, 96, 0.0)),
                         list_transform(range(10), lambda i: CASE WHEN i = c.source_id THEN 1.0 ELSE 0.0 END)) AS f
      FROM q CROSS JOIN centroid c)""")
def pad_and_onehot(spark, d):
    """Pad query and centroid to a common width, append the one-hot source id."""
    f = fx.feats(spark, d)
    feat = V.route_features(V.pad_vector("qv", PAD), V.pad_vector("centroid", PAD), "source_id", fx.N_SOURCES)
    f = f.select("qid", "source_id", feat.alias("f"))
    return f.select("qid", "source_id", F.size("f").alias("width"),
                    _r(V.vec_sum(F.slice("f", 1, PAD))).alias("sum_q"),
                    _r(V.vec_sum(F.slice("f", PAD + 1, PAD))).alias("sum_c"),
                    _r(V.vec_sum(F.slice("f", 2 * PAD + 1, fx.N_SOURCES))).alias("sum_s"))


@query("feature_stats", """
SELECT q.qid, s.source_id, round(list_inner_product(q.qv, s.centroid), 6) AS dot_centroid,
       s.num_documents, round(s.density, 6) AS density
FROM q CROSS JOIN sstats s""")
def feature_stats(spark, d):
    """Dot to the centroid, document count and density per pair."""
    q = fx.queries(spark, d).select("qid", "qv")
    st = fx.stats(spark, d)
    p = route_all(q, fx.sources(spark, d)).join(st, "source_id")
    return p.select("qid", "source_id", _r(V.dot("qv", "centroid")).alias("dot_centroid"),
                    "num_documents", _r(F.col("density")).alias("density"))


_VARIANTS = {"q": (False, False), "qc": (True, False), "qs": (False, True), "qcs": (True, True)}


@query("feature_ablation", """
SELECT qid, source_id, variant, CAST(len(g) AS INTEGER) AS width, round(list_sum(g), 6) AS total FROM (
  SELECT qid, source_id, 'q' AS variant, list_slice(features, 1, 64) AS g FROM feats
  UNION ALL SELECT qid, source_id, 'qc', list_slice(features, 1, 128) FROM feats
  UNION ALL SELECT qid, source_id, 'qs', list_concat(list_slice(features, 1, 64), list_slice(features, 129, 138)) FROM feats
  UNION ALL SELECT qid, source_id, 'qcs', features FROM feats)""")
def feature_ablation(spark, d):
    """Keep the query part and, by flag, the centroid and source-id parts."""
    f = fx.feats(spark, d)
    variants = F.array(*[F.struct(F.lit(n).alias("variant"),
                                  V.feature_ablation("features", 64, 64, fx.N_SOURCES, c, s).alias("g"))
                         for n, (c, s) in _VARIANTS.items()])
    x = f.select("qid", "source_id", F.explode(variants).alias("x"))
    return x.select("qid", "source_id", "x.variant", F.size("x.g").alias("width"),
                    _r(V.vec_sum("x.g")).alias("total"))


@query("l2_norm_cosine", """
SELECT k.vec_id, k.source_id,
       round(sqrt(list_inner_product(c.centroid, c.centroid)), 6) AS centroid_norm,
       round(list_inner_product(
           CASE WHEN sqrt(list_inner_product(k.v, k.v)) > 0
                THEN list_transform(k.v, lambda x: x / sqrt(list_inner_product(k.v, k.v))) ELSE k.v END,
           CASE WHEN sqrt(list_inner_product(c.centroid, c.centroid)) > 0
                THEN list_transform(c.centroid, lambda x: x / sqrt(list_inner_product(c.centroid, c.centroid)))
                ELSE c.centroid END), 6) AS cos
FROM corpus k JOIN centroid c ON c.source_id = k.source_id""")
def l2_norm_cosine(spark, d):
    """Cosine of every corpus vector to its source centroid, via unit vectors."""
    c = fx.stats(spark, d).select("source_id", "centroid")
    k = fx.corpus(spark, d).join(c, "source_id")
    return k.select("vec_id", "source_id", _r(V.l2_norm("centroid")).alias("centroid_norm"),
                    _r(V.dot(V.l2_normalize("v"), V.l2_normalize("centroid"))).alias("cos"))


@query("source_stats_long", """
SELECT source_id, pos, round(mean, 6) AS mean FROM cent_long""")
def source_stats_long(spark, d):
    """Centroid of each source in long form."""
    return fx.centroids_long(spark, d).select(
        "source_id", F.col("pos").cast("int").alias("pos"), _r(F.col("mean")).alias("mean"))


@query("scaler_fit", """
SELECT pos, round(mean, 6) AS mean, round(CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS std FROM (
  SELECT i AS pos, avg(x) AS mean, stddev_pop(x) AS sd FROM (
    SELECT unnest(features) AS x, CAST(unnest(range(len(features))) AS INTEGER) AS i
    FROM examples WHERE split = 'train') GROUP BY i)""")
def scaler_fit(spark, d):
    """Per-dimension mean and population std on the train split only."""
    s = T.fit_scaler(fx.examples(spark, d))
    return s.select("pos", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


@query("scaler_apply", """
WITH cell AS MATERIALIZED (
  SELECT qid, source_id, split, unnest(features) AS x, unnest(range(len(features))) AS i FROM examples),
sc AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s
       FROM cell WHERE split = 'train' GROUP BY i)
SELECT qid, source_id, round(sum((x - m) / s), 4) AS scaled_sum, round(sum(((x - m) / s) * ((x - m) / s)), 4) AS scaled_sq
FROM cell JOIN sc ON sc.i = cell.i WHERE split = 'test' GROUP BY qid, source_id""")
def scaler_apply(spark, d):
    """(x - mean) / std with the train-split scaler, applied to test pairs."""
    ex = fx.examples(spark, d)
    z = T.scale_features(ex, T.fit_scaler(ex)).where(F.col("split") == "test")
    return z.select("qid", "source_id", _r(V.vec_sum("scaled"), 4).alias("scaled_sum"),
                    _r(V.dot("scaled", "scaled"), 4).alias("scaled_sq"))


@query("relevant_sources", """
SELECT qid, array_to_string(list_sort(list(CAST(source_id AS VARCHAR))), ':') AS sources,
       count(*) AS n_sources
FROM source_labels GROUP BY qid""")
def relevant_sources(spark, d):
    """Sources holding a query's merged top 3, ':'-joined, and their count."""
    from fedsearch.functions.text import join_sources
    from fedsearch.operators.retrieve import knn_global
    q = fx.queries(spark, d).select("qid", "qv")
    g = knn_global(q, fx.corpus(spark, d), fx.sources(spark, d), fx.LABEL_TOP)
    r = M.relevant_sources(g, fx.LABEL_TOP)
    return r.groupBy("qid").agg(join_sources(F.collect_list(F.col("source_id").cast("string"))).alias("sources"),
                                F.count(F.lit(1)).alias("n_sources"))


@query("label_pairs", """SELECT qid, source_id, label FROM scored""")
def label_pairs(spark, d):
    """Every (query, source) pair labelled 1 when the source is relevant."""
    q = fx.queries(spark, d).select("qid")
    pairs = route_all(q, fx.sources(spark, d))
    return M.label_pairs(pairs, fx.source_labels(spark, d)).select("qid", "source_id", "label")


@query("source_label_counts", """
SELECT source_id, CAST(sum(label) AS BIGINT) AS positives, count(*) AS pairs,
       round(avg(label), 6) AS positive_share FROM scored GROUP BY source_id""")
def source_label_counts(spark, d):
    s = fx.scored(spark, d)
    return s.groupBy("source_id").agg(F.sum("label").cast("bigint").alias("positives"),
                                      F.count(F.lit(1)).alias("pairs"),
                                      _r(F.avg("label")).alias("positive_share"))


@query("class_weights", """
SELECT CAST(count_if(label = 1) AS BIGINT) AS n_pos, CAST(count_if(label = 0) AS BIGINT) AS n_neg,
       round(count_if(label = 0) / count_if(label = 1), 6) AS neg_over_pos,
       round(5.0 * count_if(label = 0) / (count_if(label = 1) + 1e-6), 6) AS scaled_neg_over_pos,
       round(count(*) / count_if(label = 1), 6) AS all_over_pos
FROM scored""")
def class_weights(spark, d):
    """The three class-weight forms."""
    w = T.class_weights(fx.scored(spark, d))
    return w.select("n_pos", "n_neg", *[_r(F.col(c)).alias(c) for c in
                                         ("neg_over_pos", "scaled_neg_over_pos", "all_over_pos")])


@query("group_split", """SELECT qid, split FROM split""")
def group_split(spark, d):
    """Whole queries to test / val / train by a stated hash order, exact sizes (H8)."""
    q = fx.queries(spark, d).select("qid")
    order = [(F.col("qid") * fx.SPLIT_MULT) % fx.SPLIT_MOD, F.col("qid")]
    return T.group_split(q, order, fx.TEST_FRAC, fx.VAL_FRAC).select("qid", "split")
