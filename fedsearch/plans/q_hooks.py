"""Catalogue: text -> vector -> routed retrieval with the built-in hashed encoder, and loaded models as encoders (M1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fedsearch.functions.hooks import encode_once_per_encoder, hashed_bow_vectors, model_encoder
from fedsearch.operators import rerank, retrieve, routing
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query
from fedsearch.session import store

WIDTH = 64


def _whole(df):
    """Vectors as whole multiples of 1/1024: sums of their products are exact, so ties are ties."""
    return df.withColumn("v", F.transform("v", lambda x: F.floor(x * 1024 + 0.5).cast("double")))


def _vectors_sql(ident: str, table: str, width: int = WIDTH) -> str:
    return f"""(SELECT w.{ident}, list(floor(coalesce(c.x, 0.0::DOUBLE) / coalesce(n.norm, 1.0::DOUBLE) * 1024 + 0.5) ORDER BY w.b) AS v
      FROM (SELECT {ident}, b FROM {table}, range({width}) AS r(b)) w
      LEFT JOIN (SELECT {ident}, (h // 16) % {width} AS b, sum(CASE WHEN h % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS x FROM (
            SELECT {ident}, CAST('0x' || substr(md5(t), 1, 4) AS BIGINT) AS h FROM (
              SELECT {ident}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM {table}) WHERE t <> '')
            GROUP BY ALL) c ON c.{ident} = w.{ident} AND c.b = w.b
      LEFT JOIN (SELECT {ident}, sqrt(sum(x * x)) AS norm FROM (
            SELECT {ident}, (h // 16) % {width} AS b, sum(CASE WHEN h % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS x FROM (
            SELECT {ident}, CAST('0x' || substr(md5(t), 1, 4) AS BIGINT) AS h FROM (
              SELECT {ident}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM {table}) WHERE t <> '')
            GROUP BY ALL) GROUP BY {ident}) n ON n.{ident} = w.{ident} AND n.norm > 0
      GROUP BY w.{ident})"""


@query("text_knn", f"""
WITH dv AS MATERIALIZED {_vectors_sql('doc_id', 'documents')}, bv AS MATERIALIZED {_vectors_sql('item_id', 'benchmark')},
p AS (SELECT bv.item_id AS qid, CAST(substr(d.source, 4) AS INTEGER) AS source_id, dv.doc_id AS vec_id,
             list_inner_product(bv.v, dv.v) AS score FROM bv CROSS JOIN dv JOIN documents d ON d.doc_id = dv.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY score DESC, vec_id) AS lr FROM p)
SELECT qid, source_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM t WHERE lr <= 5) WHERE rank <= 5""")
def text_knn(spark, d):
    """Encode every benchmark question and every document (whole texts), search
    all document sources, keep 5 per source and merge to 5 per question."""
    docs = fx.read(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("source_id"), "text")
    docs = store(_whole(hashed_bow_vectors(docs, ["vec_id", "source_id"], "text", WIDTH)), "text-vectors")
    bench = fx.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    qs = _whole(hashed_bow_vectors(bench, ["qid"], "text", WIDTH)).withColumnRenamed("v", "qv")
    sources = docs.select("source_id").distinct()
    hits = retrieve.knn_arrow(routing.route_all(qs, sources), docs, 5)
    return rerank.merge_desc(hits, 5).select("qid", "source_id", "vec_id", "score", "rank")


class HashedModel:
    """The hashed bag of words as a model over batches of texts, in whole multiples of 1/1024."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        import hashlib
        import re
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for token in re.split(r"\W+", text.lower()):
                if token:
                    h = int(hashlib.md5(token.encode()).hexdigest()[:4], 16)
                    row[(h >> 4) % self.width] += 1 if h % 2 else -1
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.floor(out / np.where(size > 0, size, 1.0) * 1024 + 0.5)


#: Encoder -> width; no source uses the last one.
ENCODER_WIDTHS = {"small": 16, "medium": 32, "large": 64, "unused": 0}
_ENCODER_OF = [("src0", "small"), ("src1", "large"), ("src2", "medium"), ("src3", "large"), ("src4", "small")]


def _load(width: int):
    def load():
        if not width:
            raise RuntimeError("this model is never to be loaded")
        return HashedModel(width)
    return load


@query("encode_per_encoder", " UNION ALL ".join(
    f"SELECT item_id AS qid, '{name}' AS encoder, CAST(len(v) AS INTEGER) AS width, list_sum(v) AS total, "
    f"list_inner_product(v, list_transform(range(1, {w} + 1), lambda i: CAST(i AS DOUBLE))) AS weighted FROM {_vectors_sql('item_id', 'benchmark', w)} t"
    for name, w in ENCODER_WIDTHS.items() if w))
def encode_per_encoder(spark, d):
    """Each question encoded once by each model that some source uses: five sources, three models of different widths."""
    questions = fx.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    sources = spark.createDataFrame(_ENCODER_OF, "source string, encoder string")
    encoders = {name: model_encoder(_load(w)) for name, w in ENCODER_WIDTHS.items()}
    v = encode_once_per_encoder(questions, sources, "text", encoders)
    total = F.aggregate("qv", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("qv", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("qid", "encoder", F.size("qv").alias("width"), total.alias("total"), weighted.alias("weighted"))
