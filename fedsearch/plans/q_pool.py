"""Catalogue: masked pooling of ordered vectors.

Group = ``label`` of ``embeddings``; position = rank of ``vec_id`` inside the
label (0-based); mask = 0 for every ninth vector id (padding stand-in).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.operators import pooling as P
from fedsearch.operators.positions import group_position
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

_TOKENS_SQL = """
WITH t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                  CASE WHEN vec_id % 9 = 0 THEN 0 ELSE 1 END AS mask, v FROM emb),
c AS (SELECT label, pos, mask, CAST(mask AS DOUBLE) AS m, unnest(v) AS x,
             CAST(unnest(range(len(v))) AS INTEGER) AS dim FROM t)
"""

_VALUE_SQL = {
    "cls": "arg_min(x, pos)",
    "max": "max(CASE WHEN m > 0 THEN x ELSE -1e9 END)",
    "mean": "sum(x * m) / greatest(sum(m), 1e-9)",
    "mean_sqrt": "sum(x * m) / sqrt(greatest(sum(m), 1e-9))",
    "weighted": "sum(x * m * (pos + 1)) / greatest(sum(m * (pos + 1)), 1e-9)",
}

_LAST_SQL = """,
idx AS (SELECT label, greatest(coalesce(min(CASE WHEN mask = 0 THEN pos END), 0) - 1, 0) AS i
        FROM t GROUP BY label)
SELECT c.label, c.dim, round(sum(c.x * c.m), 6) AS value
FROM c JOIN idx ON idx.label = c.label AND c.pos = idx.i GROUP BY c.label, c.dim"""


def tokens(spark, d):
    emb = fx.embeddings(spark, d)
    t = group_position(emb, ["label"], [F.col("vec_id")], "p1")
    return t.select("label", (F.col("p1") - 1).alias("pos"),
                    F.when(F.col("vec_id") % 9 == 0, 0).otherwise(1).alias("mask"),
                    F.col("v").alias("vec"))


def _register(mode: str):
    if mode == "last":
        sql = _TOKENS_SQL + _LAST_SQL
    else:
        sql = _TOKENS_SQL + f"SELECT label, dim, round({_VALUE_SQL[mode]}, 6) AS value FROM c GROUP BY label, dim"

    @query(f"pool_{mode}", sql)
    def fn(spark, d):
        p = P.pool(tokens(spark, d), ["label"], mode)
        return p.select("label", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))
    fn.__doc__ = f"{mode} pooling of each label's vectors."
    return fn


for _m in P.MODES:
    _register(_m)
