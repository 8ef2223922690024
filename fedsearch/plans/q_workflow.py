"""Catalogue: run order, resume, shards, batches and request validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.operators import workflow as W
from fedsearch.plans import fixtures as fx
from fedsearch.plans.q_answers import JSON_PRED_SQL
from fedsearch.plans.registry import query

SHARDS = 3
BATCH = 4
_ORDER_SQL = "row_number() OVER (ORDER BY (item_id * 7919) % 1009, item_id)"


def _ordered_items(spark, d):
    b = fx.read(spark, d, "benchmark").select("item_id")
    return W.saved_order(b, [(F.col("item_id") * 7919) % 1009, F.col("item_id")])


@query("question_order", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 1009, doc_id) AS pos FROM labels)
SELECT d.doc_id, o.pos FROM documents d JOIN o ON o.doc_id = d.doc_id""")
def question_order(spark, d):
    """Saved order (from ``labels``) intersected with loaded items (``documents``)."""
    lab = fx.read(spark, d, "labels").select("doc_id")
    order = W.saved_order(lab, [(F.col("doc_id") * 7919) % 1009, F.col("doc_id")])
    docs = fx.read(spark, d, "documents").select("doc_id")
    return W.order_questions(order, docs, "doc_id").select("doc_id", "pos")


@query("resume_antijoin", """
SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.item_id)""")
def resume_antijoin(spark, d):
    """Questions not yet answered; the ``labels`` table plays the done log."""
    b = fx.read(spark, d, "benchmark").select("item_id")
    done = fx.read(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    return W.skip_done(b, done, ["item_id"])


@query("shard_select", f"""
SELECT item_id, pos, CAST((pos - 1) % {SHARDS} AS INTEGER) AS shard FROM (SELECT item_id, {_ORDER_SQL} AS pos FROM benchmark)""")
def shard_select(spark, d):
    """Every item with its shard: shard i takes every 3rd item from i in saved order."""
    return W.assign_shard(_ordered_items(spark, d), SHARDS).select("item_id", "pos", "shard")


@query("batch_assign", f"""
SELECT item_id, pos, CAST((pos - 1) // {BATCH} AS BIGINT) AS batch FROM (SELECT item_id, {_ORDER_SQL} AS pos FROM benchmark)""")
def batch_assign(spark, d):
    """Consecutive batches of 4 in saved order (H7)."""
    return W.assign_batches(_ordered_items(spark, d), BATCH).select("item_id", "pos", "batch")


_CHOICES_SQL = """CASE turn % 7 WHEN 0 THEN '["' || role || '"]' WHEN 1 THEN '[' || role WHEN 2 THEN ''
  WHEN 3 THEN '{"a": 1}' WHEN 4 THEN '"B"' WHEN 5 THEN '["' || role || '"]' END"""


@query("validate_queries", f"""
SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason AS reject_reason
FROM (SELECT conv_id, turn,
             CASE WHEN q IS NULL OR q = '' THEN 'empty query'
                  WHEN choices IS NULL OR choices = '' THEN 'missing choices'
                  WHEN id IS NULL OR id = '' THEN 'missing id'
                  WHEN NOT json_valid(choices) THEN 'choices not json' END AS reason
      FROM (SELECT conv_id, turn, {_CHOICES_SQL} AS choices,
                   CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE text END AS q,
                   CASE (conv_id + turn) % 4 WHEN 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS id FROM conversations))""")
def validate_queries(spark, d):
    """Reject requests without query, choices or id, or with choices that are no JSON."""
    c = fx.read(spark, d, "conversations")
    t, array = F.col("turn") % 7, F.concat(F.lit('["'), F.col("role"), F.lit('"]'))
    choices = (F.when(t.isin(0, 5), array).when(t == 1, F.concat(F.lit("["), F.col("role"))).when(t == 2, "")
               .when(t == 3, '{"a": 1}').when(t == 4, '"B"'))
    text = F.when(F.col("conv_id") % 5 == 0, "").when(F.col("conv_id") % 5 == 1, " ").otherwise(F.col("text"))
    ident = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "").otherwise(F.col("conv_id").cast("string"))
    r = W.validate_queries(c.select("conv_id", "turn", text.alias("query"), choices.alias("choices_json"),
                                    ident.alias("id")), qid="id")
    return r.select("conv_id", "turn", "status", "reject_reason")


MIN_EVENTS = 200


@query("min_group_latency", f"""
SELECT dataset, source, count(*) AS n FROM latency GROUP BY dataset, source HAVING count(*) >= {MIN_EVENTS}""")
def min_group_latency(spark, d):
    """Latency groups kept only when they hold enough measurements (E5)."""
    from fedsearch.operators.train import min_group_size
    lat = fx.latency(spark, d).withColumn("g", F.concat_ws("|", "dataset", "source"))
    kept = min_group_size(lat, "g", MIN_EVENTS)
    return kept.groupBy("dataset", "source").agg(F.count(F.lit(1)).alias("n"))


@query("existing_vectors", """
SELECT qid FROM q WHERE EXISTS (SELECT 1 FROM source_labels l WHERE l.qid = q.qid)
                    AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = q.qid)""")
def existing_vectors(spark, d):
    """Queries that have a vector, a relevance label and a stored document."""
    q = fx.queries(spark, d).select("qid")
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("qid"))
    return W.existing(q, fx.source_labels(spark, d), docs, key="qid")


@query("accuracy_selected_banks", """
SELECT bank, count(*) AS total, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
FROM (SELECT bank, (pred IN ('A', 'B', 'C', 'D') AND gold IN ('A', 'B', 'C', 'D') AND pred = gold) AS correct
      FROM (SELECT bank, gold, """ + JSON_PRED_SQL + """ AS pred
            FROM answers WHERE bank IN (1, 3)))
GROUP BY bank""")
def accuracy_selected_banks(spark, d):
    """Answers of a fixed set of banks only (E1, E2), graded and counted."""
    from fedsearch.functions import grade as G
    a = W.filter_values(fx.answers(spark, d), "bank", [1, 3])
    g = a.select("bank", G.grade_letter_json("llm_output", "gold").alias("correct"))
    return g.groupBy("bank").agg(F.count(F.lit(1)).alias("total"),
                                 F.sum(F.col("correct").cast("int")).cast("bigint").alias("n_correct"))
