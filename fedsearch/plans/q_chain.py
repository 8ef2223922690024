"""Catalogue: whole chains (route, search, merge, fetch, truncate, prompt), several encoders,
the router's forward pass, and the small operators that no other query uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.functions import text as X
from fedsearch.functions import vectors as V
from fedsearch.functions.hooks import answer_with, mlp_router_scores
from fedsearch.operators import metrics as M
from fedsearch.operators import prompts as P
from fedsearch.operators import rerank, retrieve, routing
from fedsearch.operators import train as T
from fedsearch.operators import workflow as W
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

BUDGET = 96

# ---- D5-D8: fetch, render, truncate, prompt -------------------------------------

_DOCS_SQL = """
m AS (SELECT qid, vec_id, rank FROM (
    SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM hits) WHERE rank <= 10),
j AS (SELECT m.qid, m.rank, d.text, CASE WHEN d.lang = 'en' THEN NULL ELSE d.source END AS title,
             row_number() OVER (PARTITION BY m.qid, d.text IS NULL ORDER BY m.rank) - 1 AS i
      FROM m LEFT JOIN documents d ON d.doc_id = m.vec_id)"""

_PIECE_SQL = {
    "numbered": ("'Document [' || i || '] (Title: ' || coalesce(title, 'Doc ' || i) || ') ' || text", "chr(10)"),
    "headed": ("'##### Document ' || (i + 1) || ' [' || coalesce(title, '') || '] #####' || chr(10) || text", "chr(10) || chr(10)"),
    "colon": ("'Document ' || (i + 1) || ' [' || coalesce(title, '') || ']: ' || text || chr(10)", "''"),
}


def _context_sql(layout: str) -> str:
    piece, sep = _PIECE_SQL[layout]
    return f"""WITH {_DOCS_SQL},
ctx AS (SELECT qid, coalesce(string_agg({piece}, {sep} ORDER BY rank) FILTER (WHERE text IS NOT NULL), '') AS context,
        CAST(count(text) AS INTEGER) AS n_docs, count_if(text IS NULL) AS n_missing FROM j GROUP BY qid)"""


def _merged_docs(spark, d):
    """Routed top 10 with their documents and titles (English ones have none)."""
    m = rerank.merge_desc(fx.hits(spark, d), 10).select("qid", "vec_id", "rank")
    docs = fx.read(spark, d, "documents").select(
        "doc_id", F.when(F.col("lang") != "en", F.col("source")).alias("title"), "text")
    return retrieve.fetch_docs(m, docs)


def _register_context(layout: str):
    @query(f"context_{layout}", _context_sql(layout) + " SELECT qid, context, n_docs, CAST(n_missing AS BIGINT) AS n_missing FROM ctx")
    def fn(spark, d):
        return P.render_context(_merged_docs(spark, d), layout)
    fn.__doc__ = f"Each query's documents with titles in the {layout} layout (D5)."


for _layout in ("headed", "colon"):
    _register_context(_layout)


_PROMPT_SQL = {
    "medrag": ("You answer medical multiple-choice questions from the supplied documents. Reason briefly, then reply as JSON "
               'with the keys "step_by_step_thinking" and "answer_choice".',
               """'Documents:' || chr(10) || c || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10)
  || 'Choices:' || chr(10) || 'choice A of ' || item_id || chr(10) || 'choice B of ' || item_id || chr(10) || 'choice C of ' || item_id
  || chr(10) || 'choice D of ' || item_id || chr(10) || chr(10) || 'Reply as JSON with "step_by_step_thinking" and "answer_choice":'"""),
    "feb4rag": ("You answer requests using only the supplied search results, citing them as [n].",
                "'Search results:' || chr(10) || c || chr(10) || chr(10) || 'Request:' || chr(10) || question"),
    "wikipedia": ("You answer multiple-choice questions. Use the passages when they help.",
                  """'Passages:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'A. choice A of ' || item_id
  || chr(10) || 'B. choice B of ' || item_id || chr(10) || 'C. choice C of ' || item_id || chr(10) || 'D. choice D of ' || item_id
  || chr(10) || chr(10) || 'End your reply with the phrase "The best answer is" and one letter.' || chr(10) || chr(10) || 'The best answer is'"""),
}
_LAYOUT = {"medrag": "numbered", "feb4rag": "numbered", "wikipedia": "headed"}


def _register_prompt(workload: str):
    system, user = _PROMPT_SQL[workload]

    @query(f"rag_prompt_{workload}", _context_sql(_LAYOUT[workload]) + f""",
t AS (SELECT qid, string_split_regex(trim(context, ' ' || chr(9) || chr(10) || chr(13)), '\\s+') AS t, context FROM ctx),
k AS (SELECT qid, CASE WHEN context = '' THEN '' ELSE array_to_string(list_slice(t, 1, {BUDGET}), ' ') END AS c,
             CAST(CASE WHEN context = '' THEN 0 ELSE least(len(t), {BUDGET}) END AS INTEGER) AS n_tokens FROM t),
b AS (SELECT item_id, text AS question, count(*) OVER () AS n FROM benchmark)
SELECT k.qid, k.n_tokens, '{system}' AS system, {user} AS user FROM k JOIN b ON b.item_id = (k.qid // 10) % b.n""")
    def fn(spark, d):
        ctx = P.truncate_context(P.render_context(_merged_docs(spark, d), _LAYOUT[workload]), BUDGET)
        items = fx.read(spark, d, "benchmark")
        n = items.agg(F.count(F.lit(1)).alias("n")).scalar()
        choices = F.transform(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: F.concat(F.lit("choice "), x, F.lit(" of "), "item_id"))
        b = items.select("item_id", F.col("text").alias("question"), choices.alias("options"))
        j = ctx.withColumn("item_id", F.floor(F.col("qid") / 10) % n).join(b, "item_id")
        return P.render_prompt(j, workload, context="truncated").select("qid", "n_tokens", "system", "user")
    fn.__doc__ = f"Route, search, merge, fetch, truncate to the budget and fill the {workload} prompt (D5-D8)."


for _workload in _PROMPT_SQL:
    _register_prompt(_workload)


@query("fetch_docs_text", """
SELECT h.qid, h.source_id, h.vec_id, h.local_rank, d.source AS title, d.text
FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id""")
def fetch_docs_text(spark, d):
    """Titles and whole texts of the winners; a missing document keeps a null row (F8)."""
    docs = fx.read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return retrieve.fetch_docs(fx.hits(spark, d).select("qid", "source_id", "vec_id", "local_rank"), docs)


# ---- several encoders: F2, G17, G18, padding -------------------------------------
# encoder e<i> sees a slice of the vectors: e0 all 64, e1 the first 32, e2 the last 48

_SLICES = {"e0": (1, 64), "e1": (1, 32), "e2": (17, 48)}
_SLICE_SQL = "CASE {s} % 3 WHEN 0 THEN {v} WHEN 1 THEN {v}[1:32] ELSE {v}[17:64] END"


def _source_encoders(spark, d):
    s = fx.sources(spark, d)
    return s.select("source_id", F.concat(F.lit("e"), F.col("source_id") % 3).alias("encoder"),
                    F.concat(F.lit("src"), "source_id").alias("source"))


def _encoded_queries(spark, d):
    q = fx.queries(spark, d).select("qid", "qv")
    return q.select("qid", F.explode(F.array(*[F.struct(F.lit(e).alias("encoder"), F.slice("qv", a, n).alias("qv"))
                                               for e, (a, n) in _SLICES.items()])).alias("x")).select("qid", "x.encoder", "x.qv")


@query("encoders_in_use", """
SELECT 'e' || (source_id % 3) AS encoder, array_to_string(list_sort(list('src' || source_id)), ':') AS sources,
       count(*) AS n_sources, CAST(CASE source_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 32 ELSE 48 END AS INTEGER) AS max_width
FROM seeds GROUP BY source_id % 3""")
def encoders_in_use(spark, d):
    """Each encoder with its sources and its vectors' width."""
    e = routing.distinct_encoders(_source_encoders(spark, d))
    w = M.max_width(_encoded_queries(spark, d), "qv", ["encoder"])
    return e.join(w, "encoder").select("encoder", X.join_sources("sources").alias("sources"), "n_sources", "max_width")


@query("mixed_encoders_search", f"""
WITH p AS (SELECT r.qid, c.source_id, c.vec_id,
                  list_inner_product({_SLICE_SQL.format(s='c.source_id', v='r.qv')}, {_SLICE_SQL.format(s='c.source_id', v='c.v')}) AS score
           FROM routed r JOIN corpus c ON c.source_id = r.source_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY score DESC, vec_id) AS lr FROM p)
SELECT qid, source_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM t WHERE lr <= 4) WHERE rank <= 6""")
def mixed_encoders_search(spark, d):
    """Each source searched with the query vector of its own encoder, results merged."""
    sources = _source_encoders(spark, d)
    pairs = routing.attach_encoder(fx.routed(spark, d).select("qid", "source_id"), sources, _encoded_queries(spark, d))
    own = F.when(F.col("source_id") % 3 == 0, F.col("v")).when(F.col("source_id") % 3 == 1, F.slice("v", 1, 32)).otherwise(
        F.slice("v", 17, 48))
    corpus = fx.corpus(spark, d).select("source_id", "vec_id", own.alias("v"))
    m = rerank.merge_desc(retrieve.knn_arrow(pairs.select("qid", "source_id", "qv"), corpus, 4), 6)
    return m.select("qid", "source_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("mixed_encoder_features", f"""
SELECT q.qid, s.source_id, 64 + 64 AS width,
       round(list_sum({_SLICE_SQL.format(s='s.source_id', v='q.qv')}) + list_sum({_SLICE_SQL.format(s='s.source_id', v='s.seed')}), 6) AS total
FROM q CROSS JOIN seeds s""")
def mixed_encoder_features(spark, d):
    """Router features over encoders of different width, padded to the widest."""
    pairs = routing.attach_encoder(routing.route_all(fx.queries(spark, d).select("qid"), fx.sources(spark, d)),
                                   _source_encoders(spark, d), _encoded_queries(spark, d))
    s = F.col("source_id") % 3
    cent = fx.seeds(fx.embeddings(spark, d)).select("source_id", F.when(s == 0, F.col("seed")).when(
        s == 1, F.slice("seed", 1, 32)).otherwise(F.slice("seed", 17, 48)).alias("centroid"))
    f = pairs.join(cent, "source_id").select("qid", "source_id", V.route_features(
        V.pad_vector("qv", 64), V.pad_vector("centroid", 64)).alias("f"))
    return f.select("qid", "source_id", F.size("f").alias("width"), F.round(V.vec_sum("f"), 6).alias("total"))


# ---- the router's forward pass: C10, M2 -------------------------------------------
# weights from a rule, the same in both engines: w(i, j) = ((7 i + 3 j) mod 11 - 5) / 10

_H1, _H2 = 8, 4


def _weights(width: int):
    import numpy as np

    def w(rows, cols):
        i, j = np.indices((rows, cols))
        return ((7 * i + 3 * j) % 11 - 5) / 10

    return {"fc1.w": w(_H1, width), "fc1.b": (np.arange(_H1) % 3 - 1) / 10, "ln1.g": 1 + (np.arange(_H1) % 2) / 10,
            "ln1.b": (np.arange(_H1) % 5 - 2) / 20, "fc2.w": w(_H2, _H1), "fc2.b": (np.arange(_H2) % 3 - 1) / 10,
            "ln2.g": 1 + (np.arange(_H2) % 2) / 10, "ln2.b": (np.arange(_H2) % 5 - 2) / 20, "fc3.w": w(1, _H2),
            "fc3.b": np.array([0.1])}


def _layer_sql(name: str, source: str, x: str, rows: int) -> str:
    """A linear layer, layer norm and ReLU as two CTEs."""
    return f"""
{name}l AS (SELECT qid, source_id, split, list_transform(range({rows}), lambda i:
    list_sum(list_transform(range(len({x})), lambda j: {x}[j + 1] * (((7 * i + 3 * j) % 11 - 5) / 10.0))) + (i % 3 - 1) / 10.0) AS z FROM {source}),
{name} AS (SELECT qid, source_id, split, list_transform(range({rows}), lambda i: greatest(0.0,
    (z[i + 1] - list_avg(z)) / sqrt(list_var_pop(z) + 1e-5) * (1 + (i % 2) / 10.0) + (i % 5 - 2) / 20.0)) AS h FROM {name}l)"""


@query("score_route", f"""WITH e0 AS (SELECT qid, source_id, split, features FROM examples), {_layer_sql('h1', 'e0', 'features', _H1)}, {_layer_sql('h2', 'h1', 'h', _H2)}
SELECT qid, source_id, round(p, 6) AS prob, p > 0.5 AS routed FROM (SELECT qid, source_id,
  1.0 / (1.0 + exp(-(list_sum(list_transform(range({_H2}), lambda j: h[j + 1] * (((3 * j) % 11 - 5) / 10.0))) + 0.1))) AS p FROM h2)""")
def score_route(spark, d):
    """Features through a two-layer network with given weights, then the strict threshold."""
    e = fx.examples(spark, d).select("qid", "source_id", "features")
    width = 64 + 64 + fx.N_SOURCES
    s = e.withColumn("p", mlp_router_scores(_weights(width))("features"))
    return s.select("qid", "source_id", F.round("p", 6).alias("prob"), (F.col("p") > 0.5).alias("routed"))


# ---- small operators ---------------------------------------------------------------

@query("attach_answers", """
SELECT d.doc_id, a.llm_output AS answer FROM documents d JOIN answers a ON a.item_id = d.doc_id""")
def attach_answers(spark, d):
    """Questions with their answer; one without is dropped."""
    a = fx.answers(spark, d).select(F.col("item_id").alias("doc_id"), F.col("llm_output").alias("answer"))
    return W.attach_answers(fx.read(spark, d, "documents").select("doc_id"), a, "doc_id")


@query("done_in_any_log", """
SELECT DISTINCT doc_id FROM labels UNION SELECT item_id FROM benchmark""")
def done_in_any_log(spark, d):
    """Ids of several logs together."""
    b = fx.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return W.done_ids(fx.read(spark, d, "labels"), b, keys=["doc_id"])


@query("train_without_validation", """
SELECT qid FROM split WHERE split <> 'test' EXCEPT SELECT qid FROM split WHERE split = 'val'""")
def train_without_validation(spark, d):
    """Training ids less validation ids."""
    s = fx.split(spark, d)
    return s.where("split <> 'test'").select("qid").subtract(s.where("split = 'val'").select("qid"))


@query("grade_without_gold", "SELECT item_id, true AS correct FROM answers")
def grade_without_gold(spark, d):
    """Answers without a gold answer count as correct (K3)."""
    from fedsearch.functions.grade import grade_none
    return fx.answers(spark, d).select("item_id", grade_none().alias("correct"))


@query("split_per_bank", """
SELECT bank, doc_id, CASE WHEN pos <= ceil(0.6 * n) THEN 'test' WHEN pos <= ceil(0.6 * n) + ceil(0.1 * (n - ceil(0.6 * n))) THEN 'val'
                          ELSE 'train' END AS split
FROM (SELECT lang AS bank, doc_id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 1009, doc_id) AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def split_per_bank(spark, d):
    """Every bank split by itself, sizes exact (H8)."""
    docs = fx.read(spark, d, "documents").select(F.col("lang").alias("bank"), "doc_id", "text")
    return T.group_split(docs, [(F.col("doc_id") * 7919) % 1009, F.col("doc_id")], 0.6, 0.1, ["bank"]).select("bank", "doc_id", "split")


@query("answer_prompts", "SELECT item_id AS qid, 'You asked: ' || text AS answer FROM benchmark")
def answer_prompts(spark, d):
    """An answerer run over prompts in batches (M5); this one repeats the prompt."""
    b = fx.read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("user"))
    return answer_with(b, lambda prompts: [f"You asked: {p}" for p in prompts])


@query("content_ids", """
SELECT conv_id, turn, sha256(role || chr(31) || coalesce(text, '')) AS id FROM conversations""")
def content_ids(spark, d):
    """Request ids from the content, the same on every run (J ids)."""
    return fx.read(spark, d, "conversations").select("conv_id", "turn", X.content_id("role", "text").alias("id"))


@query("ablated_without_one_hot", """
SELECT qid, source_id, CAST(len(features) - 10 AS INTEGER) AS width, round(list_sum(features[1:128]), 6) AS total FROM feats""")
def ablated_without_one_hot(spark, d):
    """Route features without the source id (C4)."""
    f = fx.feats(spark, d).select("qid", "source_id", V.route_features("qv", "centroid").alias("f"))
    return f.select("qid", "source_id", F.size("f").alias("width"), F.round(V.vec_sum("f"), 6).alias("total"))
