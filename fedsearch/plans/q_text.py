"""Catalogue: context packing, prompts, text projections and volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.functions import text as X
from fedsearch.functions.vectors import payload_bytes as payload_expr
from fedsearch.operators import metrics as M
from fedsearch.operators import prompts as P
from fedsearch.operators import rerank, retrieve
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query
from fedsearch.sources import dims

TOKEN_BUDGET = 64


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def merged_docs(spark, d):
    """Routed top 10 with their documents (left join, title unknown)."""
    m = rerank.merge_desc(fx.hits(spark, d), 10).select("qid", "vec_id", "rank")
    docs = fx.read(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), "text")
    return retrieve.fetch_docs(m, docs)


_CTX_SQL = """
WITH m AS (SELECT qid, vec_id, rank FROM (
    SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM hits)
  WHERE rank <= 10),
j AS (SELECT m.qid, m.rank, d.text,
             row_number() OVER (PARTITION BY m.qid, d.text IS NULL ORDER BY m.rank) - 1 AS i
      FROM m LEFT JOIN documents d ON d.doc_id = m.vec_id),
ctx AS (SELECT qid,
        coalesce(string_agg('Document [' || i || '] (Title: Doc ' || i || ') ' || text, chr(10) ORDER BY rank)
                 FILTER (WHERE text IS NOT NULL), '') AS context,
        CAST(count(text) AS INTEGER) AS n_docs, CAST(count_if(text IS NULL) AS BIGINT) AS n_missing
        FROM j GROUP BY qid)
"""


@query("render_context", _CTX_SQL + "SELECT qid, context, n_docs, n_missing FROM ctx")
def render_context(spark, d):
    """Each query's merged documents as one numbered context string."""
    return P.render_context(merged_docs(spark, d), "numbered")


@query("truncate_tokens", _CTX_SQL + f"""
, tok AS (SELECT qid, string_split_regex(regexp_replace(context, '^\\s+|\\s+$', '', 'g'), '\\s+') AS t FROM ctx)
SELECT qid, CAST(least(len(t), {TOKEN_BUDGET}) AS INTEGER) AS n_tokens, CAST(len(t) AS INTEGER) AS total_tokens,
       array_to_string(list_slice(t, 1, {TOKEN_BUDGET}), ' ') AS truncated
FROM tok""")
def truncate_tokens(spark, d):
    """Context cut to a token budget; kept and total token counts."""
    c = P.truncate_context(P.render_context(merged_docs(spark, d), "numbered"), TOKEN_BUDGET)
    return c.select("qid", "n_tokens", "total_tokens", "truncated")


def _options(item):
    return F.transform(F.sequence(F.lit(0), F.lit(3)),
                       lambda i: F.concat(F.lit("choice "), F.char(F.lit(65) + i), F.lit(" of item "),
                                          item.cast("string")))


_OPTS_SQL = "list_transform(range(4), lambda i: 'choice ' || chr(65 + CAST(i AS INTEGER)) || ' of item ' || CAST(item_id AS VARCHAR))"


def _sql_fill(template: str, slots: dict[str, str]) -> str:
    parts, pos = [], 0
    for m in P._SLOT.finditer(template):
        if m.start() > pos:
            parts.append(_sql_str(template[pos:m.start()]))
        parts.append(slots[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(_sql_str(template[pos:]))
    return " || ".join(parts)


_PROMPT_SQL = _CTX_SQL + """
, b AS (SELECT item_id, text AS question, """ + _OPTS_SQL + """ AS o FROM benchmark)
SELECT b.item_id, ctx.qid, """ + _sql_str(P.SYSTEM_PROMPTS["wikipedia"]) + """ AS system,
       """ + _sql_fill(P.USER_TEMPLATES["wikipedia"], {
    "context": "ctx.context", "question": "b.question", "a": "b.o[1]", "b": "b.o[2]", "c": "b.o[3]", "d": "b.o[4]"}) + """ AS user
FROM ctx JOIN b ON b.item_id = (ctx.qid // 10) % (SELECT count(*) FROM benchmark)"""


@query("render_prompt", _PROMPT_SQL)
def render_prompt(spark, d):
    """Multiple-choice prompt per benchmark item over its query's context."""
    ctx = P.render_context(merged_docs(spark, d), "numbered")
    items = fx.read(spark, d, "benchmark")
    b = items.select("item_id", F.col("text").alias("question"), _options(F.col("item_id")).alias("options"))
    n = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    j = ctx.withColumn("item_id", F.floor(F.col("qid") / 10) % n).join(b, "item_id")
    return P.render_prompt(j, "wikipedia").select("item_id", "qid", "system", "user")


@query("mc_query", f"""
SELECT item_id, text || chr(10) || array_to_string({_OPTS_SQL}, ' | ') AS query FROM benchmark""")
def mc_query(spark, d):
    """Question, newline, choices joined by ' | ' (D1)."""
    b = fx.read(spark, d, "benchmark")
    return b.select("item_id", X.format_mc_query("text", _options(F.col("item_id"))).alias("query"))


_TITLE_SQL = "CASE WHEN lang = 'en' THEN NULL ELSE source END"


def _docs_with_title(spark, d):
    docs = fx.read(spark, d, "documents")
    return docs.withColumn("title", F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("source")))


@query("passage_text", f"""
SELECT doc_id, regexp_replace(coalesce({_TITLE_SQL}, '') || ' ' || text, '^\\s+|\\s+$', '', 'g') AS passage
FROM documents""")
def passage_text(spark, d):
    """Title and text as one passage, stripped; a missing title reads '' (D2)."""
    return _docs_with_title(spark, d).select("doc_id", X.passage_text("title", "text").alias("passage"))


def _feb_encoders():
    names = dims.WORKLOAD_SOURCES["feb4rag"]
    return [dims.SOURCE_ENCODER["feb4rag"][n][0] for n in names]


@query("encoder_prefix", f"""
WITH e AS (SELECT ['e5-large', 'SGPT-5.8B-weightedmean-msmarco-specb-bitfit', 'UAE-Large-V1', 'all-mpnet-base-v2',
    'multilingual-e5-large', 'ember-v1', 'all-mpnet-base-v2', 'UAE-Large-V1', 'e5-base', 'UAE-Large-V1', 'UAE-Large-V1',
    'UAE-Large-V1', 'gte-base'] AS names),
items AS (
  SELECT 'passage' AS role, doc_id AS id, names[CAST(substr(source, 4) AS INTEGER) % 13 + 1] AS encoder,
         trim(coalesce({_TITLE_SQL}, '') || ' ' || text, ' ' || chr(9) || chr(10) || chr(13)) AS body
  FROM documents, e
  UNION ALL
  SELECT 'query', item_id, names[item_id % 13 + 1], text FROM benchmark, e)
SELECT role, id, encoder,
       CASE WHEN encoder LIKE '%e5-%' THEN CASE role WHEN 'query' THEN 'query: ' ELSE 'passage: ' END
            WHEN encoder LIKE 'UAE%' AND role = 'query' THEN 'Represent this sentence for searching relevant passages:'
            WHEN encoder LIKE 'SGPT%' THEN CASE role WHEN 'query' THEN '[SOS]' ELSE '{{SOS}}' END
            ELSE '' END || body AS input
FROM items""")
def encoder_prefix(spark, d):
    """Per-encoder role prefix on passages and queries (D3)."""
    enc = F.array(*[F.lit(e) for e in _feb_encoders()])
    docs = _docs_with_title(spark, d).select(
        F.lit("passage").alias("role"), F.col("doc_id").alias("id"),
        F.element_at(enc, (F.substring("source", 4, 10).cast("int") % 13 + 1)).alias("encoder"),
        X.passage_text("title", "text").alias("body"))
    qs = fx.read(spark, d, "benchmark").select(
        F.lit("query").alias("role"), F.col("item_id").alias("id"),
        F.element_at(enc, (F.col("item_id") % 13 + 1).cast("int")).alias("encoder"), F.col("text").alias("body"))
    j = docs.unionByName(qs).join(dims.dim_encoder_prefix(spark), ["encoder", "role"])
    return j.select("role", "id", "encoder", F.concat("prefix", "body").alias("input"))


@query("instruction_lookup", """
WITH b AS (SELECT item_id, text,
                  ['hkunlp/instructor-xl', 'hkunlp/instructor-large', 'hkunlp/instructor-base'][item_id % 3 + 1] AS model,
                  ['ClimateFEVER', 'FEVER', 'Touche2020', 'CQADupstackTexRetrieval', 'fiqa', 'trec-covid', 'nq'][item_id % 7 + 1] AS dataset,
                  CASE WHEN item_id % 2 = 0 THEN 'query' ELSE 'corpus' END AS role FROM benchmark)
SELECT item_id, model, dataset, role, dataset || ' ' || role || ' text: ' || text AS input FROM b""")
def instruction_lookup(spark, d):
    """(model, dataset, role) -> instruction, put before each text.

    Left join, then an unknown key raises, as the encoder would.
    """
    def pick(values, i):
        return F.element_at(F.array(*[F.lit(x) for x in values]), (i + 1).cast("int"))

    i = F.col("item_id")
    b = fx.read(spark, d, "benchmark").select(
        "item_id", "text", pick(["hkunlp/instructor-xl", "hkunlp/instructor-large", "hkunlp/instructor-base"], i % 3).alias("model"),
        pick(["ClimateFEVER", "FEVER", "Touche2020", "CQADupstackTexRetrieval", "fiqa", "trec-covid", "nq"], i % 7).alias("dataset"),
        F.when(i % 2 == 0, "query").otherwise("corpus").alias("role"))
    j = b.join(dims.dim_instructions(spark), ["model", "dataset", "role"], "left")
    checked = F.when(F.col("instruction").isNull(),
                     F.raise_error(F.concat_ws("/", F.lit("no instruction for"), "model", "dataset")))
    return j.select("item_id", "model", "dataset", "role",
                    F.concat(checked.otherwise(F.col("instruction")), F.col("text")).alias("input"))


@query("comm_volume", """
SELECT source, count(*) AS n_items, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def comm_volume(spark, d):
    """Documents and bytes per source."""
    docs = fx.read(spark, d, "documents")
    return M.comm_volume(docs, ["source"], F.octet_length("text"))


@query("payload_bytes", """
SELECT h.qid, h.source_id, count(*) AS n_docs,
       CAST(sum(strlen(to_json({'vec_id': h.vec_id, 'local_rank': h.local_rank,
                                'text': coalesce(d.text, '')}))) AS BIGINT) AS bytes
FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id GROUP BY h.qid, h.source_id""")
def payload_bytes(spark, d):
    """Bytes each source's JSON reply would carry, per routed pair (C11)."""
    docs = fx.read(spark, d, "documents").select("doc_id", "text")
    h = retrieve.fetch_docs(fx.hits(spark, d), docs).withColumn("text", F.coalesce("text", F.lit("")))
    return h.groupBy("qid", "source_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(payload_expr("vec_id", "local_rank", "text")).cast("bigint").alias("bytes"))
