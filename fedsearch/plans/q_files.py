"""Catalogue: the input and output files.

Each query writes the file form of a given table under the session's
``spark.checkpoint.dir``, reads it back with the reader under test and returns
what came back; the SQL states it from the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query
from fedsearch.session import scratch_path
from fedsearch.sources import readers as R
from fedsearch.sources import sinks as S


def _lines(df: DataFrame, path: str, *order) -> str:
    """Text lines (``value``) in ``order`` over as many files as the session's partitions."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def _parts_per(df: DataFrame, path: str, key: str, *order) -> str:
    """A folder ``key=...`` of numbered text files per ``key``, their lines in ``order``: a large key is many tasks."""
    (df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, "value")
       .write.partitionBy(key).text(path))
    return path


@query("read_qrels", "SELECT CAST(qid AS VARCHAR) AS qid, CAST(vec_id AS VARCHAR) AS doc_id, rel, "
       "row_number() OVER (ORDER BY q.qid, ord) AS ord FROM qrels q")
def read_qrels(spark, d):
    """Judgement lines, numbered in file order over several files (A1)."""
    value = F.concat_ws(" ", "qid", F.lit("0"), "vec_id", "rel")
    path = _lines(fx.qrels(spark, d).withColumn("value", value), scratch_path(spark, "qrels"), "qid", "ord")
    return R.read_qrels(spark, path).where("reject_reason is null").select("qid", "doc_id", "rel", "ord")


@query("read_questions", "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS question, 0 AS n_options FROM benchmark")
def read_questions(spark, d):
    """Questions as JSON lines (A2)."""
    path = scratch_path(spark, "questions")
    fx.read(spark, d, "benchmark").select(F.col("item_id").alias("_id"), "text").write.json(path)
    return R.read_questions_jsonl(spark, path).select("query_id", "question", F.size("options").alias("n_options"))


@query("read_banks", """
SELECT 'bank' || (item_id % 4) AS bank, CAST(item_id AS VARCHAR) AS query_id, text AS question,
       'one ' || item_id || '|two' AS options, 'B' AS answer FROM benchmark""")
def read_banks(spark, d):
    """Question banks, one JSON object per bank (A3)."""
    path = scratch_path(spark, "banks")
    b = fx.read(spark, d, "benchmark").select(
        F.concat(F.lit("bank"), F.col("item_id") % 4).alias("bank"), F.col("item_id").cast("string").alias("id"),
        F.struct(F.col("text").alias("question"),
                 F.create_map(F.lit("B"), F.lit("two"), F.lit("A"), F.concat(F.lit("one "), "item_id")).alias("options"),
                 F.lit("B").alias("answer")).alias("r"))
    one = b.groupBy("bank").agg(F.map_from_entries(F.collect_list(F.struct("id", "r"))).alias("m"))
    one.select("bank", F.to_json(F.create_map("bank", "m")).alias("value")).write.partitionBy("bank").text(path)
    back = R.read_question_banks_json(spark, path)
    return back.select("bank", "query_id", "question", F.array_join("options", "|").alias("options"), "answer")


@query("read_mmlu", """
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR) AS query_id, 's' || (item_id % 3) AS bank,
       text AS question, chr(CAST(65 + item_id % 4 AS INTEGER)) AS answer FROM benchmark""")
def read_mmlu(spark, d):
    """Exam rows whose id is their place over several files (A4)."""
    path = scratch_path(spark, "mmlu")
    b = fx.read(spark, d, "benchmark")
    (b.repartitionByRange("item_id").sortWithinPartitions("item_id").select(
        F.concat(F.lit("s"), F.col("item_id") % 3).alias("subject"), F.col("text").alias("question"),
        F.array(*[F.lit(x) for x in "wxyz"]).alias("choices"), (F.col("item_id") % 4).cast("int").alias("answer"))
     .write.parquet(path))
    return R.read_mmlu(spark.read.parquet(path)).select("query_id", "bank", "question", "answer")


@query("read_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, text FROM documents")
def read_corpus(spark, d):
    """Corpus lines; every third id has an older line before (A5)."""
    docs = fx.read(spark, d, "documents").select("doc_id", "source", "text")
    old = docs.where("doc_id % 3 = 0").withColumn("text", F.lit("old")).withColumn("v", F.lit(0))
    value = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text"))
    every = docs.withColumn("v", F.lit(1)).unionByName(old).withColumn("value", value)
    return R.read_corpus_jsonl(spark, _lines(every, scratch_path(spark, "corpus"), "v", "doc_id"))


@query("read_chunks", """
SELECT lang AS file, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line, source AS title, text FROM documents""")
def read_chunks(spark, d):
    """Chunk lines keyed by file and line number."""
    value = F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content")))
    path = _parts_per(fx.read(spark, d, "documents").withColumn("value", value), scratch_path(spark, "chunks"), "lang", "doc_id")
    return R.parse_chunks(R.read_chunks(spark, path, r"/lang=([^/]+)/", folder=True))


@query("read_parallel_lines", """
SELECT lang AS cluster, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line, source || ' ' || doc_id AS title,
       translate(text, chr(10) || chr(13), '  ') AS text FROM documents""")
def read_parallel_lines(spark, d):
    """Two line-aligned files per cluster, zipped by line number."""
    docs, root = fx.read(spark, d, "documents"), scratch_path(spark, "lines")
    titles = docs.withColumn("value", F.concat_ws(" ", "source", "doc_id"))
    texts = docs.withColumn("value", F.translate("text", "\n\r", "  "))
    back = R.read_parallel_lines(spark, _parts_per(titles, f"{root}/titles", "lang", "doc_id"),
                                 _parts_per(texts, f"{root}/texts", "lang", "doc_id"), r"/lang=([^/]+)/", folder=True)
    return back.select("cluster", F.col("line").cast("bigint").alias("line"), "title", "text")


@query("read_vector_ids", """
SELECT row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, CAST(label AS VARCHAR) AS file,
       vec_id AS line_in_file FROM embeddings""")
def read_vector_ids(spark, d):
    """Vector keys, line = position."""
    e = fx.read(spark, d, "embeddings").select("label", "vec_id")
    value = F.to_json(F.struct(F.col("label").cast("string").alias("source"), F.col("vec_id").alias("index")))
    path = _parts_per(e.withColumn("value", value), scratch_path(spark, "ids"), "label", "vec_id")
    return R.read_vector_ids_jsonl(spark, path, folder=True)


@query("position_to_doc", """
WITH p AS (SELECT source_id, vec_id, row_number() OVER (PARTITION BY source_id ORDER BY vec_id) - 1 AS pos FROM corpus)
SELECT h.qid, h.source_id, p.pos, 'd' || h.vec_id AS doc_id FROM hits h JOIN p ON p.source_id = h.source_id AND p.vec_id = h.vec_id""")
def position_to_doc(spark, d):
    """Vector positions of the hits turned into document keys by the id list of their source."""
    from fedsearch.operators.positions import group_position
    from fedsearch.operators.retrieve import positions_to_docs
    c = group_position(fx.corpus(spark, d).select("source_id", "vec_id"), ["source_id"], [F.col("vec_id")], "p")
    c = c.withColumn("pos", F.col("p") - 1)
    path = scratch_path(spark, "idlines")
    line = F.to_json(F.struct("pos", F.concat(F.lit("d"), "vec_id").alias("id")))
    c.select("source_id", line.alias("value")).write.partitionBy("source_id").text(path)
    keys = R.read_id_lines(spark, path, r"/source_id=([0-9]+)/").withColumnRenamed("id", "doc_id")
    hits = fx.hits(spark, d).select("qid", "source_id", "vec_id").join(c.select("source_id", "vec_id", "pos"), ["source_id", "vec_id"])
    return positions_to_docs(hits.select("qid", "source_id", "pos"), keys).select("qid", "source_id", "pos", "doc_id")


@query("read_source_stats", """
SELECT CAST(source_id AS VARCHAR) AS source, num_documents, round(density, 6) AS density,
       round(list_sum(centroid), 6) AS centroid_sum FROM sstats""")
def read_source_stats(spark, d):
    """Statistics file of the sources."""
    s = fx.stats(spark, d).select(F.col("source_id").cast("string").alias("k"),
                                  F.struct("centroid", "num_documents", "density").alias("v"))
    path = scratch_path(spark, "stats")
    s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(path)
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return R.read_source_stats(spark, path).select("source", "num_documents", F.round("density", 6).alias("density"),
                                                   F.round(total, 6).alias("centroid_sum"))


@query("read_cached_hits", """
SELECT CAST(qid AS VARCHAR) AS query_id, CAST(rank - 1 AS INTEGER) AS local_rank, 'd' || vec_id AS doc, round(score, 6) AS score
FROM gtop WHERE rank <= 7""")
def read_cached_hits(spark, d):
    """A list of documents and a file of scores per question, zipped, first 7 (A10)."""
    root, g = scratch_path(spark, "cached"), fx.gtop(spark, d)
    top = g.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("a"))  # 20 hits a question
    docs = F.to_json(F.transform("a", lambda x: F.concat(F.lit("d"), x["vec_id"])))
    scores = F.concat(F.array_join(F.transform("a", lambda x: x["score"].cast("string")), "\n"), F.lit("\n"))
    for kind, content in (("texts.json", docs), ("scores.txt", scores)):
        S.write_files(top.select(F.concat(F.lit("top_20_"), "qid", F.lit(f"_{kind}")).alias("name"), content.alias("content")), root)
    back = R.read_cached_hits(spark, f"{root}/*_texts.json", f"{root}/*_scores.txt", 7)
    return back.select("query_id", F.col("local_rank").cast("int").alias("local_rank"), "doc", F.round("score", 6).alias("score"))


@query("read_query_vecs", """
SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(len(embedding) AS INTEGER) AS width,
       round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def read_query_vecs(spark, d):
    """One array file per question."""
    path = scratch_path(spark, "npy")
    q = fx.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vec"))
    S.write_query_vecs(q, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return R.read_query_vecs(spark, path).select("query_id", F.size("vec").alias("width"), F.round(total, 6).alias("total"))


@query("read_source_labels", "SELECT CAST(qid AS VARCHAR) AS query_id, CAST(source_id AS VARCHAR) AS source FROM source_labels")
def read_source_labels(spark, d):
    """Relevant sources per question, one JSON object."""
    from fedsearch.operators.positions import global_position
    one = fx.source_labels(spark, d).groupBy("qid").agg(F.sort_array(F.collect_list(F.col("source_id").cast("string"))).alias("s"))
    one = global_position(one, [F.col("qid")], "p").withColumn("n", one.agg(F.count(F.lit(1))).scalar())
    value = F.concat(F.when(F.col("p") == 1, "{").otherwise(""), F.lit('"'), F.col("qid").cast("string"), F.lit('": '), F.to_json("s"),
                     F.when(F.col("p") == F.col("n"), "}").otherwise(","))
    return R.read_source_labels(spark, _lines(one.withColumn("value", value), scratch_path(spark, "labels"), "p"), folder=True)


@query("read_cluster_labels", "SELECT CAST(qid AS VARCHAR) AS query_id, source_id FROM source_labels")
def read_cluster_labels(spark, d):
    """Cluster numbers per question, with blank and repeated lines."""
    path, own = scratch_path(spark, "clusters"), F.col("s")
    s = fx.source_labels(spark, d).groupBy("qid").agg(F.sort_array(F.collect_list(F.col("source_id").cast("string"))).alias("s"))
    lines = F.flatten(F.transform(own, lambda x: F.array(F.concat(F.lit(" "), x), x, F.lit("x"))))
    S.write_files(s.select(F.concat(F.lit("question_"), "qid", F.lit("_cluster_ids.txt")).alias("name"),
                           F.array_join(lines, "\n").alias("content")), path)
    return R.read_cluster_labels(spark, path, r"question_([0-9]+)_cluster_ids\.txt$")


def _array_lines(df: DataFrame, item, key: list[str], order, path: str) -> str:
    """A JSON array of ``item`` per ``key`` (all rows: no key), an element a line, as numbered part files of a folder."""
    from fedsearch.operators.positions import global_position, group_position
    if key:
        p = group_position(df, key, order, "_p")
    else:
        p = global_position(df, order, "_p").withColumn("group_size", df.agg(F.count(F.lit(1))).scalar())
    value = F.concat(F.when(F.col("_p") == 1, "[").otherwise(""), item, F.when(F.col("_p") == F.col("group_size"), "]").otherwise(","))
    rows = p.withColumn("value", value)
    return _parts_per(rows, path, key[0], "_p") if key else _lines(rows, path, "_p")


@query("read_question_order", """
SELECT CAST(item_id AS VARCHAR) AS query_id, row_number() OVER (ORDER BY (item_id * 7919) % 1009, item_id) AS pos FROM benchmark""")
def read_question_order(spark, d):
    """The saved run order, one JSON array."""
    item = F.col("item_id")
    path = _array_lines(fx.read(spark, d, "benchmark").select("item_id"), F.concat(F.lit('"'), item.cast("string"), F.lit('"')), [],
                        [(item * 7919) % 1009, item], scratch_path(spark, "order"))
    return R.read_question_order(spark, path, folder=True)


@query("read_vector_ids_array", """
SELECT CAST(source_id AS INTEGER) AS source_id, row_number() OVER (PARTITION BY source_id ORDER BY vec_id) - 1 AS pos,
       'd, "' || vec_id || '"' AS doc_id FROM corpus""")
def read_vector_ids_array(spark, d):
    """A JSON array of ids per source; ids hold commas and quotes."""
    c = fx.corpus(spark, d).select("source_id", "vec_id")
    name = F.to_json(F.array(F.concat(F.lit('d, "'), "vec_id", F.lit('"'))))
    path = _array_lines(c, F.substring(name, F.lit(2), F.length(name) - 2), ["source_id"], [F.col("vec_id")], scratch_path(spark, "idarray"))
    return R.read_vector_ids_array(spark, path, r"/source_id=([0-9]+)/", folder=True)


@query("read_split_manifest", """
SELECT 'b' || (qid // 10 % 4) AS bank, CAST(qid AS VARCHAR) AS query_id, split FROM split""")
def read_split_manifest(spark, d):
    """Split of each question, one JSON object of banks of id lists."""
    s = fx.split(spark, d).select(F.concat(F.lit("b"), (F.floor(F.col("qid") / 10) % 4)).alias("bank"), "qid", "split")
    path = S.write_split_manifest(s, scratch_path(spark, "manifest"))
    return R.read_split_manifest(spark, path, by_bank=True, folder=True)


@query("read_routing_examples", """
SELECT CAST(qid AS VARCHAR) AS qid, 'b' || (qid // 10 % 4) AS bank, source_id, CAST(len(features) AS INTEGER) AS width,
       round(list_sum(features), 6) AS total, label, split FROM examples""")
def read_routing_examples(spark, d):
    """Stored routing examples."""
    path = scratch_path(spark, "examples")
    fx.examples(spark, d).select(F.col("qid").cast("string").alias("qid"),
                                 F.concat(F.lit("b"), F.floor(F.col("qid") / 10) % 4).alias("bank"), "source_id",
                                 "features", "label", "split").write.parquet(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return R.read_routing_examples(spark, path).select("qid", "bank", "source_id", F.size("features").alias("width"),
                                                       F.round(total, 6).alias("total"), "label", "split")


def _question_log(spark, d):
    e = fx.read(spark, d, "events")
    v = F.col("value")
    return e.select(F.lit("B").alias("benchmark"), F.col("event_type").alias("dataset"), F.lit('m "x", y').alias("model"),
                    F.col("event_id").cast("string").alias("question_id"), (F.col("event_id") % 2).cast("int").alias("correct"),
                    F.lit("a:b").alias("data_sources"), F.lit(2).alias("num_data_sources"), v.alias("selection_time"),
                    v.alias("embedding_time"), v.alias("doc_select_time"), (v * 2).alias("generate_time"),
                    (v * 5).alias("e2e_time"), F.lit(7).alias("docs_tokens"))


@query("question_log", """
SELECT event_type AS dataset, CAST(event_id AS VARCHAR) AS question_id, CAST(event_id % 2 AS INTEGER) AS correct,
       CASE WHEN event_id % 5 = 0 THEN 'timeout' ELSE 'ok' END AS status,
       CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS generate_time, 'm "x", y' AS model FROM events""")
def question_log(spark, d):
    """Question log written as CSV, timeouts as -1, read back."""
    path = scratch_path(spark, "qlog")
    status = F.when(F.col("question_id").cast("long") % 5 == 0, "timeout").otherwise("ok")
    S.export_csv(_question_log(spark, d).withColumn("status", status), path)
    return R.read_logs(spark, path).select("dataset", "question_id", "correct", "status", "generate_time", "model")


@query("question_log_appends", """
SELECT 'all' AS routing, event_type AS dataset, CAST(event_id AS VARCHAR) AS question_id FROM events
UNION ALL SELECT 'none', event_type, CAST(event_id AS VARCHAR) FROM events""")
def question_log_appends(spark, d):
    """Two runs appended to one partitioned log (B1)."""
    path, log = scratch_path(spark, "qlogs"), _question_log(spark, d)
    for routing in ("all", "none"):
        S.write_question_log(log.withColumn("routing", F.lit(routing)), path)
    return spark.read.parquet(path).select("routing", "dataset", "question_id")


@query("source_log", """
SELECT dataset, CAST(question_id AS VARCHAR) AS question_id, source AS data_source, duration, CAST(100 AS BIGINT) AS msg_size,
       'all' AS routing FROM latency""")
def source_log(spark, d):
    """One row per question and source, duration and bytes (B2)."""
    path = scratch_path(spark, "slog")
    rows = fx.latency(spark, d).select(F.lit("B").alias("benchmark"), F.lit("all").alias("routing"), "dataset",
                                       F.col("question_id").cast("string").alias("question_id"),
                                       F.col("source").alias("data_source"), "duration", F.lit(100).cast("bigint").alias("msg_size"))
    S.write_source_log(rows, path)
    return spark.read.parquet(path).select("dataset", "question_id", "data_source", "duration", "msg_size", "routing")


@query("answers_resumed", "SELECT CAST(item_id AS VARCHAR) AS question_id, llm_output AS answer FROM answers")
def answers_resumed(spark, d):
    """A run that stops half-way and goes on: the second half is added; done ids come from both."""
    from fedsearch.operators import workflow as W
    path = scratch_path(spark, "answers")
    a = fx.answers(spark, d).select(F.col("item_id").cast("string").alias("question_id"), F.col("llm_output").alias("answer"))
    S.write_answers(a.where(F.col("question_id").cast("long") % 2 == 0), path)
    done = W.done_ids(spark.read.schema("question_id string, answer string").json(path), keys=["question_id"])
    S.write_answers(W.skip_done(a, done, ["question_id"]), path)
    return spark.read.schema("question_id string, answer string").json(path)


@query("top_docs", """
SELECT CAST(qid AS VARCHAR) AS question_id, CAST(i AS INTEGER) AS rank, CAST(v AS BIGINT) AS vec_id
FROM (SELECT qid, unnest(list(vec_id ORDER BY rank)) AS v, unnest(range(1, 1 + count(*))) AS i FROM gtop WHERE rank <= 5 GROUP BY qid)""")
def top_docs(spark, d):
    """The documents of each question in rank order, two runs added."""
    path = scratch_path(spark, "topdocs")
    g = fx.gtop(spark, d, 5).select(F.col("qid").cast("string").alias("question_id"), "rank", "vec_id")
    for half in (0, 1):
        S.write_top_docs(g.where(F.floor(F.col("question_id").cast("long") / 10) % 2 == half), path, ["vec_id"])
    back = spark.read.schema("question_id string, docs array<struct<rank: int, vec_id: bigint>>").json(path)
    return back.select("question_id", F.posexplode("docs").alias("i", "d")).select(
        "question_id", (F.col("i") + 1).alias("rank"), F.col("d.vec_id").alias("vec_id"))


@query("predictions", """
SELECT CAST(qid AS VARCHAR) AS query_id, array_to_string(list_sort(list(CAST(source_id AS VARCHAR))), ':') AS sources
FROM scored WHERE prob > 0.5 GROUP BY qid""")
def predictions(spark, d):
    """Predicted sources of each question, sorted."""
    path = scratch_path(spark, "predictions")
    p = fx.scored(spark, d).where("prob > 0.5").select(F.col("qid").cast("string").alias("query_id"),
                                                       F.col("source_id").cast("string").alias("source"))
    S.write_predictions(p, path)
    return spark.read.schema("query_id string, sources array<string>").json(path).select(
        "query_id", F.array_join("sources", ":").alias("sources"))


@query("upsert_metrics", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS ndcg FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def upsert_metrics(spark, d):
    """Known rows replaced, new ones added, written as a new version."""
    ids = fx.read(spark, d, "documents").select("doc_id")
    path = scratch_path(spark, "metrics")
    S.upsert_metrics(ids.where("doc_id % 3 = 0").withColumn("ndcg", F.lit(0.5)),
                     ids.where("doc_id % 2 = 0").withColumn("ndcg", F.lit(1.0)), "doc_id", path)
    return spark.read.parquet(path)


@query("upsert_last_run", """
WITH n AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS model_name, doc_id AS run, n_chars::DOUBLE AS value FROM documents),
l AS (SELECT model_name, max({'run': run, 'value': value}) AS last FROM n GROUP BY model_name)
SELECT model_name, last.run AS run, last.value AS value FROM l
UNION ALL
SELECT DISTINCT coalesce(lang, ''), 0::BIGINT, 0.0::DOUBLE FROM documents
WHERE coalesce(lang, '') NOT IN (SELECT model_name FROM n)""")
def upsert_last_run(spark, d):
    """Many runs of each model in one write: the last run of each stays."""
    docs = fx.read(spark, d, "documents")
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    new = docs.select(F.concat(source, F.lit("/"), lang).alias("model_name"), F.col("doc_id").alias("run"),
                      F.col("n_chars").cast("double").alias("value"))
    before = new.select("model_name", F.lit(0).cast("bigint").alias("run"), F.lit(0.0).alias("value"))
    old = before.unionByName(docs.select(lang.alias("model_name"), F.lit(0).cast("bigint").alias("run"),
                                         F.lit(0.0).alias("value"))).distinct()
    path = scratch_path(spark, "metrics-runs")
    S.upsert_metrics(old, new, "model_name", path, order="run")
    return spark.read.parquet(path)


@query("split_written_once", "SELECT qid, split FROM split")
def split_written_once(spark, d):
    """A saved split: written once, read by every later run."""
    path = scratch_path(spark, "once")
    S.write_once(fx.split(spark, d), path)
    return spark.read.parquet(path)
