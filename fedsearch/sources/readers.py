"""Readers for the reference's input formats (survey 2.A).

Every reader declares its schema; nothing is inferred. Positions that carry
meaning (file order, line numbers, places in a JSON list) are fixed at ingest
from offsets by split (``numbering``): no text is shuffled to be numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedsearch.functions.text import py_strip
from fedsearch.operators.positions import global_position
from fedsearch.sources.numbering import item_parts, json_items, numbered_lines, with_keys


def _file_order(df: DataFrame) -> DataFrame:
    """An order key ``_o`` that follows the input inside a file: the split's
    start, then the read order in it.

    Splits are packed into tasks by size, not in file order, so the id that
    grows with the task says nothing across splits; inside one split, which
    one task reads from front to end, it follows the lines.
    """
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "_o", F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")))


# ---- A1 qrels ---------------------------------------------------------------

def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, iter, docid, rel per line, whitespace separated; ``ord`` = file order.

    Malformed lines are kept with a ``reject_reason`` instead of failing.
    """
    raw = numbered_lines(spark.read.text(path), "_place", "all", keep=F.length(py_strip("value")) > 0)
    f = F.split(py_strip("value"), r"(?U)[\s\x1c-\x1f]+")
    out = raw.select(
        F.try_element_at(f, F.lit(1)).alias("qid"), F.try_element_at(f, F.lit(3)).alias("doc_id"),
        F.try_element_at(f, F.lit(4)).alias("rel_text"), F.size(f).alias("_n"), (F.col("_place") + 1).alias("ord"))
    out = out.withColumn("rel", F.expr("try_cast(rel_text AS INT)")) \
        .withColumn("reject_reason", F.when(F.col("_n") != 4, "expected 4 fields")
                    .when(F.col("rel").isNull(), "relevance not an integer"))
    return out.select("qid", "doc_id", "rel", "ord", "reject_reason")


# ---- A2-A4 questions ------------------------------------------------------------

def read_questions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line: ``_id`` (string or number) and ``text``; no options."""
    df = spark.read.schema("_id string, text string").json(path)
    return df.select(F.col("_id").alias("query_id"), F.col("text").alias("question"),
                     F.array().cast("array<string>").alias("options"),
                     F.lit(None).cast("string").alias("answer"))


BANKS_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
    T.StructField("answer", T.StringType()),
])))


def read_question_banks_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object bank -> question id -> record; options (letter -> text)
    become an array in letter order."""
    raw = spark.read.text(path, wholetext=True)
    banks = raw.select(F.explode(F.from_json("value", BANKS_TYPE)).alias("bank", "qs"))
    qs = banks.select("bank", F.explode("qs").alias("query_id", "r"))
    opts = F.array_sort(F.map_entries("r.options"))
    return qs.select("bank", "query_id", F.col("r.question").alias("question"),
                     F.transform(opts, lambda e: e["value"]).alias("options"),
                     F.col("r.answer").alias("answer"))


def read_mmlu(df: DataFrame) -> DataFrame:
    """MMLU rows: the question id is the 0-based global row position, banked by subject.

    ``df`` is read from Parquet: rows are in the order of file paths, then of
    the rows in each file, which the files themselves record.
    """
    o = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    p = global_position(o, [F.col("_file"), F.col("_row")], "_pos")
    return p.select((F.col("_pos") - 1).cast("string").alias("query_id"),
                    F.col("subject").alias("bank"), "question",
                    F.col("choices").alias("options"),
                    F.char(F.lit(65) + F.col("answer")).alias("answer"))


# ---- A5-A8 corpora and vector ids ---------------------------------------------

def read_corpus_jsonl(spark: SparkSession, path: str, source_id: int | None = None) -> DataFrame:
    """Documents keyed by ``_id``; a repeated id keeps its last line."""
    df = _file_order(spark.read.schema("_id string, title string, text string").json(path))
    last = df.groupBy("_id").agg(F.max_by(F.struct("title", "text"), F.struct("_file", "_o")).alias("d"))
    out = last.select(F.col("_id").alias("doc_id"), "d.title", "d.text")
    return out if source_id is None else out.withColumn("source_id", F.lit(source_id))


def _scope(folder: bool) -> str:
    return "folder" if folder else "file"


def read_chunks(spark: SparkSession, path: str, file_pattern: str = r"([^/]+)\.jsonl$", folder: bool = False) -> DataFrame:
    """Raw chunk lines keyed by (file name, 0-based line); parse only survivors.

    ``folder``, here and below: each folder is one file, cut into numbered parts.
    """
    lines = numbered_lines(spark.read.text(path), "line", _scope(folder))
    stem = F.regexp_extract("_file", file_pattern, 1)
    return lines.select(stem.alias("file"), F.col("line").cast("bigint").alias("line"),
                        F.col("value").alias("raw"))


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """``{title, content}`` from the raw lines (call after joining to the winners)."""
    j = F.from_json("raw", "title string, content string")
    return chunks.withColumn("title", j["title"]).withColumn("text", j["content"]).drop("raw")


def read_parallel_lines(spark: SparkSession, titles_path: str, texts_path: str,
                        cluster_pattern: str = r"/([^/]+)/[^/]+$", folder: bool = False) -> DataFrame:
    """Two line-aligned files per cluster, zipped by line number."""
    def numbered(path, col):
        n = numbered_lines(spark.read.text(path), "line", _scope(folder))
        return n.select(F.regexp_extract("_file", cluster_pattern, 1).alias("cluster"),
                        "line", F.col("value").alias(col))
    return numbered(titles_path, "title").join(numbered(texts_path, "text"), ["cluster", "line"])


def read_vector_ids_jsonl(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """Line = vector position; each line a ``{source, index}`` key."""
    n = numbered_lines(spark.read.text(path), "line", _scope(folder))
    j = F.from_json("value", "source string, index bigint")
    return n.select(F.col("line").cast("bigint").alias("pos"), j["source"].alias("file"),
                    j["index"].alias("line_in_file"))


def read_vector_ids_array(spark: SparkSession, path: str, source_re: str | None = None, folder: bool = False) -> DataFrame:
    """One JSON array of ids per source; array position = vector position.

    The array is read in splits, whatever its length. ``source_re`` takes the
    source's number from the path of its file.
    """
    items = item_parts(json_items(spark, path, folder)).where("has_scalar")
    own = [] if source_re is None else [F.regexp_extract("file", source_re, 1).cast("int").alias("source_id")]
    return items.select(*own, F.col("place").alias("pos"), F.col("scalar").alias("doc_id"))


def read_id_lines(spark: SparkSession, path: str, source_re: str | None = None) -> DataFrame:
    """An id list of any length: a line ``{pos, id}`` per id, in any number of files -> ([source_id], pos, id)."""
    j = F.from_json("value", "pos bigint, id string")
    own = [] if source_re is None else [
        F.regexp_extract(F.col("_metadata.file_path"), source_re, 1).cast("int").alias("source_id")]
    return spark.read.text(path).select(*own, j["pos"].alias("pos"), j["id"].alias("id"))


# ---- A9-A16 router inputs ------------------------------------------------------

STATS_STRUCT = "struct<centroid: array<double>, num_documents: bigint, density: double>"


def read_source_stats(spark: SparkSession, path: str, as_list: bool = False) -> DataFrame:
    """Centroid, document count and density per source: an object keyed by
    source, or a list whose position is the cluster id."""
    raw = spark.read.text(path, wholetext=True)
    if as_list:
        e = raw.select(F.posexplode(F.from_json("value", f"array<{STATS_STRUCT}>")).alias("source_id", "s"))
        e = e.withColumn("source", F.col("source_id").cast("string"))
    else:
        e = raw.select(F.explode(F.from_json("value", f"map<string, {STATS_STRUCT}>")).alias("source", "s"))
    return e.select("source", "s.centroid", "s.num_documents", "s.density")


def _small_files(df: DataFrame) -> DataFrame:
    """A scan of many small files in at most four tasks a core: a task reads many files, one after the other."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def read_cached_hits(spark: SparkSession, texts_glob: str, scores_glob: str, k: int,
                     qid_re: str = r"top_\d+_(.+)_(?:texts\.json|scores\.txt)$") -> DataFrame:
    """Per question: a JSON list of documents and one score per line, zipped, first k. Both files hold as many
    values as a question has hits."""
    def files(glob, values):
        raw = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), qid_re, 1).alias("query_id"), "value")
        return _small_files(raw).select("query_id", F.posexplode(F.slice(values, 1, k)).alias("local_rank", "x"))

    docs = files(texts_glob, F.from_json("value", "array<string>")).withColumnRenamed("x", "doc")
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    scores = files(scores_glob, lines).withColumn("score", py_strip("x").cast("double")).drop("x")
    return docs.join(scores, ["query_id", "local_rank"])


def read_query_vecs(spark: SparkSession, path: str) -> DataFrame:
    """One ``.npy`` per question -> (query_id, vec ARRAY<FLOAT>); decoding runs in
    Arrow batches on the executors."""
    import io

    import numpy as np
    import pyarrow as pa

    def decode(batches):
        for b in batches:
            vecs = [np.load(io.BytesIO(x)).astype(np.float32).ravel() for x in b.column("content").to_pylist()]
            yield pa.record_batch({"query_id": b.column("query_id"), "vec": pa.array(vecs, pa.list_(pa.float32()))})
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return _small_files(raw.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("query_id"), "content")).mapInArrow(
        decode, "query_id string, vec array<float>")


def read_source_labels(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """``{qid: [source, ...]}`` -> one (query_id, source) row per relevant source, read in splits."""
    ids = with_keys(item_parts(json_items(spark, path, folder)))
    return ids.select(F.col("inner").alias("query_id"), F.col("scalar").alias("source")).distinct()


def read_cluster_labels(spark: SparkSession, path: str,
                        qid_re: str = r"(question_\d+)_cluster_ids\.txt$") -> DataFrame:
    """One file per question, digit lines = retrieved clusters, as a set."""
    v = py_strip("value")
    raw = _small_files(spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), qid_re, 1).alias("query_id"), "value"))
    return raw.where(v.rlike("^[0-9]+$")).select("query_id", v.cast("int").alias("source_id")).distinct()


def read_question_order(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """JSON array of ids fixing the run order -> (query_id, pos 1..), read in splits."""
    items = item_parts(json_items(spark, path, folder)).where("has_scalar")
    return items.select(F.col("scalar").alias("query_id"), (F.col("place") + 1).alias("pos"))


def read_split_manifest(spark: SparkSession, path: str, by_bank: bool = False, folder: bool = False) -> DataFrame:
    """train/val/test id lists -> (bank, query_id, split), read in splits; medrag nests them per bank."""
    ids = with_keys(item_parts(json_items(spark, path, folder))).where(F.col("inner").isin("train", "val", "test"))
    bank = F.col("outer") if by_bank else F.lit(None).cast("string")
    return ids.select(bank.alias("bank"), F.col("scalar").alias("query_id"), F.col("inner").alias("split"))


def read_routing_examples(spark: SparkSession, path: str) -> DataFrame:
    """Stored examples (qid, bank, source_id, features, label, split) in parquet."""
    return spark.read.schema("qid string, bank string, source_id int, features array<double>, "
                             "label int, split string").parquet(path)


# ---- A17 result logs --------------------------------------------------------------

QUESTION_LOG_SCHEMA = T.StructType([
    T.StructField("benchmark", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("question_id", T.StringType()),
    T.StructField("correct", T.IntegerType()), T.StructField("data_sources", T.StringType()),
    T.StructField("num_data_sources", T.IntegerType()), T.StructField("selection_time", T.DoubleType()),
    T.StructField("embedding_time", T.DoubleType()), T.StructField("doc_select_time", T.DoubleType()),
    T.StructField("generate_time", T.DoubleType()), T.StructField("e2e_time", T.DoubleType()),
    T.StructField("docs_tokens", T.IntegerType()),
])
SOURCE_LOG_SCHEMA = T.StructType([
    T.StructField("benchmark", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("question_id", T.StringType()), T.StructField("data_source", T.StringType()),
    T.StructField("duration", T.DoubleType()), T.StructField("msg_size", T.LongType()),
])


def read_logs(spark: SparkSession, path: str, kind: str = "question") -> DataFrame:
    """Result CSVs with a header; ``-1`` generate time (timeout) becomes NULL + status."""
    schema = QUESTION_LOG_SCHEMA if kind == "question" else SOURCE_LOG_SCHEMA
    df = spark.read.csv(path, header=True, schema=schema)
    if kind == "question":
        df = df.withColumn("status", F.when(F.col("generate_time") == -1, "timeout").otherwise("ok")) \
               .withColumn("generate_time", F.when(F.col("generate_time") == -1, None)
                           .otherwise(F.col("generate_time")))
    return df
