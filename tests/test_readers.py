"""Readers and sinks on small files written by the tests (survey 2.A, 2.B)."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsearch.sources import readers as R
from fedsearch.sources import sinks as S
from fedsearch.sources.dims import dim_instructions, dim_sources


def test_qrels_order_and_rejects(spark, tmp_path):
    p = tmp_path / "qrels.txt"
    p.write_text("q1 0 d1 2\nq1 0 d2 1\nq2 0 d3 0\nbroken line\nq2 0 d4 x\n")
    df = R.read_qrels(spark, str(p)).orderBy("ord").collect()
    assert [r.doc_id for r in df] == ["d1", "d2", "d3", None, "d4"]
    assert [r.reject_reason for r in df][3:] == ["expected 4 fields", "relevance not an integer"]
    assert [r.ord for r in df] == [1, 2, 3, 4, 5]


def test_questions_and_banks(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"_id": 7, "text": "what?"}\n{"_id": "x1", "text": "why?"}\n')
    q = R.read_questions_jsonl(spark, str(tmp_path / "q.jsonl")).orderBy("query_id").collect()
    assert [r.query_id for r in q] == ["7", "x1"] and q[0].options == []
    banks = {"medqa": {"a1": {"question": "Q?", "options": {"B": "two", "A": "one"}, "answer": "B"}}}
    (tmp_path / "b.json").write_text(json.dumps(banks))
    b = R.read_question_banks_json(spark, str(tmp_path / "b.json")).collect()
    assert b[0].bank == "medqa" and b[0].options == ["one", "two"] and b[0].answer == "B"


def test_mmlu_ids_follow_the_files(spark, tmp_path):
    """A small first file and a large second one (as large as the real test split)."""
    for name, lo, hi in (("a", 0, 3), ("b", 3, 14_042)):
        rows = [("bio", f"q{i}", ["a", "b", "c", "d"], i % 4) for i in range(lo, hi)]
        (spark.createDataFrame(rows, "subject string, question string, choices array<string>, answer int").coalesce(1)
         .write.parquet(str(tmp_path / name)))
    out = R.read_mmlu(spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))).collect()
    assert len(out) == 14_042 and all(r.question == f"q{r.query_id}" for r in out)
    assert {r.question: r.answer for r in out}["q6"] == "C"


def test_line_numbers_at_size(spark, tmp_path):
    """20,000 lines over several splits of files of unequal size."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        d = tmp_path / "7"
        d.mkdir()
        n = 20_000
        (d / "titles.txt").write_text("".join(f"t{i}\n" for i in range(n)))
        (d / "texts.txt").write_text("".join(f"x{i} {'y' * (i % 50)}\n" for i in range(n)))
        pl = R.read_parallel_lines(spark, str(d / "titles.txt"), str(d / "texts.txt")).collect()
        assert len(pl) == n and all(r.title[1:] == r.text.split()[0][1:] == str(r.line) for r in pl)
        (tmp_path / "q.txt").write_text("".join(f"q{i} 0 d{i} 1\n" for i in range(n)))
        assert all(r.qid == f"q{r.ord - 1}" for r in R.read_qrels(spark, str(tmp_path / "q.txt")).collect())
        (tmp_path / "ids.jsonl").write_text("".join('{"source": "s", "index": %d}\n' % i for i in range(n)))
        assert all(r.pos == r.line_in_file for r in R.read_vector_ids_jsonl(spark, str(tmp_path / "ids.jsonl")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_corpus_last_one_wins_and_chunks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "d1", "text": "old"}\n{"_id": "d2", "title": "T", "text": "x"}\n'
                                      '{"_id": "d1", "text": "new"}\n')
    c = {r.doc_id: r.text for r in R.read_corpus_jsonl(spark, str(tmp_path / "c.jsonl")).collect()}
    assert c == {"d1": "new", "d2": "x"}
    (tmp_path / "pubmed.jsonl").write_text('{"title": "a", "content": "x"}\n{"title": "b", "content": "y"}\n')
    ch = R.parse_chunks(R.read_chunks(spark, str(tmp_path / "pubmed.jsonl"))).orderBy("line").collect()
    assert [(r.file, r.line, r.title) for r in ch] == [("pubmed", 0, "a"), ("pubmed", 1, "b")]


def test_parallel_lines_and_vector_ids(spark, tmp_path):
    d = tmp_path / "3"
    d.mkdir()
    (d / "titles.txt").write_text("t0\nt1\nt2\n")
    (d / "texts.txt").write_text("x0\nx1\nx2\n")
    pl = R.read_parallel_lines(spark, str(d / "titles.txt"), str(d / "texts.txt")).orderBy("line").collect()
    assert [(r.cluster, r.title, r.text) for r in pl] == [("3", "t0", "x0"), ("3", "t1", "x1"), ("3", "t2", "x2")]
    (tmp_path / "ids.jsonl").write_text('{"source": "pubmed", "index": 4}\n{"source": "wiki", "index": 0}\n')
    v = R.read_vector_ids_jsonl(spark, str(tmp_path / "ids.jsonl")).orderBy("pos").collect()
    assert [(r.pos, r.file, r.line_in_file) for r in v] == [(0, "pubmed", 4), (1, "wiki", 0)]
    (tmp_path / "ids.json").write_text('["a", "b", "c"]')
    a = R.read_vector_ids_array(spark, str(tmp_path / "ids.json")).orderBy("pos").collect()
    assert [r.doc_id for r in a] == ["a", "b", "c"]


def test_stats_labels_order_split(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"pubmed": {"centroid": [0.5, 1.0], "num_documents": 3, "density": 0.2}}))
    s = R.read_source_stats(spark, str(tmp_path / "s.json")).collect()[0]
    assert s.source == "pubmed" and s.centroid == [0.5, 1.0] and s.num_documents == 3
    (tmp_path / "l.json").write_text(json.dumps([{"centroid": [1.0], "num_documents": 1, "density": 0.0}] * 2))
    assert [r.source for r in R.read_source_stats(spark, str(tmp_path / "l.json"), as_list=True).collect()] == ["0", "1"]
    (tmp_path / "lab.json").write_text(json.dumps({"q1": ["pubmed", "wikipedia"], "q2": []}))
    assert R.read_source_labels(spark, str(tmp_path / "lab.json")).count() == 2
    (tmp_path / "o.json").write_text('["z", "a", "m"]')
    assert [r.query_id for r in R.read_question_order(spark, str(tmp_path / "o.json")).orderBy("pos").collect()] == ["z", "a", "m"]
    (tmp_path / "sp.json").write_text(json.dumps({"train": ["a"], "val": ["b"], "test": ["c", "d"]}))
    sp = {r.query_id: r.split for r in R.read_split_manifest(spark, str(tmp_path / "sp.json")).collect()}
    assert sp == {"a": "train", "b": "val", "c": "test", "d": "test"}


def test_cluster_labels_cached_hits_and_npy(spark, tmp_path):
    d = tmp_path / "cl"
    d.mkdir()
    (d / "question_3_cluster_ids.txt").write_text("1\n 4 \nx\n1\n")
    cl = sorted((r.query_id, r.source_id) for r in R.read_cluster_labels(spark, str(d)).collect())
    assert cl == [("question_3", 1), ("question_3", 4)]
    h = tmp_path / "hits"
    h.mkdir()
    (h / "top_32_q9_texts.json").write_text(json.dumps(["d0", "d1", "d2"]))
    (h / "top_32_q9_scores.txt").write_text("0.9\n0.5\n0.1\n")
    ch = R.read_cached_hits(spark, str(h / "*_texts.json"), str(h / "*_scores.txt"), 2).orderBy("local_rank").collect()
    assert [(r.query_id, r.doc, r.score) for r in ch] == [("q9", "d0", 0.9), ("q9", "d1", 0.5)]
    v = tmp_path / "vecs"
    v.mkdir()
    buf = io.BytesIO()
    np.save(buf, np.array([1.0, 2.0], dtype=np.float32))
    (v / "q5.npy").write_bytes(buf.getvalue())
    got = R.read_query_vecs(spark, str(v)).collect()
    assert got[0].query_id == "q5" and got[0].vec == [1.0, 2.0]


def test_logs_roundtrip_and_sinks(spark, tmp_path):
    rows = [("MIRAGE", "medqa", "m", "q1", 1, "pubmed", 1, 0.1, 0.2, 0.3, -1.0, 1.0, 10)]
    df = spark.createDataFrame(rows, R.QUESTION_LOG_SCHEMA)
    S.export_csv(df.withColumn("status", F.lit("timeout")), str(tmp_path / "csv"))
    back = R.read_logs(spark, str(tmp_path / "csv"), "question").collect()[0]
    assert back.status == "timeout" and back.generate_time is None
    S.write_question_log(df.withColumn("routing", F.lit("all")), str(tmp_path / "log"))
    S.write_question_log(df.withColumn("routing", F.lit("all")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    S.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception):
        S.write_once(df, str(tmp_path / "once"))
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model_name string, ndcg double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "model_name string, ndcg double")
    m = {r.model_name: r.ndcg for r in S.upsert_metrics(old, new, "model_name", str(tmp_path / "m2")).collect()}
    assert m == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_upsert_keeps_the_last_of_repeated_rows(spark, tmp_path):
    schema = "model_name string, run long, ndcg double"
    old = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), (None, 0, 0.5)], schema)
    new = spark.createDataFrame([("b", 2, 3.0), ("b", 1, 9.0), ("c", 1, 4.0), ("c", 1, 5.0), (None, 1, 0.7), ("d", None, 1.0), ("d", 1, 0.1)], schema)
    got = {r.model_name: r.ndcg for r in S.upsert_metrics(old, new, "model_name", str(tmp_path / "m3"), order="run").collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": 5.0, None: 0.7, "d": 0.1}
    back = S.upsert_metrics(old, new.select("model_name", "run", "ndcg"), "model_name", str(tmp_path / "m4")).collect()
    assert len(back) == len({r.model_name for r in back}) == 5


def test_dimensions(spark):
    s = dim_sources(spark)
    assert s.where("workload = 'feb4rag'").count() == 13
    assert s.where("workload = 'feb4rag' AND source = 'arguana'").first().source_id == 0
    ins = dim_instructions(spark)
    assert ins.count() == 3 * 29 * 2
    assert ins.where("model = 'hkunlp/instructor-xl' AND dataset = 'CQADupstackGisRetrieval' AND role = 'corpus'").count() == 1
    own = ins.select("model", "dataset", "role").withColumn("instruction", F.concat(F.lit("find "), "dataset"))
    assert dim_instructions(spark, own).where("instruction = 'find FEVER'").count() == 6
    with pytest.raises(Exception, match="no instruction"):
        dim_instructions(spark, own.where("dataset <> 'nq'")).collect()


def test_answers_and_documents_of_a_resumed_run_are_added(spark, tmp_path):
    for i in (1, 2):
        S.write_answers(spark.createDataFrame([(f"q{i}", "A")], "question_id string, answer string"), str(tmp_path / "a"))
        S.write_top_docs(spark.createDataFrame([(f"q{i}", 2, "d2"), (f"q{i}", 1, "d1")], "question_id string, rank int, doc string"),
                         str(tmp_path / "t"), ["doc"])
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    assert [[d.doc for d in r.docs] for r in spark.read.json(str(tmp_path / "t")).collect()] == [["d1", "d2"]] * 2


def test_attach_qrels_with_source(spark):
    from fedsearch.operators.rerank import attach_qrels
    hits = spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "qid int, source_id int, vec_id int")
    qrels = spark.createDataFrame([(1, 1, 5, 2, 1)], "qid int, source_id int, vec_id int, rel int, ord int")
    got = {r.source_id: r.judged_pos for r in attach_qrels(hits, qrels, with_source=True).collect()}
    assert got == {0: None, 1: 0}
