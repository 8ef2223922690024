"""The physical plans we rely on at scale."""

from conftest import SF01
from fedsearch.plans import fixtures as fx
from fedsearch.operators import rerank


def test_routed_search_is_hash_join_with_partial_topk(spark):
    h = rerank.merge_desc(fx.hits(spark, SF01), 10)
    h.collect()
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_layout_scan_prunes_columns(spark):
    c = fx.corpus(spark, SF01).select("vec_id", "source_id")
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint>" in plan or "struct<vec_id:bigint>" in plan


def test_routed_search_prunes_unrouted_sources(spark):
    h = fx.hits(spark, SF01)
    h.collect()
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert "BroadcastHashJoin" in plan


def test_file_queries_have_no_group_in_one_file(spark, tmp_path, monkeypatch):
    """A language, label or list that holds all rows is written as several files; positions run on over them."""
    from fedsearch.plans import q_files
    from fedsearch.sources import readers as R
    monkeypatch.setattr(q_files, "scratch_path", lambda _, name: str(tmp_path / name))
    rows = spark.range(4000)
    tables = {"documents": rows.selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "concat('t', id) AS text"),
              "embeddings": rows.selectExpr("id AS vec_id", "1 AS label"), "benchmark": rows.selectExpr("id AS item_id")}
    monkeypatch.setattr(q_files.fx, "read", lambda _, __, name: tables[name])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = q_files.read_chunks(spark, None).collect()
        lines = q_files.read_parallel_lines(spark, None).collect()
        ids = q_files.read_vector_ids(spark, None).collect()
        order = q_files.read_question_order(spark, None).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.line, r.text) for r in chunks) == [(i, f"t{i}") for i in range(4000)]
    assert sorted((r.line, r.title, r.text) for r in lines) == [(i, f"s {i}", f"t{i}") for i in range(4000)]
    assert sorted((r.pos, r.line_in_file) for r in ids) == [(i, i) for i in range(4000)]
    want = sorted(range(4000), key=lambda i: (i * 7919 % 1009, i))
    assert [r.query_id for r in sorted(order, key=lambda r: r.pos)] == [str(i) for i in want]
    for name in ("chunks", "lines/texts", "lines/titles", "ids", "order"):
        assert len(list((tmp_path / name).rglob("part-*.txt"))) > 1, name
