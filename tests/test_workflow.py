"""Run-control and set operators (survey E1, E2, E5, F11-F15, H7, I1-I4, G17, G18)."""

from pyspark.sql import functions as F

from fedsearch.operators import metrics as M
from fedsearch.operators import workflow as W
from fedsearch.operators.routing import distinct_encoders
from fedsearch.operators.train import min_group_size
from fedsearch.sources.dims import dim_sources


def test_done_ids_union_skip_and_order(spark):
    own = spark.createDataFrame([("a",), ("b",)], "question_id string")
    glob = spark.createDataFrame([("b",), ("c",)], "question_id string")
    done = W.done_ids(own, glob, keys=["question_id"])
    assert sorted(r.question_id for r in done.collect()) == ["a", "b", "c"]
    qs = spark.createDataFrame([(x,) for x in "abcdef"], "question_id string")
    left = W.skip_done(qs, done, ["question_id"])
    assert sorted(r.question_id for r in left.collect()) == ["d", "e", "f"]
    order = W.saved_order(spark.createDataFrame([("f", 2), ("z", 1), ("d", 3)], "question_id string, k int"),
                          [F.col("k")])
    kept = W.order_questions(order, left, "question_id").orderBy("pos").collect()
    assert [(r.question_id, r.pos) for r in kept] == [("f", 2), ("d", 3)]


def test_batches_are_cut_in_saved_order(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(10)], "id int, pos bigint")
    b = {r.id: r.batch for r in W.assign_batches(df, 4).collect()}
    assert [b[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert W.select_shard(df, 1, 3).count() == 3


def test_set_ops_filters_and_min_group(spark):
    train = spark.createDataFrame([(i,) for i in range(10)], "qid int")
    val = spark.createDataFrame([(i,) for i in range(0, 10, 3)], "qid int")
    rest = train.join(val, "qid", "left_anti")            # I3: train minus validation
    assert sorted(r.qid for r in rest.collect()) == [1, 2, 4, 5, 7, 8]
    both = W.existing(train, val, spark.createDataFrame([(3,), (6,), (7,)], "qid int"), key="qid")
    assert sorted(r.qid for r in both.collect()) == [3, 6]
    subj = spark.createDataFrame([("bio", 1), ("law", 2), ("art", 3)], "subject string, x int")
    assert W.filter_values(subj, "subject", ["bio", "law"]).count() == 2
    g = spark.createDataFrame([("a", 1)] * 12 + [("b", 1)] * 3, "bank string, x int")
    assert {r.bank for r in min_group_size(g, "bank", 10).collect()} == {"a"}


def test_answers_join_drops_missing(spark):
    qs = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    ans = spark.createDataFrame([("q1", "B")], "query_id string, answer string")
    assert [r.query_id for r in W.attach_answers(qs, ans, "query_id").collect()] == ["q1"]


def test_validation_reasons(spark):
    rows = [("q", '["a"]', "1", None), ("  ", '["a"]', "2", None), ("", '["a"]', "3", "empty query"),
            ("q", None, "4", "missing choices"), ("q", "", "5", "missing choices"), ("q", "[a", "6", "choices not json"),
            ("q", "[a", "", "missing id"), ("q", '["a"]', None, "missing id"), ("q", '{"a": 1}', "7", None), ("q", "3", "8", None)]
    df = spark.createDataFrame(rows, "query string, choices_json string, id string, want string")
    assert all(r.reject_reason == r.want for r in W.validate_queries(df, qid="id").collect())
    assert W.validate_queries(df.where("id is null")).first().status == "accepted"


def test_encoder_groups_and_width(spark):
    s = dim_sources(spark).where("workload = 'feb4rag'")
    groups = {r.encoder: r.n_sources for r in distinct_encoders(s).collect()}
    assert len(groups) == 8 and groups["UAE-Large-V1"] == 5
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    assert M.max_width(v).first().max_width == 2
