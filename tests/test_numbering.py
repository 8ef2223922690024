"""Places from offsets by split: lines and JSON lists cut anywhere, and the plans behind them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fedsearch.sources import numbering as N
from fedsearch.sources import readers as R
from fedsearch.sources import sinks as S


@pytest.fixture
def small_splits(spark):
    """A function that sets the size of splits, taken back after the test."""
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_million_lines(spark, tmp_path, small_splits):
    n = 1_000_000
    (tmp_path / "a.txt").write_text("".join(f"{i}{'x' * (i % 13)}\n" for i in range(n)))
    (tmp_path / "b.txt").write_text("".join(f"{i}\n" for i in range(1000)))
    small_splits(256 << 10)
    df = N.numbered_lines(spark.read.text(str(tmp_path)), "line")
    bad = df.where(F.regexp_extract("value", r"^([0-9]+)", 1).cast("long") != F.col("line"))
    assert bad.count() == 0 and df.count() == n + 1000
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    both = N.numbered_lines(spark.read.text(str(tmp_path)), "line", "all")
    assert both.agg(F.count_distinct("line"), F.max("line")).first() == (n + 1000, n + 999)


def test_texts_meet_no_exchange(spark, tmp_path):
    (tmp_path / "en.jsonl").write_text('{"title": "a", "content": "b"}\n' * 50)
    df = R.parse_chunks(R.read_chunks(spark, str(tmp_path)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    # the only exchanges are those of the table of splits, below the broadcast
    before_broadcast = final[:final.index("BroadcastQueryStage")]
    assert "Exchange" not in before_broadcast and "SortMergeJoin" not in final


def test_dropped_lines_are_not_counted(spark, tmp_path, small_splits):
    (tmp_path / "q.txt").write_text("".join(f"q{i} 0 d 1\n" + "\n" * (i % 3) for i in range(5000)))
    small_splits(4 << 10)
    got = sorted((r.ord, r.qid) for r in R.read_qrels(spark, str(tmp_path / "q.txt")).collect())
    assert got == [(i + 1, f"q{i}") for i in range(5000)]


def test_a_split_read_elsewhere_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("x\n" * 10)
    other = spark.createDataFrame([("f", 0, 99, 0)], "_file string, _split long, _task int, _shift long")
    monkeypatch.setattr(N.F, "broadcast", lambda _: other)
    with pytest.raises(Exception, match="split read elsewhere"):
        N.numbered_lines(spark.read.text(str(tmp_path)), "line").collect()


def odd_ids(n, seed):
    r = random.Random(seed)
    parts = ["a", ",", '"', "\\", "é😀", " ", "\n", "[", "]", "{", "}", ":", "\t", "7", ", ,", '\\"']
    return ["".join(r.choice(parts) for _ in range(r.randrange(6))) for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("split", [64, 1 << 20])
def test_arrays(spark, tmp_path, small_splits, indent, ascii_only, split):
    lists = {"1": odd_ids(400, 1), "2": [], "3": ["only"], "4": ["", ",", " , ", '"', ",,,"] * 9, "5": [5, -1.5, "x", None, True]}
    for k, ids in lists.items():
        (tmp_path / f"ids_{k}.json").write_text(json.dumps(ids, indent=indent, ensure_ascii=ascii_only) + "\n")
    small_splits(split)
    rows = R.read_vector_ids_array(spark, str(tmp_path), r"ids_([0-9])\.json").collect()
    got = {k: [r.doc_id for r in sorted(rows, key=lambda r: r.pos) if r.source_id == int(k)] for k in lists}
    for k, ids in lists.items():
        assert got[k] == [x if x is None or isinstance(x, str) else json.dumps(x) for x in ids], k
        assert sorted(r.pos for r in rows if r.source_id == int(k)) == list(range(len(ids)))


def test_a_million_ids_in_many_tasks(spark, tmp_path, small_splits):
    n = 1_000_000
    (tmp_path / "order.json").write_text(json.dumps([f"q,{i}" if i % 1000 == 0 else f"q{i}" for i in range(n)]))
    small_splits(512 << 10)
    df = R.read_question_order(spark, str(tmp_path / "order.json"))
    bad = df.where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long") + 1 != F.col("pos"))
    assert bad.count() == 0 and df.count() == n
    assert spark.read.option("lineSep", ",").text(str(tmp_path / "order.json")).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("split", [128, 1 << 20])
def test_manifests(spark, tmp_path, small_splits, split):
    flat = {"train": odd_ids(80, 2), "val": [], "test": odd_ids(50, 3)}
    nested = {"med, \"qa\"": {"train": [f"a{i}" for i in range(70)], "test": ["z,"]}, "empty": {"train": [], "test": []},
              "bio": {"train": odd_ids(40, 4), "val": ["v"], "test": []}}
    (tmp_path / "flat.json").write_text(json.dumps(flat, indent=2))
    (tmp_path / "nested.json").write_text(json.dumps(nested))
    small_splits(split)
    rows = R.read_split_manifest(spark, str(tmp_path / "flat.json")).collect()
    assert sorted((r.split, r.query_id) for r in rows) == sorted((s, i) for s, ids in flat.items() for i in ids)
    assert {r.bank for r in rows} == {None}
    rows = R.read_split_manifest(spark, str(tmp_path / "nested.json"), by_bank=True).collect()
    assert sorted((r.bank, r.split, r.query_id) for r in rows) == sorted(
        (b, s, i) for b, lists in nested.items() for s, ids in lists.items() for i in ids)


def test_keys_are_carried_over_blocks(spark, tmp_path):
    nested = {f"b{k}": {"train": [str(i) for i in range(k * 7)], "test": ["t"]} for k in range(6)}
    (tmp_path / "m.json").write_text(json.dumps(nested))
    parts = N.item_parts(N.json_items(spark, str(tmp_path / "m.json")))
    for block in (1, 3, 1000):
        got = sorted((r.outer, r.inner, r.scalar) for r in N.with_keys(parts, block).collect())
        assert got == sorted((b, s, i) for b, lists in nested.items() for s, ids in lists.items() for i in ids)


def test_written_manifest_is_one_json_value(spark, tmp_path):
    rows = [(f"b{i % 3}", i, "train" if i % 4 else "test") for i in range(300)] + [('b"9', 1000, "val")]
    df = spark.createDataFrame(rows, "bank string, qid long, split string").repartition(7)
    path = S.write_split_manifest(df, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*.txt")))
    value = json.loads(text)
    want = sorted((b, s, str(i)) for b, i, s in rows)
    assert sorted((b, s, i) for b, lists in value.items() for s, ids in lists.items() for i in ids) == want
    back = R.read_split_manifest(spark, path, by_bank=True, folder=True).collect()
    assert sorted((r.bank, r.split, r.query_id) for r in back) == want
