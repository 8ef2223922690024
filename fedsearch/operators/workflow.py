"""Benchmark-run control as DataFrame operators (survey E1, E2, E5-E7, F11-F15, H7, I1-I4).

Parallelism comes from partitions, so the reference's shards and batches
survive only as selection and ordering operators over a saved order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.operators.positions import global_position


def saved_order(ids: DataFrame, order: list[Column], col: str = "pos") -> DataFrame:
    """A run order over ids, numbered 1.. without a single-task window."""
    return global_position(ids, order, col)


def order_questions(order: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """Saved order intersected with the loaded questions, keeping ``pos``."""
    return questions.join(order.select(key, "pos"), key, "inner")


def skip_done(questions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Questions not yet in the log (F12). ``keys`` may be the loose id alone (Q21)."""
    return questions.join(done.select(*keys).distinct(), keys, "left_anti")


def done_ids(*logs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of several logs' ids."""
    out = None
    for log in logs:
        part = log.select(*keys)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def assign_shard(ordered: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Shard i of n takes every n-th question from i in saved order."""
    return ordered.withColumn("shard", F.pmod(F.col(pos) - 1, F.lit(n)).cast("int"))


def select_shard(ordered: DataFrame, i: int, n: int, pos: str = "pos") -> DataFrame:
    return assign_shard(ordered, n, pos).where(F.col("shard") == i)


def assign_batches(ordered: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Consecutive groups of n in saved order (H7); cut before done ids are removed (Q22)."""
    return ordered.withColumn("batch", F.floor((F.col(pos) - 1) / n).cast("bigint"))


def filter_values(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """``col IN values`` for a fixed list (E1 subjects, E2 one bank)."""
    return df.where(F.col(col).isin(*values))


def attach_answers(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Answers with their question; a missing result is dropped."""
    return questions.join(answers, key, "inner")


def existing(df: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows whose key exists in every other table (F15: vector and label)."""
    for o in others:
        df = df.join(o.select(key), key, "left_semi")
    return df


def validate_queries(requests: DataFrame, query: str = "query", choices: str = "choices_json",
                     qid: str | None = None) -> DataFrame:
    """Reason a request is rejected, or NULL when accepted (E6); first failing check wins.

    Missing means null or the empty string (blanks are text); ``qid`` is asked
    for only where the workload needs an id; choices may be any valid JSON.
    """
    def missing(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    reason = F.when(missing(query), "empty query").when(missing(choices), "missing choices")
    if qid is not None:
        reason = reason.when(missing(qid), "missing id")
    reason = reason.when(F.try_parse_json(choices).isNull(), "choices not json")
    return requests.withColumn("reject_reason", reason) \
        .withColumn("status", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected"))
