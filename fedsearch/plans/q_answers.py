"""Catalogue: answer grading, accuracy and latency summaries (2.K, G2-G4, E4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fedsearch.functions import grade as G
from fedsearch.operators import metrics as M
from fedsearch.plans import fixtures as fx
from fedsearch.plans.registry import query

OUTLIER_CUT = 20.0  # seconds; longer source replies are left out of the per-source summary


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _locate_sql(x: str) -> str:
    hits = [f"nullif(regexp_extract({x}, {_sql_str(p.replace(chr(92) + chr(34), chr(34)))}, 1), '')"
            for p in G.LETTER_PATTERNS]
    return "coalesce(" + ", ".join(hits) + ", '')"


JSON_PRED_SQL = _locate_sql(_STRIP.format(x=f"string_split(llm_output, {_sql_str(G.ANSWER_MARKER)})[-1]"))
_TAIL_PRED_SQL = _STRIP.format(x="replace(replace(" + _STRIP.format(
    x=f"string_split(llm_output, {_sql_str(G.TAIL_PHRASE)})[-1]") + ", '.', ''), '\"', '')")


def _graded(spark, d):
    a = fx.answers(spark, d)
    return a.select("item_id", "bank", "gold",
                    G.letter_from_json_answer("llm_output").alias("pred"),
                    G.grade_letter_json("llm_output", "gold").alias("correct"))


@query("grade_letter_json", f"""
SELECT item_id, bank, pred, (pred IN ('A', 'B', 'C', 'D') AND gold IN ('A', 'B', 'C', 'D') AND pred = gold) AS correct
FROM (SELECT item_id, bank, gold, {JSON_PRED_SQL} AS pred FROM answers)""")
def grade_letter_json(spark, d):
    """Letter after the last answer marker, by ten ordered patterns (K1)."""
    return _graded(spark, d).drop("gold")


@query("grade_letter_tail", f"""
SELECT item_id, pred, pred = gold AS correct FROM (SELECT item_id, gold, {_TAIL_PRED_SQL} AS pred FROM answers)""")
def grade_letter_tail(spark, d):
    """Cleaned text after the last closing phrase must equal the gold letter (K2)."""
    a = fx.answers(spark, d)
    return a.select("item_id", G.letter_from_tail("llm_output").alias("pred"),
                    G.grade_letter_tail("llm_output", "gold").alias("correct"))


@query("accuracy_by_bank", f"""
SELECT bank, count(*) AS total, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS n_correct,
       round(avg(CAST(correct AS INTEGER)), 6) AS accuracy
FROM (SELECT bank, (pred IN ('A', 'B', 'C', 'D') AND gold IN ('A', 'B', 'C', 'D') AND pred = gold) AS correct
      FROM (SELECT bank, gold, {JSON_PRED_SQL} AS pred FROM answers))
GROUP BY ROLLUP (bank)""")
def accuracy_by_bank(spark, d):
    """Total, correct and accuracy per bank plus the overall row."""
    a = M.accuracy(_graded(spark, d), ["bank"], rollup=True)
    return a.select("bank", "total", "n_correct", F.round("accuracy", 6).alias("accuracy"))


_BOX_COLS = ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")


def _box_sql(group: str, where: str = "") -> str:
    return f"""
WITH l AS (SELECT * FROM latency {where}),
qs AS (SELECT {group}, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.5) AS median,
              quantile_cont(duration, 0.75) AS q3 FROM l GROUP BY {group}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qs)
SELECT f.{group}, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, count(l.duration) AS n,
       round(min(CASE WHEN l.duration >= f.lo AND l.duration <= f.hi THEN l.duration END), 6) AS whisker_lo,
       round(max(CASE WHEN l.duration >= f.lo AND l.duration <= f.hi THEN l.duration END), 6) AS whisker_hi,
       CAST(count_if(NOT (l.duration >= f.lo AND l.duration <= f.hi)) AS BIGINT) AS n_outliers
FROM l JOIN f ON f.{group} = l.{group}
GROUP BY f.{group}, f.q1, f.median, f.q3, f.iqr"""


def _box(df, group):
    b = M.box_stats(df, [group], "duration")
    return b.select(group, *[F.round(c, 6).alias(c) for c in _BOX_COLS], "n", "n_outliers")


@query("latency_box", _box_sql("dataset"))
def latency_box(spark, d):
    """Quartiles, whiskers and outliers of durations per dataset."""
    return _box(fx.latency(spark, d), "dataset")


@query("source_latency_box", _box_sql("source", f"WHERE duration <= {OUTLIER_CUT}"))
def source_latency_box(spark, d):
    """Same per source, after dropping replies slower than 20 s."""
    lat = fx.latency(spark, d).where(F.col("duration") <= OUTLIER_CUT)
    return _box(lat, "source")
