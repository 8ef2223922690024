"""Answer grading as column expressions (survey 2.K).

The letter locator tries a fixed list of patterns in order and takes the first
group of the first pattern that matches anywhere in the cleaned answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fedsearch.functions.text import PY_WS, last_after, py_strip

# ---- fixed values: must equal the graded benchmark's rule -------------------
# Marker that precedes the chosen letter in a JSON-style answer.
ANSWER_MARKER = '"answer_choice": "'
# Phrase after which a multiple-choice answer gives its letter.
TAIL_PHRASE = "The best answer is"
# Valid answer letters.
LETTERS = ("A", "B", "C", "D")
# Letter patterns, tried in this order; group 1 is the letter.
LETTER_PATTERNS = (
    r"^\s*(A|B|C|D)$",
    r"^\s*(A|B|C|D) or",
    r"^\s*(A|B|C|D) and",
    r"^\s*(A|B|C|D)/",
    r"^\s*(A|B|C|D),",
    r"[Oo]ption (A|B|C|D)",
    r":\s*(A|B|C|D)",
    r"^\s*(A|B|C|D)\.",
    r"^\s*(A|B|C|D)\"",
    r"^\s*(A|B|C|D):",
)
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_pattern(py_pattern: str) -> str:
    """Python ``re`` str pattern -> Java: Unicode classes, Python's whitespace set."""
    return "(?U)" + py_pattern.replace(r"\s", PY_WS)


def locate_letter(text) -> Column:
    """First pattern that matches wins; '' when none does."""
    t = _c(text)
    hits = [F.nullif(F.regexp_extract(t, java_pattern(p), 1), F.lit(""))
            for p in LETTER_PATTERNS]
    return F.coalesce(*hits, F.lit(""))


def letter_from_json_answer(output) -> Column:
    return locate_letter(py_strip(last_after(output, ANSWER_MARKER)))


def grade_letter_json(output, gold) -> Column:
    """Correct when the located letter and the gold are both A-D and equal (K1)."""
    pred = letter_from_json_answer(output)
    valid = pred.isin(*LETTERS) & _c(gold).isin(*LETTERS)
    return F.coalesce(valid & (pred == _c(gold)), F.lit(False))


def letter_from_tail(output) -> Column:
    tail = py_strip(last_after(output, TAIL_PHRASE))
    return py_strip(F.translate(tail, '."', ""))


def grade_letter_tail(output, gold_letter) -> Column:
    """Exact equality of the cleaned tail with the gold letter (K2)."""
    return F.coalesce(letter_from_tail(output) == _c(gold_letter), F.lit(False))


def grade_none() -> Column:
    """No gold answer: always counted correct (K3)."""
    return F.lit(True)
