"""Text column expressions (survey 2.D, 2.J).

Everything here is a built-in string or regex function. Python's notion of
whitespace (``str.strip``/``str.split``) is Java's ``(?U)\\s`` plus U+001C..U+001F,
so that class is spelled out once and reused.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() as a Java regex class, and the same characters as a string.
PY_WS = r"[\s\x1c-\x1f]"
PY_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
             "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace, reading each character once."""
    return F.btrim(_c(c), F.lit(PY_BLANKS))


def java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def last_after(c, marker: str) -> Column:
    """Python ``x.split(marker)[-1]``: the text after the last marker (or all of it)."""
    return F.element_at(F.split(_c(c), java_quote(marker), -1), -1)


def ws_tokens(c) -> Column:
    """Python ``x.split()``: whitespace-separated tokens, none empty."""
    s = py_strip(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(s, rf"(?U){PY_WS}+", -1))


def format_mc_query(question, options) -> Column:
    """Question, newline, choices joined by ``' | '`` (survey D1)."""
    return F.concat_ws("\n", _c(question), F.array_join(_c(options), " | "))


def passage_text(title, text) -> Column:
    """``'{title} {text}'.strip()`` with a missing title read as '' (survey D2)."""
    return py_strip(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), _c(text)))


def join_sources(names) -> Column:
    """Sorted ``':'``-joined source names (survey D9)."""
    return F.array_join(F.array_sort(_c(names)), ":")


def truncate_ws_tokens(c, budget: int) -> Column:
    """The first ``budget`` whitespace tokens, joined by single spaces (survey D6)."""
    return F.array_join(F.slice(ws_tokens(c), 1, budget), " ")


def count_ws_tokens(c, budget: int | None = None) -> Column:
    """Number of tokens kept under ``budget`` (all when ``None``) (survey D7)."""
    n = F.size(ws_tokens(c))
    return n if budget is None else F.least(n, F.lit(budget))


def letter(i) -> Column:
    """0 -> 'A', 1 -> 'B', ..."""
    return F.char(F.lit(65) + _c(i))


def content_id(*cols) -> Column:
    """Deterministic id from a request's content (a recomputed task yields the
    same id, unlike a random uuid): SHA-256 of the fields joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]), 256)
