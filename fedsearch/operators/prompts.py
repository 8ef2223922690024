"""Packing retrieved documents into prompts (survey D5-D8, Q16-Q18).

A query's context is built from its own merged top-k only (k rows per group),
so ``collect_list`` here gathers a bounded set; order is always carried as a
rank and restored with ``array_sort``, never taken from collection order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.functions.text import count_ws_tokens, truncate_ws_tokens

# ---- fixed values: context layouts of the three workloads -----------------
# numbered: "Document [i] (Title: t) text", 0-based, one per line; a missing
#           title reads "Doc i"
# headed:   "##### Document i [t] #####" + newline + text, 1-based, blank line between
# colon:    "Document i [t]: text" + newline, 1-based, no separator
LAYOUTS = ("numbered", "headed", "colon")
# -----------------------------------------------------------------------------


def _piece(layout: str, i0: Column, title: Column, text: Column) -> Column:
    i1 = (i0 + 1).cast("string")
    if layout == "numbered":
        t = F.coalesce(title, F.concat(F.lit("Doc "), i0.cast("string")))
        return F.concat(F.lit("Document ["), i0.cast("string"), F.lit("] (Title: "), t, F.lit(") "), text)
    if layout == "headed":
        return F.concat(F.lit("##### Document "), i1, F.lit(" ["), F.coalesce(title, F.lit("")),
                        F.lit("] #####\n"), text)
    if layout == "colon":
        return F.concat(F.lit("Document "), i1, F.lit(" ["), F.coalesce(title, F.lit("")),
                        F.lit("]: "), text, F.lit("\n"))
    raise ValueError(f"unknown layout {layout!r}")


_SEP = {"numbered": "\n", "headed": "\n\n", "colon": ""}


def render_context(docs: DataFrame, layout: str = "numbered", by: str = "qid",
                   rank: str = "rank", title: str = "title", text: str = "text") -> DataFrame:
    """(by, context, n_docs, n_missing): documents in rank order, one string.

    Rows whose document is missing (null text) are left out and counted
    (Q16); no document at all gives the empty string (Q18).
    """
    packed = docs.groupBy(by).agg(
        F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(),
                                           F.struct(F.col(rank).alias("r"), F.col(title).alias("t"),
                                                    F.col(text).alias("x"))))).alias("_d"),
        F.count_if(F.col(text).isNull()).alias("n_missing"))
    pieces = F.transform("_d", lambda d, i: _piece(layout, i, d["t"], d["x"]))
    return packed.select(by, F.array_join(pieces, _SEP[layout]).alias("context"),
                         F.size("_d").alias("n_docs"), "n_missing")


def truncate_context(ctx: DataFrame, budget: int, col: str = "context") -> DataFrame:
    """Keep the first ``budget`` whitespace tokens; count kept and total tokens."""
    return ctx.withColumn("truncated", truncate_ws_tokens(col, budget)) \
        .withColumn("n_tokens", count_ws_tokens(col, budget)) \
        .withColumn("total_tokens", count_ws_tokens(col))


_SLOT = re.compile(r"\{(\w+)\}")


def fill_template(template: str, **slots: Column) -> Column:
    """Concatenate the template's text with the columns named by ``{slot}``."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(slots[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# Prompt wording is our own; the answer formats are the graders' fixed values
# (a JSON "answer_choice" field, or a closing "The best answer is" phrase).
SYSTEM_PROMPTS = {
    "medrag": "You answer medical multiple-choice questions from the supplied documents. "
              "Reason briefly, then reply as JSON with the keys \"step_by_step_thinking\" and \"answer_choice\".",
    "feb4rag": "You answer requests using only the supplied search results, citing them as [n].",
    "wikipedia": "You answer multiple-choice questions. Use the passages when they help.",
}
USER_TEMPLATES = {
    "medrag": "Documents:\n{context}\n\nQuestion:\n{question}\n\nChoices:\n{options}\n\n"
              "Reply as JSON with \"step_by_step_thinking\" and \"answer_choice\":",
    "feb4rag": "Search results:\n{context}\n\nRequest:\n{question}",
    "wikipedia": "Passages:\n{context}\n\nQuestion: {question}\nA. {a}\nB. {b}\nC. {c}\nD. {d}\n\n"
                 "End your reply with the phrase \"The best answer is\" and one letter.\n\nThe best answer is",
}


def render_prompt(df: DataFrame, workload: str, context: str = "context", question: str = "question",
                  options: str = "options") -> DataFrame:
    """Add ``system`` and ``user`` messages for the workload's template."""
    opts = F.col(options)
    slots = {"context": F.col(context), "question": F.col(question),
             "options": F.array_join(opts, "\n"),
             "a": F.element_at(opts, 1), "b": F.element_at(opts, 2),
             "c": F.element_at(opts, 3), "d": F.element_at(opts, 4)}
    return df.withColumn("system", F.lit(SYSTEM_PROMPTS[workload])) \
        .withColumn("user", fill_template(USER_TEMPLATES[workload], **slots))
