"""What the corpus operators share: tables, word expressions and stored intermediate tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsearch.session import scratch_path

#: Fixed values of the contracts: white space and words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text in order; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def n_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("bigint")


def pack(docs: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns of ``docs`` beside ``_row``, a struct of all others.

    Operators that keep a table's columns work on this, so a column of the
    table never clashes with one that an operator makes.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(F.struct(F.lit(True).alias("_"), *rest).alias("_row"), *needed)


def unpack(rows: DataFrame, docs: DataFrame, _also: tuple[str, ...] = (), **new: Column) -> DataFrame:
    """The columns of ``docs`` in their order from packed ``rows``, ``new`` for those that changed, then ``_also``."""
    packed = rows.schema["_row"].dataType.names
    own = {c: new[c] if c in new else F.col("_row")[c] if c in packed else F.col(f"`{c}`") for c in docs.columns}
    return rows.select(*[v.alias(c) for c, v in own.items()], *_also)


def keep_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """``df.where(condition)``, evaluated where it stands.

    The optimiser moves a filter below the projections that make its columns
    and copies their expressions into it; over a chain of array expressions
    the copies multiply. It moves none below a column it can't repeat.
    """
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("_here", F.monotonically_increasing_id()).where(condition & (F.col("_here") >= 0)).drop("_here")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage where a table is used more than once or a loop would
    grow its plan: a lost executor then costs a re-read, not a recomputation,
    and both uses see the same rows.
    """
    path = scratch_path(df.sparkSession, os.path.join("llm", name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
