"""Places in text files, from offsets by split: no text is shuffled, sorted or stored to be numbered.

A scan reads a file in splits, each from front to end in one task. One pass
counts what each split holds (a row per split); running sums over these rows
give every split's first number, and a second pass adds a row's place in its
split. The table of splits is broadcast: one row per split of
``spark.sql.files.maxPartitionBytes``, whatever the lines.

Both passes are the same scan, so they pack splits into tasks alike; the task
is part of the join key, and a row whose split is not found where it was
counted raises an error instead of getting a wrong number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEYS = ["_file", "_split", "_task"]


def _with_splits(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))


def _in_read_order(rows: DataFrame) -> DataFrame:
    """Task and an id that follows the lines of a split."""
    return rows.withColumn("_task", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())


def _earlier(scope: list[Column]):
    """The splits before a split, in the order of the files' names."""
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))  # a row per split
    return w.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)


def folder_of(file: str = "_file") -> Column:
    return F.regexp_replace(file, "[^/]*$", "")


def numbered_lines(df: DataFrame, col: str, scope: str = "file", keep: Column | None = None) -> DataFrame:
    """``df`` (a text scan) with ``_file`` and ``col``: the 0-based place of each line.

    ``scope``: places start anew in each ``file``, in each ``folder`` (whose
    files are one text, cut into parts in the order of their names) or run on
    over ``all`` files. Lines that fail ``keep`` are dropped and not counted.
    """
    rows = _with_splits(df)
    rows = _in_read_order(rows if keep is None else rows.where(keep))
    counts = rows.groupBy(*_KEYS).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    scopes = {"file": [F.col("_file")], "folder": [folder_of()], "all": []}[scope]
    shift = F.coalesce(F.sum("_n").over(_earlier(scopes)), F.lit(0)) - F.col("_first")
    splits = F.broadcast(counts.select(*_KEYS, shift.alias("_shift")))
    lost = F.raise_error(F.concat(F.lit("split read elsewhere than counted: "), "_file")).cast("long")
    return (rows.join(splits, _KEYS, "left").withColumn(col, F.coalesce(F.col("_id") + F.col("_shift"), lost))
            .drop("_split", "_task", "_id", "_shift"))


def json_items(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """``file, place, item``: the texts between the commas of JSON values, one value per file (or ``folder``).

    Commas inside strings don't count. The file is read as records that end
    in a comma, so a value of any size is many splits. Whether a record
    starts inside a string is the parity of the quotes before it: inside a
    split by a running sum, at its start from the table of splits. An item
    cut by commas inside a string is put together again; all others stay
    where they were read. Blank items are left out.
    """
    raw = _with_splits(spark.read.option("lineSep", ",").text(path)).withColumn("_id", F.monotonically_increasing_id())
    # an escape never crosses a comma
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    raw = raw.withColumn("_quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"')))) \
             .withColumn("_blank", (F.col("_quotes") == 0) & F.col("value").rlike(r"^\s*$"))
    here = Window.partitionBy("_file", "_split").orderBy("_id")  # as much as one split
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = raw.withColumn("_before", F.coalesce(F.sum("_quotes").over(before), F.lit(0)))

    def ends(start: Column) -> Column:
        """Whether an item ends with this record, if its split starts with ``start`` open quotes."""
        inside = (start + F.col("_before")) % 2 == 1
        return (((start + F.col("_before") + F.col("_quotes")) % 2 == 0) & ~(F.col("_blank") & ~inside)).cast("long")

    counts = rows.groupBy("_file", "_split").agg(
        F.sum("_quotes").alias("_q"), F.sum(ends(F.lit(0))).alias("_n0"), F.sum(ends(F.lit(1))).alias("_n1"))
    scope = [folder_of() if folder else F.col("_file")]
    starts = counts.withColumn("_start", F.coalesce(F.sum("_q").over(_earlier(scope)), F.lit(0)) % 2) \
                   .withColumn("_n", F.when(F.col("_start") == 0, F.col("_n0")).otherwise(F.col("_n1"))) \
                   .withColumn("_offset", F.coalesce(F.sum("_n").over(_earlier(scope)), F.lit(0)))
    splits = F.broadcast(starts.select("_file", "_split", "_start", "_offset"))
    rows = rows.join(splits, ["_file", "_split"]).withColumn("_ends", ends(F.col("_start")))
    rows = rows.withColumn("place", F.col("_offset") + F.coalesce(F.sum("_ends").over(before), F.lit(0)))
    inside = (F.col("_start") + F.col("_before")) % 2 == 1
    rows = rows.select(scope[0].alias("file"), "place", "value", "_split", "_id", inside.alias("_inside"),
                       ((F.col("_start") + F.col("_before") + F.col("_quotes")) % 2 == 1).alias("_open"), "_blank",
                       F.col("_file").alias("_part"))
    whole = rows.where("not _inside and not _open and not _blank").select("file", "place", F.col("value").alias("item"))
    pieces = rows.where("_inside or _open").groupBy("file", "place").agg(
        F.sort_array(F.collect_list(F.struct("_part", "_split", "_id", "value"))).alias("p"))
    return whole.unionByName(pieces.select("file", "place", F.array_join(F.col("p")["value"], ",").alias("item")))


_STRING = r'"(?:[^"\\]|\\.)*+"'
#: Opening brackets, up to two keys (of nested objects), a scalar, closing brackets.
_ITEM = (r"(?s)^[\s\[\]{}]*+(?:(" + _STRING + r")\s*:)?[\s\[{]*+(?:(" + _STRING + r")\s*:)?[\s\[{]*+("
         + _STRING + r'|[^\s\[\]{}",:]++)?[\s\]}]*$')


def _decoded(token: Column) -> Column:
    """A JSON scalar as a string."""
    return F.when(F.length(token) > 0, F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0))


def item_parts(items: DataFrame) -> DataFrame:
    """``items`` with ``outer`` and ``inner`` (keys that open before the scalar; a single key is inner), ``has_scalar``
    and ``scalar``."""
    one, two, scalar = (F.regexp_extract("item", _ITEM, i) for i in (1, 2, 3))
    return items.select("file", "place", F.when(F.length(two) > 0, _decoded(one)).alias("outer"),
                        _decoded(F.when(F.length(two) > 0, two).otherwise(one)).alias("inner"),
                        (F.length(scalar) > 0).alias("has_scalar"), _decoded(scalar).alias("scalar"))


def with_keys(parts: DataFrame, block: int = 65_536) -> DataFrame:
    """Each scalar of :func:`item_parts` with the ``outer`` and ``inner`` key that its list stands under.

    Keys are carried on inside blocks of ``block`` places, and from block to
    block by a table with one row per block.
    """
    rows = parts.withColumn("_block", F.floor(F.col("place") / block))
    last = Window.partitionBy("file", "_block").orderBy("place")
    rows = rows.withColumns({f"_{k}": F.last(k, ignorenulls=True).over(last) for k in ("outer", "inner")})
    blocks = rows.groupBy("file", "_block").agg(*[
        F.max_by(k, F.when(F.col(k).isNotNull(), F.col("place"))).alias(f"_{k}_end") for k in ("outer", "inner")])
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(blocks.select("file", "_block", *[
        F.last(f"_{k}_end", ignorenulls=True).over(before).alias(f"_{k}_before") for k in ("outer", "inner")]))
    return rows.join(carried, ["file", "_block"]).where("has_scalar").select(
        "file", "place", "scalar", *[F.coalesce(f"_{k}", f"_{k}_before").alias(k) for k in ("outer", "inner")])
