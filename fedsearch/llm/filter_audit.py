"""Filter interaction audit over sorted posting lists (operator 11).

Every filter gets, per part and id range, the sorted list of the rows that
fail it. What filters do together is read off these lists: the union of a set
of them is what the set removes, a list without the union of the filters
before it is what its filter removes at that place. Unions are k-way merges
and differences two-way merges that gallop: while one list alone runs ahead,
exponential search finds the end of the run and the whole run is taken at
once. Sizes are summed over the ranges; any order of the filters is then a
walk over sizes, so all orders cost no further pass.

Scale. Texts are read once; a row travels on as its part, id, failing bits and
text digest. The smallest id of each repeated text is combined before its
shuffle, and both sides of its join are stored tables, so a text that holds a
third of all rows is a key that Spark can split. Rows are dealt by ranges of
part, id and place, so a part or an id that holds a third of them is many
ranges; a merge sees at most ``range_rows`` rows, and leaves the sizes of
``2^n`` unions and ``n 2^(n-1)`` differences. Labels are reduced to one row
per document before their join.

Edge cases. Null text: empty. Null source: the empty part. Null ``doc_id``: a
document of its own without labels, which neither repeats another nor is
repeated. Repeated rows: each is counted; one of them has no smaller id.
Several label rows of a document: it is good or toxic if any says so. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import stored, words

RANGE_ROWS = 65_536
#: Fixed values of the contract.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Whose losses are counted beside all rows: bit of a row's ``marks``.
FAMILIES = ("all", "good", "toxic")


def gallop(ids: list[int], at: int, x: int) -> int:
    """The first place from ``at`` on whose id is at least ``x``, by exponential search."""
    n, step = len(ids), 1
    if at >= n or ids[at] >= x:
        return at
    while at + step < n and ids[at + step] < x:
        at += step
        step *= 2
    return bisect_left(ids, x, at + 1, min(at + step, n))


def union(lists: list[list[int]]) -> list[int]:
    """The ids of any of the sorted lists, sorted: a k-way merge that takes runs whole."""
    lists = [x for x in lists if x]
    places, out = [0] * len(lists), []
    while len(lists) > 1:
        heads = [x[p] for x, p in zip(lists, places)]
        least = min(heads)
        k = heads.index(least)
        others = min((h for i, h in enumerate(heads) if i != k))
        if others == least:  # in several lists: taken once
            out.append(least)
            places = [p + (h == least) for p, h in zip(places, heads)]
        else:
            end = gallop(lists[k], places[k], others)
            out += lists[k][places[k]:end]
            places[k] = end
        if any(p == len(x) for x, p in zip(lists, places)):
            left = [(x, p) for x, p in zip(lists, places) if p < len(x)]
            lists, places = [x for x, _ in left], [p for _, p in left]
    return out + lists[0][places[0]:] if lists else out


def difference_size(ids: list[int], gone: list[int]) -> int:
    """How many of the sorted ``ids`` are not among the sorted ``gone``."""
    i = j = n = 0
    while i < len(ids):
        j = gallop(gone, j, ids[i])
        if j == len(gone):
            return n + len(ids) - i
        if gone[j] == ids[i]:
            i += 1
        else:
            end = gallop(ids, i, gone[j])
            n, i = n + end - i, end
    return n


def sizes(lists: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """``(filter, before, size)``: what each filter removes after each set of others (``before``, as bits),
    and as filter -1 the size of the union of each set."""
    for before in range(1 << len(lists)):
        gone = union([x for f, x in enumerate(lists) if before >> f & 1])
        yield -1, before, len(gone)
        for f, ids in enumerate(lists):
            if not before >> f & 1:
                yield f, before, difference_size(ids, gone)


def _range_sizes(n_filters: int, range_rows: int):
    """Arrow batches of ``part, place, fails, marks`` in that order -> sizes of each part in each range."""
    schema = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()),
                        *[(f, pa.int64()) for f in FAMILIES]])

    def audit(part: str, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        tables = []
        for bit in range(len(FAMILIES)):
            of = [(place, fails) for place, fails, marks in rows if marks >> bit & 1]
            tables.append(list(sizes([[place for place, fails in of if fails >> f & 1] for f in range(n_filters)])))
        keys = [(f, before) for f, before, _ in tables[0]] + [(-2, 0)]
        counts = [[n for _, _, n in t] + [sum(m >> bit & 1 for _, _, m in rows)] for bit, t in enumerate(tables)]
        return pa.record_batch([pa.array([part] * len(keys)), pa.array([f for f, _ in keys], pa.int32()),
                                pa.array([b for _, b in keys], pa.int32()), *map(pa.array, counts)], schema)

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (p != part or len(rows) == range_rows):
                    yield audit(part, rows)
                    rows = []
                part = p
                rows.append(tuple(row))
        if rows:
            yield audit(part, rows)

    return run


def interactions(rows: DataFrame, n_filters: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``part, filter, before`` and a size per family, from ``rows`` (``part, id, fails, good, toxic``).

    ``fails`` has bit f set where the row fails filter f. Filter f with the
    set ``before`` (bits): the rows that f removes after that set; filter -1:
    the rows that the set removes; filter -2: all rows.
    """
    marks = F.lit(1) + F.col("good").cast("int") * 2 + F.col("toxic").cast("int") * 4
    placed = stored(rows.select("part", "id", F.col("fails").cast("int").alias("fails"), marks.alias("marks"),
                                F.monotonically_increasing_id().alias("row")), "audit-rows")
    ranges = placed.repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row")
    # the place in the sorted range: a posting that is unique for repeated ids too
    lists = ranges.select("part", F.monotonically_increasing_id().alias("place"), "fails", "marks")
    found = lists.mapInArrow(_range_sizes(n_filters, range_rows),
                             "part string, filter int, before int, all long, good long, toxic long")
    return found.groupBy("part", "filter", "before").agg(*[F.sum(f).alias(f) for f in FAMILIES])


def in_order(found: DataFrame, names: str) -> DataFrame:
    """What each order of the filters does in each part, from :func:`interactions`; ``names`` has a letter a filter."""
    spark, bits, every = found.sparkSession, range(len(names)), (1 << len(names)) - 1
    steps = [("".join(names[f] for f in order), s + 1, f, sum(1 << g for g in order[:s]), sum(1 << g for g in order[:s + 1]))
             for order in permutations(bits) for s, f in enumerate(order)]
    # a constant table: a row per step of each order
    walk = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int"))
    found = stored(found, "audit-sizes")  # a row per part and pair of filter and set

    def size(f: Column, before: Column, alias: str, keep: str = "filter") -> DataFrame:
        return found.where((F.col("filter") == f) & (F.col("before") == before)).select("part", keep, F.col("all").alias(alias))

    rows = size(F.lit(-2), F.lit(0), "n_rows").drop("filter")
    unions = found.where("filter = -1").select("part", F.col("before").alias("after"), F.col("all").alias("gone"))
    fails = size(F.col("filter"), F.lit(0), "fails").where("filter >= 0")
    alone = size(F.col("filter"), F.lit(every) - F.expr("shiftleft(1, greatest(filter, 0))"), "unique_fails").where("filter >= 0")
    out = (found.where("filter >= 0").join(walk, ["filter", "before"])
           .join(unions, ["part", "after"]).join(rows, "part").join(fails, ["part", "filter"]).join(alone, ["part", "filter"]))
    shapley = out.groupBy("part", "filter").agg(F.sum("all").alias("shapley"))
    return out.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("n_rows") - F.col("gone")).alias("kept"), F.col("all").alias("removed"),
        (F.col("fails") - F.col("all")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), "shapley")


def failing(docs: DataFrame) -> DataFrame:
    """``part, id, fails`` of every document: bits 0 to 4 for the contract's filters A to E."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").alias("id"), text.alias("text"))
    rows = rows.withColumn("w", words("text")).withColumn("n", F.size("w"))
    few = F.col("n") < MIN_WORDS
    poor = 100 * F.size(F.array_distinct("w")) < MIN_DISTINCT_PERCENT * F.col("n")
    capitals = 100 * F.length(F.regexp_replace("text", "[^A-Z]++", "")) > MAX_CAPITALS_PERCENT * F.length("text")
    bits = sum((c.cast("int") * (1 << f) for f, c in enumerate((few, poor, capitals, F.col("text").rlike(SYMBOLS)))), F.lit(0))
    rows = stored(rows.select("part", "id", bits.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-fails")
    first = stored(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").drop("n"), "audit-firsts")
    again = F.coalesce(F.col("first") < F.col("id"), F.lit(False)).cast("int") * 16
    return rows.join(first, "digest", "left").select("part", "id", (F.col("fails") + again).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The contract's five filters over ``docs``, in each of their 120 orders, per source."""
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic")))
    none = F.lit(False)
    rows = failing(docs).join(marks, "id", "left").select(
        "part", "id", "fails", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    return in_order(interactions(rows, 5, range_rows), "ABCDE")
