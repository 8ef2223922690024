"""Benchmark decontamination by windows of words (operator 13).

The windows of ``window`` words of all benchmark items (an item of fewer words
is one window) form a hash set that is broadcast. The windows of every text
are hashed where the text is read and looked up there; a hit counts once its
words equal the item's. The words under hits are then removed, or the
documents that have too many of them.

Everything is built of DataFrame functions. A word is hashed once, a window is
the hash of its words' hashes. One pass over the texts makes a row per
document and a row per hit, and nothing else leaves a task.

Scale. Texts are neither shuffled nor stored. The set has a row per distinct
benchmark window. It is counted before it is broadcast: above ``set_rows``
windows it is cut by hash into blocks of about that many, and the texts, given
row numbers and stored, are read once per block, so no broadcast grows with
the benchmark. Hits are stored before they meet the items that hold their
windows, so a passage that a third of all documents quote is a join key that
Spark can split; a document's hits are grouped by its row.

Edge cases. Null or empty text, on either side: no words. A text shorter than
the window holds only shorter items. Repeated rows and null ids: each row is a
document of its own; an item without id marks words but is not listed. Equal
items: each listed. Only A-Z are lower-cased. Empty tables: nothing is hit, or
empty result. Other columns are kept by :func:`decontaminate` and ignored by
:func:`report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import keep_where, pack, stored, unpack

WINDOW = 10
SET_ROWS = 1_000_000
#: Fixed values of the contract: words, after and before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _windows(hashes: str, length: int) -> Column:
    """The hash of every run of ``length`` word hashes."""
    c = F.col(hashes)
    return F.when(F.size(c) >= length, F.transform(
        F.slice(c, 1, F.greatest(F.size(c) - length + 1, F.lit(0))), lambda _, i: F.xxhash64(F.slice(c, i + 1, length)))
    ).otherwise(F.array().cast("array<bigint>"))


def _gram(words: Column | str, place: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, place + 1, length), " ")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored ``item_id, length, h, gram``: the distinct windows of every item."""
    rows = benchmark.select("item_id", normalised(F.col("text")).alias("w")).where("size(w) > 0")
    rows = rows.withColumn("length", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("place")
    grams = rows.select("item_id", "length", "w", at).select("item_id", "length", _gram("w", F.col("place"), F.col("length")).alias("gram"))
    h = F.xxhash64(_hashes(F.split("gram", " ")))
    return stored(grams.distinct().withColumn("h", h), "decontamination-items")


def _scan(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """One pass: ``row, doc_id, digest, n_words`` of each document, with a null ``gram``, and ``place, length, gram`` of
    each hit. ``grams`` (``h, length, gram``) is of a checked size."""
    text = F.col("text")
    rows = (docs.select("row", "doc_id", F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"), normalised(text).alias("w"))
            .withColumn("u", _hashes(F.col("w"))))
    # first a mark that no window has, for the document itself; then the windows of each length
    every = F.concat(F.array(F.lit(None).cast("bigint")), *[_windows("u", n) for n in lengths])
    rows = rows.select("row", "doc_id", "digest", "w", F.size("w").alias("n_words"), F.posexplode(every).alias("k", "h"))
    place, length, before = F.lit(-1), F.lit(0), F.lit(1)
    for n in lengths:
        held = F.greatest(F.col("n_words") - n + 1, F.lit(0))
        here = (F.col("k") >= before) & (F.col("k") < before + held)
        place, length = F.when(here, F.col("k") - before).otherwise(place), F.when(here, F.lit(n)).otherwise(length)
        before = before + held
    wanted = F.broadcast(grams.select(F.col("h").alias("_h"), F.col("length").alias("_length"), "gram"))
    found = rows.join(wanted, F.col("h") == F.col("_h"), "left")
    equal = (F.col("_length") == length) & (_gram("w", place, length) == F.col("gram"))
    return found.where((F.col("k") == 0) | equal).select(
        "row", "doc_id", "digest", F.col("n_words").cast("bigint").alias("n_words"), place.alias("place"), length.alias("length"), "gram")


def hits(docs: DataFrame, items: DataFrame, set_rows: int = SET_ROWS) -> DataFrame:
    """Stored rows of :func:`_scan` for all windows of ``items`` (from :func:`item_windows`)."""
    grams = stored(items.select("h", "length", "gram").distinct(), "decontamination-set")
    lengths = sorted((r.length for r in grams.select("length").distinct().collect()), reverse=True)  # at most `window`
    blocks = max(-(-grams.count() // set_rows), 1)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    if blocks == 1:
        return stored(_scan(rows, grams, lengths), "decontamination-hits")
    rows = stored(rows, "decontamination-docs")  # all blocks see the same row numbers
    every = None
    for b in range(blocks):
        found = _scan(rows, grams.where(F.pmod("h", F.lit(blocks)) == b), lengths)
        found = stored(found if b == 0 else found.where("gram is not null"), "decontamination-hits")
        every = found if every is None else every.unionByName(found)
    return every


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_rows: int = SET_ROWS) -> DataFrame:
    """``doc_id, digest`` (of the text), ``n_words, places`` (of the hit words, from 0, in order) and ``items`` (distinct
    ids as strings, in order) of every document."""
    items = item_windows(benchmark, window)
    found = hits(docs, items, set_rows)
    covered = F.sequence(F.col("place"), F.col("place") + F.col("length") - 1)
    words = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"), F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("gram").isNotNull(), covered))))).alias("places"))
    # stored on both sides: a window that very many documents hold can be split
    listed = (found.where("gram is not null").select("row", "gram")
              .join(items.where("item_id is not null").select("gram", F.col("item_id").cast("string").alias("item")), "gram")
              .select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return words.join(listed, "row", "left").select(
        "doc_id", "digest", "n_words", "places", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _without(text: Column, places: str) -> Column:
    """``text`` without the words at ``places`` and what follows each of them up to the next word."""
    p = F.col(places)
    starts = F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1) == x - 1, F.lit(False)))
    ends = F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1) == x + 1, F.lit(False)))
    words, between = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), F.split(text, WORD_ANY_CASE, -1)
    tokens = F.zip_with(words, F.slice(between, 2, F.size(words)), lambda w, s: F.concat(w, s))
    # kept runs lie between the end of one hit run and the start of the next
    froms, untils = F.concat(F.array(F.lit(-1)), ends), F.concat(starts, F.array(F.size(words)))
    kept = F.zip_with(froms, untils, lambda a, b: F.array_join(F.slice(tokens, a + 2, b - a - 1), ""))
    return F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", max_share: float = 0.0,
                  window: int = WINDOW, set_rows: int = SET_ROWS) -> DataFrame:
    """``docs`` without benchmark windows, with all its columns.

    ``remove="spans"`` cuts the hit words out of the texts; ``"documents"``
    drops documents with more than ``max_share`` of their words hit.
    """
    found = report(docs, benchmark, window, set_rows).where("size(places) > 0").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_words", "places").dropDuplicates(["_id", "_digest"])
    found = stored(found, "decontamination-report")
    rows = pack(docs, "doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (digest == found["_digest"]), "left")
    if remove == "documents":
        over = F.coalesce(F.size("places") > max_share * F.col("n_words"), F.lit(False))
        return unpack(keep_where(rows, ~over).select("_row", "doc_id", "text"), docs)
    text = F.when(F.col("places").isNotNull(), _without(F.col("text"), "places")).otherwise(F.col("text"))
    return unpack(rows.select("_row", "doc_id", text.alias("text")), docs)
