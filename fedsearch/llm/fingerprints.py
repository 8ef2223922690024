"""Document fingerprints: SimHash with permuted block tables (operator 3).

Terms are word pairs (a single word stands alone), weighted by how often they
occur and by the bit length of their length. Every term's 64-bit hash votes
with its weight, plus on its set bits and minus on the others; the fingerprint
has the bits whose votes are positive. Two fingerprints' likeness is the share
of equal bits.

Search. The 64 bits are cut into ``blocks`` blocks; each table holds all
fingerprints under another choice of ``blocks - radius`` blocks moved to the
front. Fingerprints within the radius agree on at least that many blocks, so
every such pair meets in some table; a pair that meets in several is reported
by the first.

Everything is built of DataFrame functions. Texts are exploded into terms that
are summed before any shuffle: a long holds two counters, so 32 sums are the 64
votes. Fingerprints are made per text, not per row: equal texts have equal
fingerprints and are looked up by a 128-bit text key.

The *edited* text of a document ends with the start of the next one, in
descending order of ``doc_id`` (null ids last; equal ids in order of their text
keys). The order is cut into ranges whose bounds are computed once and then
stand in the plan as numbers; inside a range the next row is the next document,
and the first row of each range also stands at the end of the one before.

Scale. Texts are shuffled once, by range; a row finds its range by binary
search. An id that fills several ranges, null ids too, is cut further by text
key. Nothing meets in one task but the number of each range. Term votes are
combined per task before the shuffle (300 bytes per text). The tables hold one
row per distinct fingerprint and table.

Edge cases. Null or empty text: no terms, fingerprint 0. A single document is
its own next. Repeated rows: each is a row of the result, next to each other
(equal in id and text, they share a range).
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.llm.common import stored, words

RADIUS = 3
BLOCKS = 5
_LANES = "4294967297L"  # bit 0 of either half


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def simhash(texts: DataFrame) -> DataFrame:
    """``k1, k2, fp`` for each different text of ``texts`` (``k1, k2``: its key, ``text``)."""
    rows = texts.withColumn("_a", words("text")).where("size(_a) > 0")
    rows = rows.select("k1", "k2", F.slice("_a", 1, F.greatest(F.size("_a") - 1, F.lit(1))).alias("_a"),
                       F.slice("_a", 2, F.size("_a")).alias("_b"))
    terms = rows.select("k1", "k2", F.explode(F.arrays_zip("_a", "_b")).alias("t"))
    terms = terms.select("k1", "k2", F.xxhash64("t._a", "t._b").alias("h"),
                         F.length(F.bin(F.length("t._a") + F.coalesce(F.length("t._b"), F.lit(0))))
                         .cast("bigint").alias("w"))
    votes = [F.sum(F.expr(f"(shiftrightunsigned(h, {i}) & {_LANES}) * w")).alias(f"v{i}") for i in range(32)]
    sums = terms.groupBy("k1", "k2").agg(F.sum("w").alias("w"), *votes)
    fp = F.lit(0).cast("bigint")
    for i in range(32):
        low = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        high = F.shiftrightunsigned(f"v{i}", 32)
        for count, bit in ((low, i), (high, i + 32)):
            one = F.lit(-(1 << 63) if bit == 63 else 1 << bit).cast("bigint")
            fp = fp.bitwiseOR(F.when(2 * count > F.col("w"), one).otherwise(F.lit(0).cast("bigint")))
    return sums.select("k1", "k2", fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def _masks(blocks: int) -> list[int]:
    """The bits of each block."""
    out, at = [], 0
    for i in range(blocks):
        width = 64 // blocks + (i < 64 % blocks)
        out.append(((1 << width) - 1) << at)
        at += width
    return out


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")


def tables(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fps`` (``fp``) once per table: ``tab`` and ``front``, the table's blocks of the fingerprint."""
    fronts = [sum(c) for c in combinations(_masks(blocks), blocks - radius)]
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_long(m)) for m in fronts])).alias("tab", "front"))


def near(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs ``(query, fp)`` within ``radius`` bits, of distinct ``queries`` and ``fps`` (``fp``)."""
    asked = tables(queries, radius, blocks).withColumnRenamed("fp", "query")
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(None).cast("int")
    fronts = [sum(c) for c in combinations(_masks(blocks), blocks - radius)]
    for i, m in reversed(list(enumerate(fronts))):
        first = F.when(differ.bitwiseAND(_long(m)) == 0, i).otherwise(first)
    found = asked.join(tables(fps, radius, blocks), ["tab", "front"])
    return found.where((F.bit_count(differ) <= radius) & (F.col("tab") == first)).select("query", "fp")


def _range_of(rows: DataFrame) -> tuple[Column, Column]:
    """The number of bounds below ``doc_id``, to be column ``_below``, and the number of the range of ``doc_id``,
    ``k1`` and ``_below``, which rises in the order of documents."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    shares = [(i + 1) / (n + 1) for i in range(n)]
    # the bounds are numbers in the plan from here on: every use cuts the ranges alike
    seen = rows.agg(F.percentile_approx("doc_id", shares, 100 * n).alias("b"), F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    times = Counter(seen["b"] or [])
    bounds = sorted(times)
    ident, u = F.col("doc_id"), F.col("k1") / 2.0 ** 64 + 0.5  # the key's place between 0 and 1

    def cut(parts: Column) -> Column:
        return F.least(F.floor(u * parts), parts - 1).cast("bigint")

    null_cut = cut(F.lit(max(1, -(-n * seen["nulls"] // max(seen["rows"], 1)))))
    if not bounds:
        return F.lit(0), null_cut
    known, parts = F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.array(*[F.lit(times[b]) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, p: F.when(F.get(known, at + p - 1) < ident, at + p).otherwise(at))
    # descending: an id that is a bound comes first in its range, cut into as many parts as bounds fell on it
    hot = F.when(F.get(known, F.col("_below")) == ident, cut(F.get(parts, F.col("_below")))).otherwise(F.lit(n))
    place = F.when(ident.isNull(), F.lit(len(bounds) + 1) * (n + 1) + null_cut).otherwise(
        (F.lit(len(bounds)) - F.col("_below")) * (n + 1) + hot)
    return below, place


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs`` (null text: empty) with their keys and ``next_text``, the next document's."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k1, k2 = _key(F.col("text"))
    below, place = _range_of(rows)
    rows = rows.withColumn("k1", k1).withColumn("k2", k2).withColumn("_below", below)
    rows = rows.withColumn("part", place.cast("bigint")).drop("_below")
    # first row of each range: found by their keys, then fetched with their texts
    least = F.min(F.struct(F.col("doc_id").isNull(), F.bitwise_not(F.col("doc_id")), "k1", "k2")).alias("m")
    heads = rows.groupBy("part").agg(least).select("part", F.col("m.k1").alias("k1"), F.col("m.k2").alias("k2"))
    heads = rows.join(F.broadcast(heads), ["part", "k1", "k2"]).select("part", "k1", "k2", "text").dropDuplicates(["part"])
    heads = stored(heads, "fp-heads")
    everything = Window.partitionBy(F.lit(0))
    before = heads.select("part", F.coalesce(F.lag("part").over(everything.orderBy("part")),
                                             F.max("part").over(everything)).alias("_into"))
    ahead = heads.join(before, "part").select(F.col("_into").alias("part"), "text", "k1", "k2", F.lit(True).alias("_ahead"))
    rows = rows.withColumn("_ahead", F.lit(False)).unionByName(ahead, allowMissingColumns=True)
    inside = Window.partitionBy("part").orderBy("_ahead", F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2"))
    rows = rows.withColumn("next_text", F.lead("text").over(inside))
    return rows.where(~F.col("_ahead")).select("doc_id", "text", "k1", "k2", "next_text")


def edited(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`with_next` with ``n_chars`` and ``edited``."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return rows.withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                           F.substring(F.col("next_text"), F.lit(1), half)))


def compare(docs: DataFrame, query_every: int = 50, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For every row of ``docs``: ``doc_id, n_chars, edited_sha256``, the fingerprints of its text and its edited
    text (``fp``, ``edited_fp``), ``near_edited``, ``near_next``, and ``n_near``: for ids divisible by
    ``query_every`` the number of other fingerprints of the corpus within ``radius`` bits, else null."""
    rows = edited(with_next(docs))
    own = rows.select("doc_id", "n_chars", "k1", "k2", F.sha2("edited", 256).alias("edited_sha256"),
                      *[k.alias(n) for k, n in zip(_key(F.col("edited")), ("e1", "e2"))],
                      *[k.alias(n) for k, n in zip(_key(F.col("next_text")), ("n1", "n2"))])
    own = stored(own, "fp-rows")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    fps = stored(simhash(texts.select(*[k.alias(n) for k, n in zip(_key(F.col("text")), ("k1", "k2"))], "text")), "fp-texts")
    changed = rows.select(*[k.alias(n) for k, n in zip(_key(F.col("edited")), ("k1", "k2"))], F.col("edited").alias("text"))
    efps = stored(simhash(changed), "fp-edited")

    def look_up(to: DataFrame, found: DataFrame, a: str, b: str, name: str) -> DataFrame:
        other = found.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("fp").alias(name))
        return to.join(other, [a, b], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))

    own = look_up(own, fps, "k1", "k2", "fp")
    own = look_up(own, efps, "e1", "e2", "edited_fp")
    own = look_up(own, fps, "n1", "n2", "next_fp")
    own = stored(own.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"), "fp-found")
    asked = F.col("doc_id") % query_every == 0
    pairs = near(own.where(asked).select("fp").distinct(), own.select("fp").distinct(), radius, blocks)
    counts = pairs.groupBy("query").agg((F.count(F.lit(1)) - 1).alias("n_near"))  # without itself
    # joined by fingerprint, not by "fingerprint if asked": one null key would hold nearly all rows
    return own.join(counts, own["fp"] == counts["query"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.when(asked, F.col("n_near")).alias("n_near"))
