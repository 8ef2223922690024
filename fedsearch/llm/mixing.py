"""Mixing sources to target weights (operator 1).

Every source gets a target in words (its weight's share of the wanted total,
at most ``max_repeat`` times its size, the excess reshared by weight). The
corpus is laid out in blocks of ``block_words`` words and the blocks are
apportioned by Sainte-Lague: the seats go to the highest quotients
``votes / (2j + 1)``, first among the sources (votes: targets), then among the
shards of each source (votes: shard sizes). A shard then takes its quota of
blocks: its stretches of ``stretch_blocks`` neighbouring blocks come in the
order of a seeded hash, the blocks of a stretch in their own order, so that
what is taken are long passages and whole documents, and only one stretch of a
shard is taken in part. A quota above the number of blocks takes every block
once and repeats the first in that order.

Scale. Texts are read once, for their word counts; all later steps carry
``(doc_id, size)`` rows. A source is cut into shards of about ``shard_words``
words by a hash of the document, so a source that holds a third of all rows
is a third of all shards; prefix sums run inside a shard. The highest
quotients are found without listing all: every seat but at most two per
competitor is settled by bounds on the divisor (see :func:`sainte_lague`).
Source rows (one per distinct source) meet in a single task, and so do the
shard rows of each source: one per ``shard_words`` words, which grows with the
largest source.

Edge cases. Null text: size 0, nothing taken. Null source: a source of its
own, last in order. Empty table: empty result. Repeated rows: each is a
document of its own (same shard, next to each other). A very long document
spans many blocks and may be taken in part. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.llm.common import keep_where, n_words, pack, stored, unpack

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 16
STRETCH_BLOCKS = 64
SHARD_WORDS = 65_536
SEED = 20_240_917


def sainte_lague(rows: DataFrame, groups: list[str], ident: str, votes: str, seats: str) -> DataFrame:
    """Add ``won``: the seats each row wins of its group's ``seats`` total.

    ``rows`` has the group columns, ``ident`` (unique in the group), ``votes``
    and ``seats``. With k competitors, n seats and V votes, rounding
    ``v / d`` at the divisor ``V / (n - k/2)`` hands out at most n seats and at
    ``V / (n + k/2)`` at least n; the first are won for certain, and only the
    quotients between the two bounds (about 2k, one more on either side
    against rounding errors) are listed and ranked. Ties go to the smaller
    ``ident``.
    """
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    k, total = F.col("_k").cast("double"), F.col("_v")
    bounds = (rows.where(F.col(votes) > 0)
              .withColumn("_k", F.count(F.lit(1)).over(w))
              .withColumn("_v", F.sum(F.col(votes).cast("double")).over(w))
              .withColumn("_sure", F.greatest(F.floor(v * (n - k / 2) / total + 0.5) - 1, F.lit(0)))
              .withColumn("_most", F.greatest(F.floor(v * (n + k / 2) / total + 0.5) + 1, F.lit(0)))
              .withColumn("_left", F.col(seats) - F.sum("_sure").over(w)))
    listed = (bounds.where("_most > _sure")
              .select(*groups, ident, "_left", F.col(votes).cast("double").alias("_votes"),
                      F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_j"))
              .withColumn("_quotient", F.col("_votes") / (2 * F.col("_j") + 1)))
    ranked = listed.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_quotient"), ident, "_j")))
    more = (ranked.where("_rank <= _left").groupBy(*groups, ident)
            .agg(F.count(F.lit(1)).alias("_more")))
    sure = bounds.select(*groups, ident, "_sure")
    return (rows.join(sure, [*groups, ident], "left").join(more, [*groups, ident], "left")
            .withColumn("won", (F.coalesce("_sure", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("bigint"))
            .drop("_sure", "_more"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``source_no``, ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sharing by weight and resharing what the caps cut off ends at one level L
    with ``target = min(cap, L * weight)``. In the order of cap / weight the
    capped sources come first, so L is found by running sums.
    """
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.asc_nulls_last("source"))
    rows = (sources.withColumn("source_no", F.row_number().over(named))
            .withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]),
                                        F.pmod(F.col("source_no") - 1, F.lit(len(weights)))))
            .withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
            .withColumn("_ratio", F.col("_cap") / F.col("weight")))
    before = everything.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    want = share * F.sum("source_size").over(everything)
    level = ((want - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source whose cap is not reached sets the level; none: all are capped
    rows = (rows.withColumn("_level", level)
            .withColumn("_free", F.min(F.when(F.col("_level") <= F.col("_ratio"),
                                              F.struct("_ratio", "source_no", "_level"))).over(everything)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_free._level") * F.col("weight"), F.col("_cap")))
    return rows.withColumn("target", target).drop("_cap", "_ratio", "_level", "_free")


def _block_order(seed: int, stretch: int, block: Column) -> Column:
    """What the blocks of a shard are taken by: the seeded hash of their stretch, then their place."""
    block = block.cast("bigint")
    return F.struct(F.xxhash64(F.lit(seed).cast("bigint"), F.col("source_no").cast("bigint"), F.col("shard").cast("bigint"),
                               F.floor(block / stretch).cast("bigint")).alias("h"), block.alias("b"))


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
        block_words: int = BLOCK_WORDS, stretch_blocks: int = STRETCH_BLOCKS, shard_words: int = SHARD_WORDS, seed: int = SEED,
        keep: list[str] | None = None) -> DataFrame:
    """What the mix takes of every document of ``docs`` (``doc_id``, ``text``, ``source``).

    Returns ``doc_id, source, size, source_size, target, taken`` and
    ``block_times``: for each block of the shard that the document touches,
    ``(words, times)``: how many of its words lie there, in order, and how
    often the mix takes them.
    """
    base = stored(docs.select(
        "doc_id", "source", n_words("text").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("_h"), *(keep or [])), "mix-sizes")
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")),
                      weights, share, max_repeat)
    everything = Window.partitionBy(F.lit(0))
    sources = (sources.withColumn("_seats", F.round(F.sum("target").over(everything) / block_words).cast("bigint"))
               .withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("bigint")))
    sources = stored(sainte_lague(sources, [], "source_no", "target", "_seats")
                     .select("source", "source_no", "source_size", "target", "_shards",
                             F.col("won").alias("source_blocks")), "mix-sources")

    placed = (base.join(sources, base["source"].eqNullSafe(sources["source"]))
              .drop(sources["source"])
              .withColumn("shard", F.pmod(F.col("_h"), F.col("_shards"))))
    sizes = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"),
                                                     F.first("source_blocks").alias("source_blocks"))
    quotas = sainte_lague(sizes, ["source_no"], "shard", "shard_size", "source_blocks")
    n = F.ceil(F.col("shard_size") / block_words).cast("bigint")
    hashes = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1),
                         lambda b: _block_order(seed, stretch_blocks, b))
    # the quota's remainder takes the first blocks in order: `_cut` is the last of them
    quotas = (quotas.where("shard_size > 0").withColumn("_n", n)
              .withColumn("_all", F.floor(F.col("won") / F.col("_n")).cast("bigint"))
              .withColumn("_rest", F.col("won") % F.col("_n"))
              .withColumn("_cut", F.when(F.col("_rest") > 0,
                                         F.get(F.sort_array(hashes), (F.col("_rest") - 1).cast("int"))))
              .select("source_no", "shard", "_all", "_cut"))

    in_shard = Window.partitionBy("source_no", "shard").orderBy("_h", "doc_id", "size")
    laid = placed.withColumn("_end", F.sum("size").over(
        in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    laid = laid.withColumn("_start", F.col("_end") - F.col("size")).join(quotas, ["source_no", "shard"], "left")

    def taken_of(b: Column) -> Column:
        own = (F.least(F.col("_end"), (b + 1) * block_words) - F.greatest(F.col("_start"), b * block_words))
        extra = F.when(_block_order(seed, stretch_blocks, b) <= F.col("_cut"), 1).otherwise(0)
        return F.struct(own.cast("int").alias("words"),
                        F.least(F.col("_all") + extra, F.lit(max_repeat)).cast("int").alias("times"))

    blocks = F.when(F.col("size") > 0, F.transform(
        F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words)), taken_of))
    empty = F.array().cast("array<struct<words:int,times:int>>")
    return (laid.withColumn("block_times", F.coalesce(blocks, empty))
            .withColumn("taken", F.aggregate("block_times", F.lit(0).cast("bigint"),
                                             lambda a, x: a + x["words"].cast("bigint") * x["times"]))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "block_times", *(keep or [])))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with, for each pass (1 to the most repeats), the words taken.

    A document appears once for every time that some of its blocks are taken,
    with the words of those blocks and the white space after them; documents
    of which nothing is taken go. ``n_chars`` is that of the new text.
    """
    rows = mix(pack(docs, "doc_id", "text", "source"), keep=["text", "_row"], **options)
    block = options.get("block_words", BLOCK_WORDS)
    times = F.transform("block_times", lambda x: x["times"])
    rows = rows.withColumn("_times", times).withColumn("_first", F.get("block_times", F.lit(0))["words"])
    rows = keep_where(rows.withColumn("_most", F.coalesce(F.array_max("_times"), F.lit(0))), "_most > 0")
    # words with the white space after them, of documents that some pass takes in part
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.withColumn("_pieces", F.when(F.array_min("_times") < F.col("_most"), pieces))

    def in_pass(i: Column, p: Column) -> Column:
        """Whether word i is taken: the first block holds ``_first`` of the words, each other ``block``."""
        at = F.when(i < F.col("_first"), 0).otherwise(1 + F.floor((i - F.col("_first")) / block).cast("int"))
        return F.get(F.col("_times"), at) >= p

    texts = F.transform(F.sequence(F.lit(1), F.col("_most")), lambda p: F.when(F.array_min("_times") >= p, F.col("text")).otherwise(
        F.array_join(F.filter("_pieces", lambda x, i: in_pass(i, p)), "")))
    out = rows.select("_row", "doc_id", "source", F.explode(texts).alias("text"))
    return unpack(out, docs, **({"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {}))
