"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the corpus (operator 4).

Two multinomials over ``buckets`` hashed word unigrams and bigrams are counted:
one over every document, one over the trusted documents. A document's score is
the mean over its n-grams of ``log(p_trusted / p_corpus)``; it is kept if plain
rules pass and the score reaches ``threshold``, a fixed number, so a document's
verdict never depends on a random draw. The trusted counts are smoothed towards
the corpus (``smoothing`` pseudo-counts spread like the corpus), so a bucket
that the trusted text hardly shows says little, and without any trusted text
all scores are 0.

Everything is built of DataFrame functions. A text is split once; its words
become 64-bit hashes, pairs of hashes the bigrams, pairs of those the four- and
eight-word windows that the repetition rule compares.

Scale. Two passes over the texts, neither of which shuffles them: the first
shuffles at most ``buckets`` counts per task, the second only maps. The
weights are one array of ``buckets`` numbers. Trusted documents are chosen
among the labelled ones as the ``trusted_rows`` with the smallest hashes: that
documented bound is what makes their ids safe to broadcast; the corpus counts
cover all rows.

Edge cases. Null, empty or blank text: no words, all counts 0, fails the rules,
score 0. Fewer than 8 words: no repeated window. Null labels or label rows of
unknown documents: ignored; contradicting labels: not trusted. Repeated rows:
each counted and judged. Empty tables: empty result, or all scores 0. Other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import BLANK_RUN, keep_where, pack, stored, unpack, words

BUCKETS = 1 << 14
SMOOTHING = 1 << 14
TRUSTED_ROWS = 20_000
THRESHOLD = -0.07
#: Fixed values of the contract.
SYMBOLS = "[^#*$%&|<>]++"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids (``_trusted``) of documents whose labels all say quality 1."""
    ids = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
           .agg(F.min("quality").alias("_q")).where("_q = 1").select(F.col("doc_id").alias("_trusted")))
    return ids.orderBy(F.xxhash64("_trusted"), "_trusted").limit(rows)


def _pairs(hashes: str, step: int) -> Column:
    """Hash of each element with the one ``step`` places on."""
    c = F.col(hashes)
    return F.when(F.size(c) > step, F.transform(
        F.slice(c, 1, F.greatest(F.size(c) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(c, i + step)))
    ).otherwise(F.array().cast("array<bigint>"))


#: The columns that :func:`judge` adds.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_u``: the hash of each word, and ``_b``: of each pair of neighbours."""
    return (docs.withColumn("_u", F.transform(words("text"), lambda x: F.xxhash64(x)))
            .withColumn("_b", _pairs("_u", 1)))


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING,
          trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row: ``w``, the log-likelihood ratio of each bucket in order."""
    ids = F.broadcast(trusted_ids(labels, trusted_rows))  # at most `trusted_rows` ids
    docs = docs.select("doc_id", "text")
    marked = docs.join(ids, docs["doc_id"] == ids["_trusted"], "left").select(
        "text", F.col("_trusted").isNotNull().cast("long").alias("_t"))
    grams = hashed(marked).select("_t", F.explode(F.concat("_u", "_b")).alias("_g"))
    counts = (grams.groupBy(F.pmod("_g", F.lit(buckets)).cast("int").alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = stored(every.join(counts, "bucket", "left").na.fill(0, ["n", "t"]), "quality-counts")
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    base = (F.col("n") + 0.5) / (F.col("all_n") + 0.5 * buckets)
    ratio = F.log((F.col("t") + smoothing * base) / ((F.col("all_t") + smoothing) * base))
    totals = counts.withColumn("all_n", total.select("all_n").scalar()).withColumn("all_t", total.select("all_t").scalar())
    weights = totals.select("bucket", ratio.alias("w"))
    # `buckets` rows meet here whatever the input's size
    return stored(weights.agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("w"))
                  .select(F.col("w.w").alias("w")), "quality-weights")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of the contract's plain rules, ``base_failed``, ``_u`` and ``_b``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    rows = hashed(docs).withColumn("_w4", _pairs("_b", 2)).withColumn("_w8", _pairs("_w4", 4))
    # Words in 8-word windows found twice: each window becomes one long, the high bits of its hash over its
    # place. Sorted, equal windows are neighbours, which their full hashes confirm; the places of windows
    # with an equal neighbour then add up to the words covered.
    rows = rows.withColumn("_mask", F.expr("shiftleft(1L, length(bin(size(_w8)))) - 1"))
    rows = rows.withColumn("_sorted", F.sort_array(F.transform(
        "_w8", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("bigint")))))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("_mask")).cast("int")

    def equal(x: Column, at: Column) -> Column:
        other = F.get(F.col("_sorted"), at)
        return other.isNotNull() & (F.get(F.col("_w8"), place(other)) == F.get(F.col("_w8"), place(x)))

    twice = F.sort_array(F.transform(F.filter("_sorted", lambda x, k: F.when(k > 0, equal(x, k - 1)).otherwise(F.lit(False))
                                              | equal(x, k + 1)), place))
    rows = rows.withColumn("_twice", twice)
    covered = F.aggregate(
        F.transform("_twice", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_twice"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = (rows.withColumn("n_words", F.size("_u").cast("bigint"))
            .withColumn("word_chars", F.length(F.regexp_replace(text, BLANK_RUN, "")).cast("bigint"))
            .withColumn("n_symbols", F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint"))
            .withColumn("_lines", lines)
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
            .withColumn("n_repeat_words", covered))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_w4", "_w8", "_mask", "_sorted", "_twice", "_lines")


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS,
          smoothing: float = SMOOTHING, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``
    (which replace columns of these names)."""
    weights = train(docs, labels, buckets, smoothing, trusted_rows).scalar()
    grams = F.concat("_u", "_b")
    mean = F.aggregate("_grams", F.lit(0.0), lambda a, x: a + F.get("_weights", F.pmod(x, F.lit(buckets)).cast("int")),
                       lambda a: a / F.size("_grams"))
    own = docs.drop(*MADE)
    rows = measured(pack(own, "text")).withColumn("_grams", grams).withColumn("_weights", weights)
    rows = (rows.withColumn("score", F.when(F.size("_grams") > 0, mean).otherwise(0.0))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))
    return unpack(rows.select("_row", "text", *MADE), own, _also=MADE)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    rows = keep_where(judge(pack(docs, "doc_id", "text"), labels, **options), "kept")
    return unpack(rows.select("_row", "doc_id", "text"), docs)
