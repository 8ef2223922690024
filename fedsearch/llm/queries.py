"""One query per operator, with its DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsearch.llm import (decontamination, edit_counts, filter_audit, fingerprints, mixing, pii, piece_tokens, prefix_trie, quality,
                           simhash_dedup, span_dedup, toxicity, warc)
from fedsearch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@query
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


ORACLE["op6_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f"""


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, likelihood-ratio score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).drop("text")


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [k.name for k in pii.KINDS if k.base]
    base = F.filter("spans", lambda s: s["kind_no"] < len(names))
    counts = [F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("bigint").alias(f"n_{name}")  # noqa: B023
              for no, name in enumerate(names)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s["score"]), ",").alias("scores"))


@query
def op7_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_tokens.round_trip(docs).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("patterns")


@query
def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat earlier spans."""
    return span_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after edits to its start, middle and end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")

    def edit(at, remove, insert):
        return F.struct(at.cast("bigint").alias("at"), F.lit(remove).cast("bigint").alias("remove"), insert.alias("insert"))

    edits = F.array(edit(F.lit(0), 0, F.concat_ws(" ", F.lit("From"), "source", F.lit("in"), "lang", F.lit("\n"))),
                    edit(F.floor(n / 2), 40, F.lit("")),
                    edit(F.floor(n / 3), 7, F.lit(" [revised 2024] ")),
                    edit(n, 0, F.lit("\nEnd.")))
    kept = edit_counts.trees(docs.withColumn("edits", edits))
    kept = kept.withColumn("before", F.col("n_tokens")).withColumn("n_leaves", F.greatest(F.size("leaf_chars"), F.lit(0)))
    return edit_counts.apply_edits(kept).select(
        "doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), "n_edits",
        F.col("n_leaves").cast("bigint").alias("n_leaves"), "encoded_chars")


def hex64(c: str):
    return F.lpad(F.lower(F.hex(c)), 16, "0")


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and near fingerprints of the query set."""
    found = fingerprints.compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", hex64("fp").alias("fingerprint"),
                        hex64("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in each of their orders, per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false) AS e,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT part, a::INT + b::INT * 2 + c::INT * 4 + d::INT * 8 + e::INT * 16 AS fails,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) v(name, bit)),
o AS (SELECT x1.name || x2.name || x3.name || x4.name || x5.name AS filter_order,
             [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
      FROM x x1, x x2, x x3, x x4, x x5
      WHERE len(list_distinct([x1.bit, x2.bit, x3.bit, x4.bit, x5.bit])) = 5),
w AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit,
             CAST(coalesce(list_sum(list_transform(bits[1:step - 1], lambda y: 1 << y)), 0) AS INT) AS before
      FROM o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, bit,
             CAST(sum(CASE WHEN fails & (before | (1 << bit)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN (fails >> bit) & 1 = 1 AND fails & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN (fails >> bit) & 1 = 1 AND fails & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails = 1 << bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN (fails >> bit) & 1 = 1 AND fails & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN (fails >> bit) & 1 = 1 AND fails & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM s, w GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id, words) AS place FROM t),
c AS (SELECT conv_id, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1),
          lambda i: ord(substr(conv_id::VARCHAR, i, 1))::UBIGINT)),
          lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::UBIGINT[]),
              lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
          4294967295::UBIGINT) % 4)::INT AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, o.place, o.id, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.place <= c.h
      UNION ALL SELECT c.conv_id, o.place, o.id, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.place > c.h),
d AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM r),
p AS (SELECT conv_id, depth, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
             coalesce(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up FROM d
      UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
e AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
n AS (SELECT path, any_value(up) AS up, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE e.n = depth), '')) AS ends_sha256
      FROM p JOIN e ON p.conv_id = e.conv_id GROUP BY path, depth),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
s AS (SELECT a.path, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
      FROM m JOIN p a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.path)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.path = s.path LEFT JOIN n u ON m.up = u.path"""


@query
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under windows of benchmark items, and these items."""
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("places") > 0).alias("contaminated"))


ORACLE["op13_benchmark_decontamination"] = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS n
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
v AS (SELECT id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
      FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT v.id, v.p, v.n, v.gram FROM v WHERE (v.gram, v.n) IN (SELECT gram, n FROM i)),
c AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM h) GROUP BY id),
t AS (SELECT id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT h.id, i.item_id FROM h JOIN i ON h.gram = i.gram WHERE i.item_id IS NOT NULL) GROUP BY id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.id = c.id LEFT JOIN t ON d.id = t.id"""
