"""Operator 3 against brute force: fingerprints, the next document, and all pairs within the radius."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.llm import fingerprints as P, queries


def xx(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed=seed)


def simhash(text: str) -> int:
    """Spark hashes several values by passing each hash on as the seed of the next."""
    words = [w for w in text.encode().split()]
    terms = list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] if words else []
    votes, total = [0] * 64, 0
    for t in terms:
        h = 42
        for w in t:
            h = xx(w, h)
        weight = sum(len(w.decode()) for w in t).bit_length()
        total += weight
        for i in range(64):
            votes[i] += weight * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_query(spark, documents):
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF01).collect()}
    order = sorted(documents, reverse=True)
    fps = {int(r.fingerprint, 16) for r in got.values()}
    for i, d in enumerate(order):
        text, following = documents[d].text, documents[order[(i + 1) % len(order)]].text
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = simhash(text), simhash(edited), simhash(following)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (a, b)
        assert abs(r.near_edited - (1 - (a ^ b).bit_count() / 64)) < 1e-12
        assert abs(r.near_next - (1 - (a ^ c).bit_count() / 64)) < 1e-12
        assert r.n_near == (sum((a ^ x).bit_count() <= P.RADIUS for x in fps) - 1 if d % 50 == 0 else None)
    assert len(got) == len(documents)


def test_block_tables_find_every_pair_once(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 7, 1 << 63}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = sorted((r.query % (1 << 64), r.fp % (1 << 64)) for r in P.near(df, df).collect())
    want = sorted((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= P.RADIUS)
    assert got == want


def test_edges(spark, edge, none, clashing):
    rows = P.compare(edge).collect()
    assert len(rows) == edge.count()
    assert {r.fp for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert len({r.fp for r in rows if r.doc_id in (6, 7)}) == 1
    last = next(r for r in rows if r.doc_id is None)  # the next of the last is the first: id 10
    text = "a text without any id, yet it has words"
    half = len(text) // 2
    top = edge.where("doc_id = 10").first().text
    assert last.edited_sha256 == hashlib.sha256((text[:len(text) - half] + top[:half]).encode()).hexdigest()
    assert P.compare(none).count() == 0
    one = P.compare(edge.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert P.compare(clashing).count() == clashing.count()


def test_next_is_right_for_many_ranges(spark):
    n = 5000
    docs = spark.range(n).select(((F.col("id") * 7919) % n).alias("doc_id")).withColumn("text", F.concat(F.lit("t"), "doc_id"))
    rows = P.with_next(docs).select("doc_id", "next_text").collect()
    assert len(rows) == n
    assert all(r.next_text == f"t{(r.doc_id - 1) % n}" for r in rows)
