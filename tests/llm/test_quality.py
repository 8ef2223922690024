"""Operator 4: rules against a plain loop, score against counted multinomials, held-out labels."""

import collections
import math

from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.llm import quality as K, queries


def rules(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, covered = collections.Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered[i:i + 8] = [True] * 8
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n, repeat = len(words), sum(covered)
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), repeat, n < 20 or 100 * repeat > 30 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_rules_and_labels(spark, documents):
    rows = {r.doc_id: r for r in queries.op4_quality_rules(spark, SF01).collect()}
    assert len(rows) == len(documents)
    for d, r in rows.items():
        assert tuple(r[c] for c in COLUMNS) == rules(documents[d].text)
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    judged = [(x.quality, rows[x.doc_id].kept) for x in labels if x.doc_id in rows and not rows[x.doc_id].base_failed]
    good = [k for q, k in judged if q == 1]
    bad = [k for q, k in judged if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_score_equals_counted_multinomials(spark):
    texts = {i: " ".join(f"w{(i * j) % 13}" for j in range(1, 40 + i)) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id long, quality int")
    buckets, smooth = 64, 50.0
    grams = {r.doc_id: list(r.g) for r in K.hashed(docs).select("doc_id", F.concat("_u", "_b").alias("g")).collect()}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(x % buckets for x in g)
        if i < 4:
            trusted.update(x % buckets for x in g)
    n, t = sum(raw.values()), sum(trusted.values())
    base = [(raw[b] + 0.5) / (n + 0.5 * buckets) for b in range(buckets)]
    w = [math.log((trusted[b] + smooth * base[b]) / ((t + smooth) * base[b])) for b in range(buckets)]
    for r in K.judge(docs, labels, buckets=buckets, smoothing=smooth).collect():
        g = grams[r.doc_id]
        assert abs(r.score - sum(w[x % buckets] for x in g) / len(g)) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= K.THRESHOLD)


def test_trusted_ids(spark, labels):
    assert [r._trusted for r in K.trusted_ids(labels).orderBy("_trusted").collect()] == [1, 99]
    assert K.trusted_ids(labels, 1).count() == 1


def test_edges(spark, edge, none, labels, no_labels, clashing):
    for own in (labels, no_labels):
        rows = K.judge(edge, own).collect()
        assert len(rows) == edge.count()
        for r in rows:
            assert tuple(r[c] for c in COLUMNS) == rules(r.text)
    assert all(r.score == 0.0 for r in K.judge(edge, no_labels).collect())
    assert K.judge(none, labels).count() == 0 and K.keep_good(none, no_labels).count() == 0
    out = K.keep_good(clashing, labels)
    assert out.columns == clashing.columns
    assert all((r.kept, r.score, r.n_chars) == ("own kept", "own score", r.n_chars) for r in out.collect())


def test_repeats_in_long_texts(spark):
    import random
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (7, 8, 9, 30, 400, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in K.measured(docs).collect():
        assert r.n_repeat_words == rules(r.text)[4]
