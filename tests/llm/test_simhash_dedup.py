"""Operator 8 against all pairs of fingerprints; BK-trees, components."""

import random

import pytest
import xxhash

from conftest import SF01
from fedsearch.llm import queries, simhash_dedup as S
from fedsearch.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(fps, radius=3):
    """Smallest id reachable for each id, over all pairs."""
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_query(spark, documents):
    fps = {d: fingerprint(r.text) for d, r in documents.items()}
    want = groups(fps)
    rows = queries.op8_simhash_near_dedup(spark, SF01).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_bk_tree_finds_all_within():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(4)]
    tree = S.BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:80] + [rng.getrandbits(64) for _ in range(20)]:
        assert sorted(tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)
    assert S.BKTree().within(1, 3) == []


@pytest.mark.parametrize("shard_rows", [4096, 5, 2])
def test_links_keep_components_when_shards_are_cut(spark, shard_rows):
    """Dense and sparse clusters, chains along several blocks, extreme values."""
    rng = random.Random(shard_rows)
    fps = {0, 1, (1 << 64) - 1, 1 << 63, 0xFFFF}
    for _ in range(12):
        base = x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        for _ in range(10):
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    want = groups({f: f for f in fps})
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = S.fingerprint_links(df, shard_rows=shard_rows)
    roots = {r.node: r.root for r in components(links).collect()}
    assert {f: roots.get(s, s) for f, s in signed.items()} == {
        f: min(signed[g] for g in signed if want[g] == want[f]) for f in signed}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    pairs = chain + star + noise + [(5, 5), (7, 6)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    nodes = {x for p in pairs for x in p}
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in nodes} == {x: root(x) for x in nodes}
    assert components(df.limit(0)).count() == 0


def test_edges(spark, edge, none, clashing):
    rows = S.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[2] == by[3] == by[4] and next(iter(by[2])) == (0, 2)
    assert by[6] == by[7] and len(by[6]) == 1
    assert S.near_duplicates(none).count() == 0 and S.keep_one(none).count() == 0
    kept = S.keep_one(clashing)
    assert kept.columns == clashing.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert len(got) == len({x for v in by.values() for x in v}) and got.count(6) == 1 and 7 not in got
    assert {r.fp for r in kept.collect()} == {"own fp"}


def test_groups_of_the_same_name_are_kept_apart(spark):
    """Null ids, and one id with texts that do not link."""
    rows = [(None, "harbour lights were seen from the northern hill at dusk"), (None, "bread rises slowly in a cold kitchen"),
            (None, "Bread rises slowly in a cold kitchen"), (5, "seven trains left the station before noon on monday"),
            (5, "a painter mixed blue and green for the river"), (6, "A painter mixed blue and green for the river"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in S.near_duplicates(docs).collect()} == {None, 5}
    got = [(r.doc_id, (r.text or "").lower()) for r in S.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted({(d, (t or "").lower()) for d, t in rows if d != 6}, key=str)


def test_fewer_words_than_a_shingle():
    assert S.fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", seed=42)
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0
    text = ("word " * 70_000 + "end").encode()
    assert S.fingerprint(text) == fingerprint(text.decode())
