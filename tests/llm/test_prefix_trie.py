"""Operator 12: SQL parity, and every node against a plain walk over all prefixes."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from conftest import SF01
from fedsearch.llm import prefix_trie as T
from fedsearch.llm import queries
from oracle_compare import compare, duck

SCHEMA = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """rows: (conv_id, turn, role, text) -> conv_id -> its sequence of (role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, name, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def plain_trie(seqs):
    nodes = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in nodes}
    children = defaultdict(set)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(nodes[p]) - 1) * words[p]
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(p)))).encode()).hexdigest())
                  for p, cs in nodes.items())


def got(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.collect())


def test_query_equals_sql(spark):
    r = compare(spark, duck(SF01), "op12", queries.op12_prefix_trie, queries.ORACLE["op12_prefix_trie"], SF01)
    assert r["ok"], r


def made(seed):
    """Conversations with common starts, copies, long runs side by side, nulls, ties and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in range(150):
        n = r.choice([1, 1, 2, 3, 5, 9])
        for t in range(n):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d e f"])))
    deep = [("user", f"turn {i} of many") for i in range(60)]
    for c in range(200, 230):  # side by side for 55 turns and more, some the same to the end
        end = r.choice([55, 57, 60])
        rows += [(c, t, *deep[t]) for t in range(end)]
    rows += [(300 + i, None if i % 3 else t, "user", "hot") for i in range(120) for t in range(2)]
    rows += [(None, 1, "user", "no conversation"), (7, 0, "user", "a b"), (7, 0, "user", "a b"), (-7, 1, "user", "x"), (-20, 1, "user", "y")]
    rows += [(1001, 1, "user", "word " * 20_000)]
    return rows


@pytest.mark.parametrize("container_turns", [1, 40, 1_024, 1 << 30])
def test_brute_force(spark, container_turns):
    rows = made(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", heads string").repartition(5)
    want = plain_trie(rebuilt(rows))
    assert got(T.prefix_trie(df, container_turns)) == want
    assert want[0][0] == -20 and any(n[1] == 60 for n in want)


def test_turnless_and_equal_and_none(spark):
    alone = [(c, 0, "user", "hello") for c in (41, 42, 43, 44, 47)]  # no conversation 40: some lose their only turn
    df = spark.createDataFrame(alone, SCHEMA)
    assert any(not s for s in rebuilt(alone).values())
    assert got(T.prefix_trie(df)) == plain_trie(rebuilt(alone))
    same = [(c, t, "user", str(t)) for c in (100, 101, 102) for t in range(3)]
    assert got(T.prefix_trie(spark.createDataFrame(same, SCHEMA), 1)) == plain_trie(rebuilt(same))
    assert T.prefix_trie(df.limit(0)).count() == 0
    assert T.prefix_trie(df.withColumn("conv_id", df.conv_id * None)).count() == 0


def test_a_long_conversation_and_many_copies(spark):
    seqs = {c: [("user", str(i)) for i in range(3_000 + (c > 1))] for c in range(4)}
    turns = spark.createDataFrame([(c, [(f"{int(t):032x}", 1) for _, t in s]) for c, s in seqs.items()],
                                  "conv_id long, turns array<struct<id:string,words:int>>")
    rows = {(r.conv_id, r.depth): r for r in T.trie(turns, 100).collect()}
    assert len(rows) == 3_002 and rows[0, 0].saved_tokens == 3 * 3_000 + 1 and rows[2, 3_001].n_convs == 2
    ids = spark.range(20_000).selectExpr("'k' as key", "id as conv_id").repartition(7)
    want = hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
    assert [tuple(r) for r in T.ends_digests(ids).collect()] == [("k", want)]
