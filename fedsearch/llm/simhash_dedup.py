"""Near-duplicate groups by SimHash and BK-trees (operator 8).

Fingerprint: 64 bits over the word shingles of the lower-cased text; bit i is 1
if it is set in more than half of the shingles' XXH64 values. Two documents
link if their fingerprints differ in at most ``radius`` bits; a group is a
connected component of links, named by its smallest ``doc_id``.

Search. Equal fingerprints are merged first. The bits are cut into
``radius + 1`` blocks: two fingerprints within the radius agree on one block at
least, so the fingerprints that share a block form a shard, and every link lies
inside a shard. Each shard's BK-tree (children keyed by their distance to the
parent) is built by the task that holds the shard, and its members are looked
up following only the edges within the radius of their distance. A shard of
more than ``shard_rows`` fingerprints is cut again by the blocks of the other
bits; what is still larger is cut into parts, and the tree of a part is sent
to one task per part that it meets. So no task holds more than two parts, and
no link is lost. A task returns, for its shard, one link from each linked member to the
smallest one it reaches there, never all pairs.

Scale. Texts are read once and never shuffled; what moves is ``(key, long)``
rows, four per distinct fingerprint. The expected work per lookup grows with
n / 2**16 and, in large shards, with n / 2**28.

Edge cases. Null, empty or blank text: fingerprint 0, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Null
``doc_id``: grouped like others; a group without any id has a null name.
Repeated ``doc_id`` with texts that do not link: groups of the same name, told
apart by their root. Repeated rows: same fingerprint, same group. Empty table: empty result. Other
columns are ignored, or kept by :func:`keep_one`.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import pack, stored, unpack
from fedsearch.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3
SHARD_ROWS = 4096
#: Fixed value of the contract: seed of XXH64.
SEED = 42
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text. ASCII-only lower-casing and splitting, as ``bytes`` does them."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return _hash(b" ".join(words))
    hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))),
                         dtype="<u8", count=len(words) - shingle_words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of a very long text
        part = hashes[at:at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a long) and ``text_hash`` per row of ``docs``."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), b.column("text_hash")],
                names=["doc_id", "fp", "text_hash"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, fp long, text_hash long")


class BKTree:
    """Integers under the Hamming distance; the children of a node are keyed by their distance to it."""

    def __init__(self):
        self.root = None

    def insert(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while (d := (value ^ node[0]).bit_count()) in node[1]:
            node = node[1][d]
        node[1][d] = (value, {})

    def within(self, value: int, radius: int) -> list[int]:
        """All values at a distance of at most ``radius``: by the triangle
        inequality only the edges d - radius to d + radius can lead to one."""
        found, open_ = [], [self.root] if self.root else []
        while open_:
            at, children = open_.pop()
            d = (value ^ at).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                if len(children) <= 2 * radius + 1:
                    open_ += [child for e, child in children.items() if d - radius <= e <= d + radius]
                else:
                    open_ += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


def shard_links(values: list[int], sides: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one shard, as ``(member, smallest member reached)``.

    Side 0: members of the tree that are looked up in it; 1: members of the
    tree only; 2: looked up only.
    """
    tree, parent = BKTree(), {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for v, s in sorted(zip(values, sides), key=lambda x: x[1]):
        if s != 1:
            for other in tree.within(v, radius):
                a, b = root(v), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if s != 2:
            tree.insert(v)
    return [(v, r) for v in values if (r := root(v)) != v]


def _search(batches, radius: int):
    """Runs over rows sorted by shard; a shard may reach over several batches."""
    key, values, sides = None, [], []
    out_a, out_b = [], []

    def close():
        if len(values) > 1:
            for a, b in shard_links(values, sides, radius):
                out_a.append(a)
                out_b.append(b)

    def emit():
        a = np.array(out_a, dtype=np.uint64).view(np.int64)
        b = np.array(out_b, dtype=np.uint64).view(np.int64)
        out_a.clear()
        out_b.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        keys = np.asarray(batch.column("key"))
        fps = np.asarray(batch.column("fp")).view(np.uint64)
        side = np.asarray(batch.column("side"))
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else [0]
        for lo, hi in zip(starts[:-1], starts[1:]):
            if keys[lo] != key:
                close()
                key, values, sides = keys[lo], [], []
            values += fps[lo:hi].tolist()
            sides += side[lo:hi].tolist()
        yield emit()
    close()
    yield emit()


def _blocks(fp: Column, widths: list[int], at: int = 0) -> list[Column]:
    out = []
    for w in widths:
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1).cast("long")))
        at += w
    return out


def _even(bits: int, parts: int) -> list[int]:
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def _counted(rows: DataFrame, shard_rows: int) -> DataFrame:
    """``rows`` with the size ``n`` of their shard where it is above ``shard_rows``, else null."""
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    return rows.join(large, "key", "left")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (``fp``) that keep the components of all links."""
    widths = _even(64, radius + 1)
    fp = F.col("fp")
    first = distinct.select("fp", F.posexplode(F.array(*_blocks(fp, widths))).alias("block", "value"))
    first = first.select("fp", "block", F.xxhash64("block", "value").alias("key"))
    first = stored(_counted(first, shard_rows), "simhash-shards")
    # large shards: the other bits are cut into radius + 1 blocks again
    offsets = [sum(widths[:i]) for i in range(len(widths))]
    others = F.array(*[F.array(*_blocks(  # the bits after block i, round the end
        F.shiftrightunsigned(fp, offsets[i] + w).bitwiseOR(F.shiftleft(fp, 64 - offsets[i] - w)) if offsets[i] + w < 64
        else fp, _even(64 - w, radius + 1))) for i, w in enumerate(widths)])
    second = (first.where("n is not null")
              .select("fp", "key", F.posexplode(F.get(others, F.col("block"))).alias("sub", "value"))
              .select("fp", F.xxhash64("key", "sub", "value").alias("key")))
    second = stored(_counted(second, shard_rows), "simhash-second")
    # what is still large: parts, each met with each
    third = second.where("n is not null").withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    third = (third.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .select("fp", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"),
                     F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1)
                     .otherwise(2).alias("side")))
    tasks = (first.where("n is null").select("key", "fp", F.lit(0).alias("side"))
             .union(second.where("n is null").select("key", "fp", F.lit(0).alias("side")))
             .union(third.select("key", "fp", "side")))
    return (tasks.repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda batches: _search(batches, radius), "u long, v long"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS,
                    shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, fp, text_hash, root, component_id`` for every row of ``docs``.

    ``root``, the smallest fingerprint, tells the groups apart. The name does
    not: groups without any id are all named null, and texts that do not link
    may hold the same id.
    """
    fps = stored(fingerprints(docs, shingle_words), "simhash-fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius, shard_rows), "simhash-links")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = named.join(names, "root").select("fp", "root", "component_id")
    return fps.join(groups, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest ``doc_id`` (ties: smallest text hash)."""
    groups = stored(near_duplicates(docs, **options), "simhash-groups")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = (groups.groupBy("root").agg(F.min(first).alias("k"))
            .select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")))
    rows = pack(docs, "doc_id", "text").withColumn("_text", F.xxhash64("text"))
    one = (rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_text"] == kept["_hash"]), "left_semi")
           .dropDuplicates(["doc_id", "_text"]))
    return unpack(one, docs)
