"""Conversation prefix trie, built as burst tries (operator 12).

A conversation is the sequence of its turns' ids (a 128-bit digest of role and
text). Conversations with equal sequences become one row with a weight.

*Burst.* The root's container holds all sequences. A container above
``container_turns`` turns bursts: what its sequences share becomes trie heads,
and the next turn id behind it names the container that each goes on in; a
sequence that ends there stays with its head. The shared part is that of the
smallest and the largest sequence, so a burst always parts a container in two
or more, however long its members run side by side.

*Sweep.* The containers that are left are dealt out by their names, sorted,
and swept once: a stack holds the open nodes of the current sequence, and a
node closes with its sums when a sequence leaves it.

*Heads.* A head's sums are those of the containers and sequences below it,
added up along their paths.

Scale. Turns are shuffled as ids, never as texts. Copies of a conversation are
combined before the shuffle; the digest of their conversation ids is made of
packed pieces of a range-partitioned list. A container has at most
``container_turns`` turns or one sequence, whatever its first turns; a task
holds one container. The rounds of bursting are as many as the branchings on
the way to the deepest large container; each reads the containers still too
large, and only a count reaches the driver. A conversation is one row of 32
bytes a turn.

Edge cases. Null role or text: empty. Null turn: first; equal turns of a
conversation: by their ids, repeated rows are turns of their own. Null
``conv_id``: no conversation, left out; below zero ``%`` is SQL's (towards zero). Conversations without turns: members
of the root. Empty table: empty result. Very long texts: read once for their
digest and words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.llm.common import n_words, stored

CONTAINER_TURNS = 1_024
PIECE_IDS = 4_096
#: Hex digits of a turn id.
WIDTH = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` (in order, an array of ``id, words``) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select("conv_id", F.struct(
        F.col("turn"), turn_id.alias("id"), n_words(text).alias("words")).alias("t"))
    # nulls sort first
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def with_shared_starts(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``seqs`` with the first ``crc32(conv_id) % most`` turns taken from conversation ``conv_id - conv_id % every``."""
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    starts = (seqs.where(c % every == 0)
              .select(c.alias("_from"), F.slice("turns", 1, most - 1).alias("_start")))
    none = F.array().cast(seqs.schema["turns"].dataType)
    rows = seqs.withColumn("_h", head).join(starts, (c - c % every) == F.col("_from"), "left")
    rest = F.when(F.size("turns") > F.col("_h"), F.slice("turns", F.col("_h") + 1, F.size("turns"))).otherwise(none)
    start = F.when(F.col("_h") > 0, F.slice(F.coalesce("_start", none), 1, F.greatest("_h", F.lit(1)))).otherwise(none)
    return rows.select("conv_id", F.concat(start, rest).alias("turns"))


def _digest_pieces(batches):
    """Rows ``key, conv_id`` in order -> ``key, first, piece``: runs of a key's decimal ids, comma-joined."""
    key, ids, keys, firsts, pieces = None, [], [], [], []

    def close():
        if ids:
            keys.append(key)
            firsts.append(ids[0])
            pieces.append(",".join(map(str, ids)))

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or len(ids) == PIECE_IDS:
                close()
                key, ids = k, []
            ids.append(i)
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "first": pa.array(firsts, pa.int64()),
                               "piece": pa.array(pieces, pa.string())})
        keys, firsts, pieces = [], [], []
    close()
    yield pa.record_batch({"key": pa.array(keys, pa.string()), "first": pa.array(firsts, pa.int64()),
                           "piece": pa.array(pieces, pa.string())})


def _digests(batches):
    """Rows ``key, first, piece`` in order -> ``key, ends``: the digest of each key's joined pieces."""
    key, state, keys, ends = None, None, [], []
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if state is not None:
                    keys.append(key)
                    ends.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "ends": pa.array(ends, pa.string())})
        keys, ends = [], []
    if state is not None:
        yield pa.record_batch({"key": [key], "ends": [state.hexdigest()]})


def ends_digests(members: DataFrame) -> DataFrame:
    """``key, ends`` from stored ``key, conv_id``: SHA-256 of each key's ids, ascending and comma-joined.

    The ids of a key are packed where a range partition holds them; the task
    that digests a key reads a row per ``PIECE_IDS`` of its ids.
    """
    pieces = (members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(_digest_pieces, "key string, first long, piece string"))
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends string")


def distinct(seqs: DataFrame) -> DataFrame:
    """Stored ``seq, words, n_turns, n_convs, conv_id, ends``: a row per distinct sequence, with its members' number,
    smallest id and digest."""
    seq = F.array_join(F.col("turns")["id"], "")
    rows = stored(seqs.select("conv_id", F.md5(seq).alias("key"), seq.alias("seq"), F.col("turns")["words"].alias("words")),
                  "trie-sequences")
    one = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    # the sequence itself is read from its smallest member
    return stored(one.join(ends_digests(rows), "key")
                  .join(rows.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"), "seq", "words"),
                        (F.col("key") == F.col("_key")) & (F.col("conv_id") == F.col("_conv")))
                  .select("seq", "words", F.size("words").alias("n_turns"), "n_convs", "conv_id", "ends"), "trie-distinct")


def _names(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``name`` of their container: a digest of the path to its top node."""
    return rows.withColumn("name", F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"),
                                                  F.substring("seq", F.lit(1), F.col("depth") * WIDTH))))


def _shared(least: Column, most: Column) -> Column:
    """The number of first turns that the smallest and the largest of several sequences share."""
    turn_ids = F.lit(f".{{{WIDTH}}}")
    other = F.regexp_extract_all(most, turn_ids, F.lit(0))
    same = F.transform(F.regexp_extract_all(least, turn_ids, F.lit(0)), lambda x, i: x.eqNullSafe(F.get(other, i)))
    return F.when(F.forall(same, lambda x: x), F.size(same)).otherwise(F.array_position(same, False).cast("int") - 1)


def burst(rows: DataFrame, container_turns: int = CONTAINER_TURNS) -> tuple[DataFrame, DataFrame]:
    """``(contained, ended)``: the rows of :func:`distinct` that stay in containers and those that end at a trie head.

    Both carry ``heads``: the ``name``, ``start`` and ``end`` depth of every
    burst container on their path, whose shared turns are trie heads; contained
    rows carry the ``name`` of their container and the ``depth`` of its top node.
    """
    contained, ended = [], []
    none = F.array().cast("array<struct<name:string,start:int,end:int>>")
    open_rows = _names(rows.withColumn("depth", F.lit(0)).withColumn("heads", none))
    while True:
        found = open_rows.groupBy("name").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("n_turns") - F.col("depth") + 1).alias("turns"),
            F.max("depth").alias("depth"), F.min("seq").alias("least"), F.max("seq").alias("most"))
        # the root's container always bursts
        large = stored(found.where((F.col("n") > 1) & ((F.col("turns") > container_turns) | (F.col("depth") == 0)))
                       .select("name", _shared(F.col("least"), F.col("most")).alias("shared")), "trie-large")
        if large.isEmpty():
            return _all([*contained, open_rows]), _all(ended) if ended else open_rows.where("false").drop("name", "depth")
        marked = stored(open_rows.join(large, "name", "left"), "trie-open")
        contained.append(marked.where("shared is null").drop("shared"))
        head = F.array(F.struct("name", F.col("depth").alias("start"), F.col("shared").alias("end")))
        gone = marked.where("shared is not null").withColumn("heads", F.concat("heads", head))
        ended.append(gone.where("n_turns = shared").drop("shared", "depth", "name"))
        open_rows = _names(gone.where("n_turns > shared").withColumn("depth", F.col("shared") + 1).drop("shared", "name"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class _Node:
    """An open node of the sweep; closed children wait in it for its smallest member."""

    __slots__ = ("children", "conv_id", "depth", "ends", "n_children", "n_convs", "n_leaves", "saved", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.ends, self.conv_id = depth, words, NO_ENDS, None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.children: list[tuple] = []

    def add(self, conv_id: int, n_convs: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs

    def close(self) -> Iterator[tuple]:
        """Its children's rows, now that their parent is known."""
        self.n_leaves = self.n_leaves or 1
        self.saved += (self.n_convs - 1) * self.words
        for conv_id, *rest in self.children:
            yield conv_id, self.depth + 1, self.conv_id, *rest

    def row(self) -> tuple:
        return self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved, self.ends


def sweep(rows: list[tuple]) -> Iterator[tuple]:
    """The nodes of a container, its top node last, with a null parent.

    ``rows``: ``(seq, words, n_convs, conv_id, ends, depth)`` in the order of ``seq``.
    """
    stack: list[_Node] = []
    before = ""
    top = rows[0][5]

    def leave(depth: int) -> Iterator[tuple]:
        while stack and stack[-1].depth > depth:
            node = stack.pop()
            yield from node.close()
            if stack:
                up = stack[-1]
                up.children.append(node.row())
                up.n_children += 1
                up.n_leaves += node.n_leaves
                up.saved += node.saved
                up.add(node.conv_id, node.n_convs)
            else:
                yield node.conv_id, node.depth, None, *node.row()[1:]

    for seq, words, n_convs, conv_id, ends, _ in rows:
        shared = top - 1
        while stack and shared < len(words) and shared < stack[-1].depth and \
                seq[shared * WIDTH:(shared + 1) * WIDTH] == before[shared * WIDTH:(shared + 1) * WIDTH]:
            shared += 1
        yield from leave(shared)
        stack += [_Node(d, words[d - 1] if d else 0) for d in range(stack[-1].depth + 1 if stack else top, len(words) + 1)]
        stack[-1].add(conv_id, n_convs)
        stack[-1].ends = ends
        before = seq
    yield from leave(top - 1)


def _swept(batches):
    """Rows ``name, seq, words, n_convs, conv_id, ends, depth`` in order -> the nodes of each container, the top ones
    with the container's ``name``."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                        ("ends_sha256", pa.string()), ("name", pa.string())])
    name, rows, nodes = None, [], []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), schema)], schema=schema)
        nodes.clear()
        return out

    def close():
        for node in sweep(rows):
            nodes.append((*node, name if node[1] == rows[0][5] else None))
            if len(nodes) >= 10_000:
                yield flush()

    for batch in batches:
        for n, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and n != name:
                yield from close()
                rows = []
            name = n
            rows.append(tuple(row))
    if rows:
        yield from close()
    if nodes:
        yield flush()


def _heads(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """The burst containers: ``name, start, end, up`` (the one above), ``conv_id, n_convs, n_children, n_leaves, ends``,
    ``words`` (of the turns from ``start`` to ``end``) and ``saved`` (below ``end``).

    ``tops``: a row per container that is left, ``ended``: one per sequence
    that ends at a head; both with the ``heads`` above them.
    """
    names = ["heads", "words", "conv_id", "n_convs", "n_leaves", "saved_tokens", "ends", "name"]
    below = tops.withColumn("ends", F.lit(None).cast("string")).select(*names).unionByName(
        ended.withColumns({c: F.lit(0).cast("long") for c in ("n_leaves", "saved_tokens")})
        .withColumn("name", F.lit(None).cast("string")).select(*names))
    each = below.select("*", F.posexplode("heads").alias("i", "head"))
    last = F.col("i") == F.size("heads") - 1
    words = F.concat(F.array(F.lit(0)), F.col("words"))  # the root has none
    each = each.select(
        F.col("head.name").alias("head"), F.when(last, F.col("name")).otherwise(F.get("heads", F.col("i") + 1)["name"]).alias("child"),
        F.struct("head.start", "head.end", F.slice("heads", 1, F.col("i")).alias("above"),
                 F.slice(words, F.col("head.start") + 1, F.col("head.end") - F.col("head.start") + 1).alias("words")).alias("what"),
        "conv_id", "n_convs", "n_leaves", "saved_tokens", F.when(last, F.col("ends")).alias("ends"))
    sums = [F.first("what").alias("what"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")]]
    # by child first: a head with very many children is one key
    heads = stored(each.groupBy("head", "child").agg(*sums).groupBy("head").agg(*sums, F.count("child").alias("n_children"))
                   .select("head", "what.*", "conv_id", "ends", "n_convs", "n_leaves", "saved_tokens", "n_children"), "trie-heads")
    own = (F.col("n_convs") - 1) * F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    under = (heads.select(F.explode(F.col("above")["name"]).alias("head"), own.alias("own"))
             .groupBy("head").agg(F.sum("own").alias("under")))
    return heads.join(under, "head", "left").select(
        F.col("head").alias("name"), "start", "end", F.get("above", F.size("above") - 1)["name"].alias("up"),
        "conv_id", "n_convs", "n_children", "n_leaves", "ends", "words",
        (F.col("saved_tokens") + F.coalesce("under", F.lit(0))).alias("saved"))


def _head_nodes(heads: DataFrame) -> DataFrame:
    """The nodes of :func:`_heads`, with the name ``up`` above each first one."""
    at = heads.select("*", F.posexplode("words").alias("i", "w"))
    last = F.col("i") == F.col("end") - F.col("start")
    onwards = Window.partitionBy("name").orderBy(F.col("i").desc())  # at most one sequence's turns
    return at.select(
        "conv_id", (F.col("start") + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.sum("w").over(onwards)).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        F.when(F.col("i") == 0, F.col("up")).alias("up"))


def trie(seqs: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """A row per node of the prefix trie of ``seqs`` (``conv_id, turns``: an array of ``id, words``).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    names = [x.split()[0] for x in NODE.split(", ")]
    contained, ended = burst(distinct(seqs), container_turns)
    rows = contained.select("name", "seq", "words", "n_convs", "conv_id", "ends", "depth")
    nodes = stored(rows.repartition("name").sortWithinPartitions("name", "seq")
                   .mapInArrow(_swept, NODE + ", name string"), "trie-nodes")
    paths = contained.groupBy("name").agg(F.first(F.struct("heads", "words")).alias("path")).select("name", "path.*")
    tops = stored(nodes.where("name is not null").join(paths, "name"), "trie-tops")
    heads = stored(_heads(tops, ended), "trie-head-sums")
    above = heads.select(F.col("name").alias("_up"), F.col("conv_id").alias("_parent"))
    up = F.get("heads", F.size("heads") - 1)["name"]
    firsts = tops.select(*names, up.alias("up")).unionByName(_head_nodes(heads))
    linked = firsts.join(above, F.col("up") == F.col("_up"), "left")
    return nodes.where("name is null").select(*names).unionByName(
        linked.withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id")).select(*names))


def prefix_trie(turns: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The trie of conversations (``conv_id, turn, role, text``) that are rebuilt with shared starts."""
    seqs = stored(sequences(turns), "trie-turns")
    return trie(with_shared_starts(seqs), container_turns)
