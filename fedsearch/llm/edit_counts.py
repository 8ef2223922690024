"""Token counts that follow edits (operator 10).

A text is cut at the white space after a character that is none. Such a place
is always a pre-token boundary of the byte-level pattern, so the tokens of the
text are those of its units, one after the other. Runs of ``LEAF_UNITS`` units
are the leaves of a balanced tree whose nodes hold the characters and tokens
below them. An edit (place, characters to delete, text to insert) finds the
leaves it touches by the character sums, takes a leaf more on either side where
it reaches a border (the boundary context), cuts and encodes only that region
again and updates the sums on the way to the root.

The tree of a document is kept as a row: the lengths and token counts of its
leaves, in order. Rebuilding the nodes from them encodes nothing.

Scale. Maps over the texts: counting needs no shuffle, and edits that come as
a column need none either; edits in a table of their own are gathered by
document (:func:`with_edits`). A worker remembers the counts of at most
``MEMO_UNITS`` short units.

Edge cases. Null text: null tree, 0 tokens, edits do nothing. Empty text: no
leaf; an insertion makes the first. A place beyond the text: the end; a
negative one: the start; a deletion beyond the end stops there; null edits or
fields: skipped, or 0 and empty. Edits apply in their order, each to the text
that the one before left. Repeated rows: each has its own tree. Empty table:
empty result. Other columns are kept, but for those of the names that each
function says it adds, which are replaced.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_UNITS = 8
MEMO_UNITS = 300_000
LONG_UNIT = 64
CHUNK_ROWS = 256
_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_RARE_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: White space of the pattern; a run of it is one pre-token but for its last character before other text.
_BLANKS = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_BLANK = 500
_SAFE = re.compile(r"(?<=\w)(?=[ \t\n\r])")
EDITS = "array<struct<at:bigint,remove:bigint,insert:string>>"


def units(text: str) -> list[str]:
    """The text cut at places that are pre-token boundaries in any context."""
    if _RARE_BLANK.search(text):  # rarer white space may join a run: cut after word characters only
        return [u for u in _SAFE.split(text) if u]
    return _UNIT.findall(text)


class Counter:
    """Tokens of texts, unit by unit; remembers short units."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def count(self, unit: str) -> int:
        n = self.memo.get(unit)
        if n is None:
            n = self._tokens(unit)
            if len(unit) <= LONG_UNIT:
                if len(self.memo) >= MEMO_UNITS:
                    self.memo.clear()
                self.memo[unit] = n
        return n

    def _tokens(self, unit: str) -> int:
        """Tokens of a text. The library's matcher goes as deep as a run of white space is long, so a long
        run is cut out here and merged as the one pre-token that it is."""
        n = at = 0
        for m in _BLANKS.finditer(unit) if len(unit) > LONG_BLANK else ():
            end = m.end() if m.end() == len(unit) else m.end() - 1
            if end - m.start() >= LONG_BLANK:
                n += len(self.encoding.encode_ordinary(unit[at:m.start()]))
                n += len(self.encoding._encode_single_piece(unit[m.start():end]))
                at = end
        return n + len(self.encoding.encode_ordinary(unit[at:] if at else unit))

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """``(characters, tokens)`` of each leaf of a text."""
        own = units(text)
        return [(sum(map(len, part)), sum(map(self.count, part)))
                for part in (own[i:i + LEAF_UNITS] for i in range(0, len(own), LEAF_UNITS))]


class Node:
    """Characters and tokens below; a leaf has no children."""

    __slots__ = ("left", "right", "chars", "tokens", "count")

    def __init__(self, left=None, right=None, chars=0, tokens=0):
        self.left, self.right = left, right
        if left is None:
            self.chars, self.tokens, self.count = chars, tokens, 1
        else:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.count = left.count + right.count


def build(leaves: list[tuple[int, int]], lo: int = 0, hi: int | None = None) -> Node | None:
    """A balanced tree over the leaves."""
    hi = len(leaves) if hi is None else hi
    if lo >= hi:
        return None
    if hi - lo == 1:
        return Node(chars=leaves[lo][0], tokens=leaves[lo][1])
    mid = (lo + hi) // 2
    return Node(build(leaves, lo, mid), build(leaves, mid, hi))


def find(node: Node, at: int) -> tuple[int, int]:
    """Index of the leaf that holds character ``at`` (the last leaf beyond the end), and where it starts."""
    index = start = 0
    while node.left is not None:
        if at - start < node.left.chars:
            node = node.left
        else:
            index, start, node = index + node.left.count, start + node.left.chars, node.right
    return index, start


def splice(node: Node | None, lo: int, hi: int, new: list[tuple[int, int]]) -> Node | None:
    """The tree with leaves ``lo`` to ``hi - 1`` replaced; nodes off the path stay as they are."""
    if node is None or (lo <= 0 and hi >= node.count):
        return build(new)
    if node.left is None:  # a leaf beside the range
        return build([*new, (node.chars, node.tokens)] if hi <= 0 else [(node.chars, node.tokens), *new])
    n = node.left.count
    if hi <= n:
        left, right = splice(node.left, lo, hi, new), node.right
    elif lo >= n:
        left, right = node.left, splice(node.right, lo - n, hi - n, new)
    else:
        left, right = splice(node.left, lo, n, new), splice(node.right, 0, hi - n, [])
    if left is None or right is None:
        return left or right
    if max(left.count, right.count) > 8 * min(left.count, right.count) + 8:  # rebuilt from its leaves, nothing encoded
        return build([*walk(left), *walk(right)])
    return Node(left, right)


def walk(node: Node | None) -> list[tuple[int, int]]:
    """Leaves in order."""
    out, open_ = [], [node] if node else []
    while open_:
        n = open_.pop()
        if n.left is None:
            out.append((n.chars, n.tokens))
        else:
            open_ += [n.right, n.left]
    return out


class Tree:
    """A text with the tree of its token counts."""

    def __init__(self, text: str, counter: Counter, leaves: list[tuple[int, int]] | None = None):
        self.text, self.counter, self.encoded = text, counter, 0
        self.root = build(counter.leaves(text) if leaves is None else leaves)

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace ``remove`` characters from ``at`` on by ``insert``; only the region around is encoded again."""
        at = min(max(at, 0), len(self.text))
        end = min(at + max(remove, 0), len(self.text))
        if self.root is None:
            lo = hi = start = stop = 0
        else:
            lo, start = find(self.root, at)
            last, _ = find(self.root, max(end - 1, at))
            hi = last + 1
            stop = self._end(hi)
            # context: where the edit meets the border of its region, the border itself may move
            if lo > 0 and at - start <= 1:
                lo -= 1
                start = self._end(lo)
            if hi < self.root.count and stop - end <= 1:
                hi += 1
                stop = self._end(hi)
        region = self.text[start:at] + insert + self.text[end:stop]
        self.text = self.text[:at] + insert + self.text[end:]
        self.encoded += len(region)
        self.root = splice(self.root, lo, hi, self.counter.leaves(region))

    def _end(self, leaves: int) -> int:
        """Characters in the first ``leaves`` leaves."""
        node, total = self.root, 0
        while node is not None and leaves > 0:
            if leaves >= node.count:
                return total + node.chars
            if leaves >= node.left.count:
                total, leaves, node = total + node.left.chars, leaves - node.left.count, node.right
            else:
                node = node.left
        return total


@lru_cache(maxsize=2)
def _counter(vocabulary: bytes) -> Counter:
    """One per worker process."""
    return Counter(vocabulary)


LEAVES = T.ArrayType(T.IntegerType())
_MADE = [T.StructField("leaf_chars", LEAVES), T.StructField("leaf_tokens", LEAVES), T.StructField("n_tokens", T.LongType())]


def _mapped(df: DataFrame, made: list[T.StructField], vocabulary: str, row) -> DataFrame:
    """``df`` with the columns that ``row(record, counter)`` gives in order; the driver reads the vocabulary once."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    names = [f.name for f in made]
    kept = [f for f in df.schema if f.name not in names]
    schema = T.StructType(kept + made)
    types = {f.name: pa.list_(pa.int32()) if f.dataType == LEAVES else pa.string() if f.dataType == T.StringType()
             else pa.int64() for f in made}
    needed = [c for c in ("text", "leaf_chars", "leaf_tokens", "edits") if c in df.columns]

    def run(batches):
        counter = _counter(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                rows = [row(r, counter) for r in part.select(needed).to_pylist()]
                columns = [pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + columns,
                                                 names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def _kept(tree: Tree) -> tuple[list[int], list[int], int]:
    leaves = walk(tree.root)
    return [c for c, _ in leaves], [t for _, t in leaves], tree.tokens


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``leaf_chars, leaf_tokens`` (the tree) and ``n_tokens``."""
    def row(r, counter):
        return (None, None, 0) if r["text"] is None else _kept(Tree(r["text"], counter))

    return _mapped(docs, _MADE, vocabulary, row)


def _edited(tree: Tree, edits: list[dict] | None) -> int:
    done = 0
    for e in edits or []:
        if e is not None:
            tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
            done += 1
    return done


_EDITED = [T.StructField("text", T.StringType()), *_MADE, T.StructField("n_edits", T.LongType()),
           T.StructField("encoded_chars", T.LongType())]


def apply_edits(kept: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees after the edits of column ``edits``: the new ``text``, tree, ``n_tokens``,
    ``n_edits`` and ``encoded_chars`` (what was encoded again)."""
    def row(r, counter):
        if r["text"] is None:
            return None, None, None, 0, 0, 0
        tree = Tree(r["text"], counter, list(zip(r["leaf_chars"], r["leaf_tokens"])))
        done = _edited(tree, r["edits"])
        return tree.text, *_kept(tree), done, tree.encoded

    return _mapped(kept, _EDITED, vocabulary, row)


def with_edits(kept: DataFrame, edits: DataFrame) -> DataFrame:
    """``kept`` with the rows of ``edits`` (``doc_id, seq, at, remove, insert``) as column ``edits``, by ``seq``."""
    own = (edits.where("doc_id is not null").groupBy("doc_id")
           .agg(F.sort_array(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("_e"))
           .select("doc_id", F.transform("_e", lambda e: e.dropFields("seq")).cast(EDITS).alias("edits")))
    return kept.drop("edits").join(own, "doc_id", "left")


def count_with_edits(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts of ``docs`` before and after their ``edits``, in one pass: ``n_tokens, edited_tokens,
    n_edits, n_leaves, encoded_chars``."""
    def row(r, counter):
        if r["text"] is None:
            return 0, 0, 0, 0, 0
        tree = Tree(r["text"], counter)
        before, n = tree.tokens, tree.root.count if tree.root else 0
        done = _edited(tree, r["edits"])
        return before, tree.tokens, done, n, tree.encoded

    names = ("n_tokens", "edited_tokens", "n_edits", "n_leaves", "encoded_chars")
    return _mapped(docs, [T.StructField(n, T.LongType()) for n in names], vocabulary, row)
