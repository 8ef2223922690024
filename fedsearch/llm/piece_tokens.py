"""SentencePiece encoding and decoding on the tokenizers library (operator 7).

The model's protobuf is read field by field; from it come the normaliser
(dummy prefix, metaspace marker, an optional character map, white space
rules), the piece scores (merge order of a BPE model, unigram scores of a
unigram model), the byte fallback and the decoder. Texts are encoded in
batches by the library's threads.

No piece holds a marker after another character (checked when the model is
read; else texts stay whole), so no merge reaches over such a place and a text
may be encoded unit by unit: runs of markers with what follows them. A worker
encodes each distinct unit once, and compares it there with the sentencepiece
library: parity is verified for every unit of every text, not a sample, and a
difference raises an error; of two segmentations that a unigram model scores
alike, sentencepiece's is taken. Decoding gathers the bytes of the pieces; byte
pieces that are no UTF-8 go through the library's decoder.

Scale. A map over the texts, no shuffle; the model (about 0.5 MB) travels with
the task. The memory of encoded units is bounded (twice ``MEMO_UNITS``: those
met lately and those before) and holds no long ones.

Edge cases. Null text: null ids, null decoded text, 0 tokens. Empty text: no
ids. Empty table: empty result. A marker character in a text decodes to a
space, as in sentencepiece. Repeated rows: encoded alike. Other columns are
kept.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO_UNITS = 150_000
LONG_UNIT = 64
CHUNK_ROWS = 256
MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (buf[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if buf[at - 1] < 128:
            return value, at


def fields(buf: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """``(number, value)`` of each field of a protobuf message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(buf, at)
        elif wire == 2:
            size, at = _varint(buf, at)
            value, at = buf[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = struct.unpack("<d" if wire == 1 else "<f", buf[at:at + size])[0], at + size
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield number, value


class PieceTokenizer:
    """A SentencePiece model, encoded and decoded by the tokenizers library."""

    def __init__(self, model: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        pieces, trainer, norm = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                d = dict(fields(value))
                pieces.append((d[1].decode(), d.get(2, 0.0), d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.pieces = pieces
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        fallback = any(kind == BYTE for _, _, kind in pieces)
        self.prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        charsmap = norm.get(2, b"")
        self.unigram = trainer.get(3, UNIGRAM) != BPE
        if not self.unigram:
            core = models.BPE(ids, self._merges(ids), unk_token=pieces[unknown][0], fuse_unk=True,
                              byte_fallback=fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in pieces], unknown, fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(charsmap)] if charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        # texts whose normalisation is only marker and prefix are cut into units by us
        self.plain = not charsmap and not self.squeeze
        self.by_unit = self.plain and not any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        if not self.plain:
            self.tokenizer.normalizer = normalizers.Sequence(steps)
        self.tokenizer.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
            + ([decoders.Strip(" ", 1, 0)] if self.prefix else []))
        if self.by_unit:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(MARK + "+"), "merged_with_next")
        self.groups = 4 * threads
        self.other = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memo: dict[str, bytes] = {}  # ids of the units met, as bytes
        self.earlier: dict[str, bytes] = {}  # the same before `memo` was last full
        raw = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def _merges(self, ids: dict[str, int]) -> list[tuple[str, str]]:
        """Pairs in the order in which they merge: best score first. Pieces of markers only share one score and
        merge from the left, so of those the pair with the longer left part goes first."""
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                blank = not piece.strip(MARK)
                for cut in range(1, len(piece)):
                    a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                    if a is not None and b is not None:
                        found.append((-score, -cut if blank else 0, a, b, piece[:cut], piece[cut:]))
        return [x[4:] for x in sorted(found)]

    def _tie(self, a: list[int], b: list[int]) -> bool:
        """Whether two segmentations of a unigram model spell the same and score the same, so that either is the best."""
        if not self.unigram or "".join(self.pieces[i][0] for i in a) != "".join(self.pieces[i][0] for i in b):
            return False
        x, y = (sum(self.pieces[i][1] for i in ids) for ids in (a, b))
        return abs(x - y) <= 1e-5 * (1 + abs(x))  # scores are single floats

    def _checked(self, texts: list[str], ours: list[list[int]], prefixed: bool) -> list[list[int]]:
        """``ours`` if it is what sentencepiece makes of the texts; of two equally good segmentations, sentencepiece's."""
        cut = 1 if prefixed else 0  # sentencepiece puts the first marker itself
        out = list(ours)
        for i, (text, a, b) in enumerate(zip(texts, ours, self.other.encode([t[cut:] for t in texts], num_threads=1))):
            if a != b and len(text) > cut:  # of no text at all sentencepiece makes nothing
                if not self._tie(a, b):
                    raise ValueError(f"no parity with sentencepiece on {text[:80]!r}: {a[:20]} against {b[:20]}")
                out[i] = b
        return out

    def _texts(self, texts: list[str], prefixed: bool) -> list[list[int]]:
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._checked(texts, ours, prefixed)

    def _units(self, new: list[str]) -> dict[str, bytes]:
        """Ids of each unit, as bytes. Units are encoded in a few long texts, which the library cuts at the
        markers again; the bytes of the pieces say where each unit ends."""
        blank = [u for u in new if not u.strip(MARK)]  # would run into the next unit
        found = {u: np.array(x, dtype=np.int32).tobytes() for u, x in zip(blank, self._texts(blank, True))}
        rest = [u for u in new if u not in found]
        groups = [rest[i::self.groups] for i in range(self.groups)]
        for units, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.int32)
            upto = np.concatenate(([0], np.cumsum(self.raw_size[ids])))
            ends = np.cumsum([len(u.encode()) - 2 * u.count(MARK) for u in units], dtype=np.int64)  # a marker is one byte of text
            at = np.searchsorted(upto, ends)
            if not np.array_equal(upto[at], ends):
                raise ValueError("a piece reaches over a unit's end")
            theirs = self.other.encode([u[1:] for u in units], num_threads=1)
            if not (np.array_equal(at, np.cumsum([len(x) for x in theirs], dtype=np.int64))
                    and list(chain.from_iterable(theirs)) == e.ids):
                starts = [0, *at.tolist()]
                same = self._checked(units, [e.ids[a:b] for a, b in zip(starts, starts[1:])], True)
                found.update((u, np.array(x, dtype=np.int32).tobytes()) for u, x in zip(units, same))
                continue
            data, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
            found.update((u, data[a:b]) for u, a, b in zip(units, cuts, cuts[1:]))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.plain:
            return [np.array(x, dtype=np.int32) for x in self._texts(texts, False)]
        marked = [((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else "" for t in texts]
        if not (self.by_unit and self.prefix):
            return [np.array(x, dtype=np.int32) for x in self._texts(marked, self.prefix)]
        if len(self.memo) > MEMO_UNITS:
            self.memo, self.earlier = {}, self.memo
        memo, earlier = self.memo, self.earlier
        units = [self.units.findall(t) for t in marked]
        unmet = set().union(*units).difference(memo)
        memo.update((u, earlier[u]) for u in unmet if u in earlier)
        new = list(unmet.difference(memo))
        memo.update(self._units(new))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, us)), dtype=np.int32) for us in units]
        for u in new:
            if len(u) > LONG_UNIT:
                del memo[u]
        return out

    def forget(self) -> None:
        self.memo, self.earlier = {}, {}

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Text of each list of ids: the bytes of its pieces, gathered for all lists at once.
        A list whose bytes are no UTF-8 goes to the library's decoder."""
        flat = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
        sizes = self.raw_size[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.raw[np.arange(total) + np.repeat(self.raw_start[flat] - (ends - sizes), sizes)].tobytes()
        upto = np.concatenate(([0], ends))[np.cumsum([0] + [len(x) for x in ids])].tolist()
        out = []
        for x, a, b in zip(ids, upto, upto[1:]):
            a += self.prefix and data[a:a + 1] == b" "
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def _tokenizer(model: bytes) -> PieceTokenizer:
    """One per worker process."""
    return PieceTokenizer(model)


def _chunks(texts: list, rows: int = CHUNK_ROWS) -> Iterator[list]:
    for at in range(0, len(texts), rows):
        yield texts[at:at + rows]


def encode_column(texts: pa.Array, tokenizer: PieceTokenizer) -> pa.Array:
    """A list of ids for each text, null for null."""
    parts, sizes = [], []
    for chunk in _chunks(texts.to_pylist()):
        ids = iter(tokenizer.encode([t for t in chunk if t is not None]))
        for t in chunk:
            if t is None:
                sizes.append(None)
            else:
                parts.append(x := next(ids))
                sizes.append(len(x))
    flat = np.concatenate(parts) if parts else np.array([], dtype=np.int32)
    ends = np.cumsum([0] + [n or 0 for n in sizes], dtype=np.int64)
    starts = pa.array([None if i < len(sizes) and sizes[i] is None else int(e) for i, e in enumerate(ends)], pa.int32())
    return pa.ListArray.from_arrays(starts, pa.array(flat, pa.int32()))


def decode_column(ids: pa.Array, tokenizer: PieceTokenizer) -> pa.Array:
    out = []
    for at in range(0, len(ids), CHUNK_ROWS):
        chunk = ids.slice(at, CHUNK_ROWS)
        texts = iter(tokenizer.decode([x.values.to_numpy(zero_copy_only=False) for x in chunk if x.is_valid]))
        out += [next(texts) if x.is_valid else None for x in chunk]
    return pa.array(out, pa.string())


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, model: str, made: list[tuple[str, T.DataType]], run) -> DataFrame:
    """``df`` with the columns that ``run(batch, tokenizer)`` makes; the driver reads the model once."""
    proto = _read(model)
    names = [n for n, _ in made]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in made])

    def each(batches):
        tokenizer = _tokenizer(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):  # a chunk's ids and texts are all that is held
                part = batch.slice(at, CHUNK_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + run(part, tokenizer), names=kept + names)
        tokenizer.forget()  # a worker that waits for its next task holds no units

    return df.mapInArrow(each, schema)


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ``ids``, the piece ids of column ``text``."""
    return _mapped(df, model, [("ids", IDS)], lambda batch, t: [encode_column(batch.column(text), t)])


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with ``decoded``, the text of column ``ids``."""
    return _mapped(df, model, [("decoded", T.StringType())], lambda batch, t: [decode_column(batch.column(ids), t)])


def round_trip(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, in one pass over the texts."""
    def run(batch, tokenizer):
        ids = encode_column(batch.column(text), tokenizer)
        return [ids, decode_column(ids, tokenizer)]

    return _mapped(df, model, [("ids", IDS), ("decoded", T.StringType())], run)
