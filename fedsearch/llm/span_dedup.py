"""Substring dedup by sliding sentence spans (operator 2).

A sentence ends at white space after ``. ! ?``, after the like marks of other
scripts, or at a line break. Every sentence is cut into parts after the words
whose hash says so (one in ``CUT``): the same places wherever the words stand. Words
are what stands between white space; text after a mark of another script is a
new word.
From every sentence on, the shortest run of consecutive sentences with at least
``min_words`` words is hashed, and from every part on the shortest such run of
consecutive parts. Whole repeated sentences go whole by the first; the second
finds passages glued to their host text, inside a longer sentence, around an
edited place, or in text without marks. Runs with equal 128-bit hashes are one
span; all its occurrences but the first (smallest ``doc_id``, then place) are
repeats, and what any repeat covers is removed. Repeats below ``min_words``
words stay, as do the few words between a passage's border and its first or
last cut.

Scale. The hashes are joined globally in three steps that each move less: the
64-bit halves alone are counted, combined before the shuffle; run rows are kept
if their half occurs twice; first places are found among those few. A passage
in a third of all documents is one skewed join key whose rows Spark can split
(no pairs are formed: every occurrence meets one row). The texts are shuffled
once, to meet the stored list of their repeats, so that identical rows, which
share a key, are a skewed join key that Spark can split.

Edge cases. Null text: kept as null, no sentences. Empty text, or one too short
for a run: unchanged. Null ``doc_id``: after all others. Identical rows (same
id and text) are one document: all of them keep or lose the same sentences.
Repeats inside one document count. Empty table: empty result. Other columns
are kept, but ``n_sentences`` and ``n_removed`` replaced; ``n_chars`` is
brought up to date.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedsearch.llm.common import pack, stored, unpack

MIN_WORDS = 20
CUT = 4
CHUNK_ROWS = 512
_MARKS = "。！？．｡؟۔।॥"  # marks that need no white space after them
_MARK = re.compile(f"[{_MARKS}]")
_ENDS = frozenset(".!?" + _MARKS)
_WORD = re.compile(rf"[^\s{_MARKS}]+[{_MARKS}]*|[{_MARKS}]+")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64


def split(text: str) -> tuple[list[str], np.ndarray]:
    """The words of a text, and where its sentences start, in words; both ends with the number of words."""
    marked = _MARK.search(text)
    words, ends = [], []
    for line in text.split("\n"):
        own = _WORD.findall(line) if marked else line.split()
        if own:
            words += own
            ends.append(len(words) - 1)
    end = np.fromiter([w[-1] in _ENDS for w in words], bool, len(words))
    end[ends] = True  # a line's last word ends a sentence
    return words, _starts(end)


def _starts(end: np.ndarray) -> np.ndarray:
    """Where the stretches start whose last words are marked; the last one ends with the text."""
    behind = np.flatnonzero(end) + 1
    behind = behind[:np.searchsorted(behind, len(end))]
    return np.concatenate(([0], behind, [len(end)])) if len(end) else np.zeros(1, np.int64)


def hashed(words: list[str]) -> np.ndarray:
    """A fixed 64-bit hash of each word."""
    column = np.empty(len(words), object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def borders(h: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sentences and the parts of a text start, in words; both end with its number of words."""
    cut = h % np.uint64(CUT) == 0
    cut[sentences[1:] - 1] = True
    return sentences, _starts(cut)


def runs(h: np.ndarray, sentences: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in words, of the shortest long enough run from each sentence and from each part."""
    found = []
    for at in borders(h, sentences):
        to = np.searchsorted(at, at + min_words)
        whole = to < len(at)
        found.append(at[whole] * (len(h) + 1) + at[to[whole]])
    return np.divmod(np.unique(np.concatenate(found)), len(h) + 1)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The powers 0 to n of each base and of its inverse, modulo 2**64."""
    def up(base: int) -> np.ndarray:
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))

    return [(up(b), up(pow(b, -1, 1 << 64))) for b in _BASES]


def _run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers) -> list[np.ndarray]:
    """Two 64-bit hashes of the words of each run: sums of word hash times power, shifted back to the run's start."""
    out = []
    for up, down in powers:
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)], dtype=np.uint64)))
        out.append(((upto[end] - upto[start]) * down[start]).view(np.int64))
    return out


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _run_rows(docs: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """A row per run: its first half hash ``h1``, and if ``whole`` all columns of :func:`spans`."""
    rows = docs.select("doc_id", "text").where("text is not null")
    rows = _key(rows) if whole else rows.select("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts = [split(t) for t in part.column("text").to_pylist()]
                texts = [(hashed(words), first) for words, first in texts]
                powers = _powers(max(len(h) for h, _ in texts))[:2 if whole else 1]
                found = [runs(h, first, min_words) for h, first in texts]
                halves = [_run_hashes(h, *r, powers) for (h, _), r in zip(texts, found)]
                columns = {f"h{i + 1}": pa.array(np.concatenate([x[i] for x in halves])) for i in range(len(powers))}
                if whole:
                    index = pa.array(np.repeat(np.arange(len(texts), dtype=np.int32), [len(r[0]) for r in found]))
                    start, end = (np.concatenate([r[i] for r in found]) for i in (0, 1))
                    columns |= {"doc_id": part.column("doc_id").take(index), "key": part.column("_key").take(index),
                                "start": pa.array(start.astype(np.int32)), "size": pa.array((end - start).astype(np.int32))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, "h1 long" + (f", h2 long, doc_id {id_type}, key long, start int, size int" if whole else ""))


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``h1, h2`` (the 128-bit hash), ``doc_id, key, start, size`` of every run of ``docs``."""
    return _run_rows(docs, min_words, True)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, key, start, size`` of every run that repeats an earlier one."""
    # Tables are written before and after each join: a join whose sides are plain shuffles, with no
    # aggregate above or below it in its stage, is one whose skewed keys Spark can split.
    twice = stored(_run_rows(docs, min_words, False).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "spans-halves")
    rows = stored(spans(docs, min_words).join(twice, "h1", "left_semi"), "spans-twice")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    first = stored(rows.groupBy("h1", "h2").agg(F.min(place).alias("first")), "spans-first")
    met = rows.join(first, ["h1", "h2"])
    return met.where(~(_same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
                       & (F.col("start") == F.col("first.start")))).select("doc_id", "key", "start", "size")


def remove(text: str, cover: list[dict] | None) -> tuple[str, int, int]:
    """The text without the covered words, the number of sentences that lose any, and that of all sentences."""
    words, first = split(text)
    if not cover:
        return text, 0, len(first) - 1
    gone = np.zeros(len(words), bool)
    for c in cover:
        gone[c["start"]:c["start"] + c["size"]] = True
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept = [text[places[i]:places[i + 1]] for i in np.flatnonzero(~gone)]
    lost = np.add.reduceat(gone, first[:-1], dtype=np.int64)
    return text[:places[0]] + "".join(kept), int((lost > 0).sum()), len(first) - 1


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated spans; adds ``n_sentences`` and ``n_removed``."""
    cover = stored(repeats(docs, min_words).groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("_cover")),
                   "spans-cover")
    rows = _key(pack(docs, "doc_id", "text"))
    rows = rows.join(cover, rows["_key"] == cover["key"], "left").select("_row", "doc_id", "text", "_cover")
    names = ["_row", "doc_id", "text"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("n_sentences", T.LongType()),
                           T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts, total, removed = [], [], []
                for text, c in zip(part.column("text").to_pylist(), part.column("_cover").to_pylist()):
                    if text is None:
                        new, gone, n = None, 0, 0
                    else:
                        new, gone, n = remove(text, c)
                    texts.append(new)
                    total.append(n)
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("doc_id"), pa.array(texts, pa.string()),
                     pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                    names=[*names, "n_sentences", "n_removed"])

    out = rows.mapInArrow(run, schema)
    counted = ("n_sentences", "n_removed")
    own = docs.drop(*counted)
    new = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("_row")["n_chars"])
           } if "n_chars" in docs.columns else {}
    return unpack(out, own, _also=counted, **new)
