"""Routed top-k retrieval (survey F4-F8, H1).

Shapes:
  queries  (qid, source_id, qv ARRAY<DOUBLE>)      one row per routed pair
  corpus   (source_id, vec_id, v ARRAY<DOUBLE>)    the federated vectors
  hits     (qid, source_id, vec_id, score DOUBLE, local_rank BIGINT)

A query only ever meets the sources it was routed to: every plan is an
equi-join on ``source_id``. Two tiers compute the same result:
  * ``knn``        - scores and ranks are built-in expressions. They see the pairs
                     that can be among the k best: a matrix product per tile and
                     block leaves out the others, so neither rows nor sorts grow
                     with queries times vectors. Pairs without such a bound (null
                     values, other widths, infinite values) take their own joins;
  * ``knn_arrow``  - for large corpora: vectors are packed into tiles where they
                     are read and queries into blocks, so the join carries a row
                     per (tile, block) instead of one per pair; a joined row is
                     one matrix product whose k best per query leave the task.
                     Nothing larger than a tile and a block is in memory, a hot
                     source is many tiles that Spark can split over tasks, and
                     no pair is ever sorted.
No join is hinted: sizes decide at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedsearch.functions.vectors import l2_norm
from fedsearch.functions.vectors import score as score_expr

TILE_ROWS = 2048
BLOCK_QUERIES = 256
#: Tasks that share a source's tiles, at least where the join shuffles; each gets all its query blocks.
TILE_SHARES = 4


def _order(score: Column, higher_is_better: bool, tie: str = "vec_id") -> list[Column]:
    return [score.desc() if higher_is_better else score.asc(), F.col(tie).asc()]


def topk(df: DataFrame, by: list[str], score_col: str, k: int, rank_col: str = "rank",
         higher_is_better: bool = True, tie: str = "vec_id") -> DataFrame:
    """Rank inside each ``by`` group and keep the first ``k`` (survey H1).

    Ties always end in the lower ``tie`` value, so the result is deterministic.
    """
    w = Window.partitionBy(*by).orderBy(*_order(F.col(score_col), higher_is_better, tie))
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def knn(queries: DataFrame, corpus: DataFrame, k: int, score_fn: str = "dot",
        higher_is_better: bool = True, tile_rows: int = TILE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """k best corpus vectors per routed (qid, source_id) pair (survey F5, tier 1)."""
    q = _with_kind(queries.select("source_id", "qid", "qv").where("source_id IS NOT NULL"), "qv")
    c = _with_kind(corpus.select("source_id", "vec_id", "v").where("source_id IS NOT NULL"), "v")
    pairs = (_near_pairs(q.where(F.col("kind") >= 0), c.where(F.col("kind") >= 0), k, score_fn, higher_is_better,
                         tile_rows, block_queries)
             .unionByName(_unbounded_pairs(q, c, k)))
    scored = pairs.select("qid", "source_id", "vec_id", score_expr("qv", "v", score_fn).alias("score"))
    return topk(scored, ["qid", "source_id"], "score", k, "local_rank", higher_is_better)


def merge_topk(hits: DataFrame, k: int, higher_is_better: bool = True,
               by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Merge all sources' hits of a query and keep k (survey H2 desc / H3 asc)."""
    return topk(hits, list(by), "score", k, "rank", higher_is_better)


def knn_global(queries: DataFrame, corpus: DataFrame, sources: DataFrame, k: int,
               score_fn: str = "dot", higher_is_better: bool = True) -> DataFrame:
    """Nearest k over every source: route to all, k per source, merge to k.

    Exact: any global top-k vector is inside the top-k of its own source.
    ``sources`` is the (source_id) dimension: fixed-size, read as one array.
    """
    from fedsearch.operators.routing import route_all
    per_source = knn_arrow(route_all(queries, sources), corpus, k, score_fn, higher_is_better)
    return merge_topk(per_source, k, higher_is_better)


# ---- tier 1: the pairs that built-in expressions score ------------------------

NULLS, WILD = -1, -2
#: A source's tiles are dealt out to this many shares, each of which meets all its query blocks.
SHARES = 8
#: Bytes of best scores that a task remembers, for its latest blocks.
KEPT_BYTES = 16 << 20
OUT_ROWS = 4_096


def _with_kind(df: DataFrame, vec: str) -> DataFrame:
    """``kind`` of each vector: its width; NULLS if it or a value is null; WILD if a value is infinite, NaN or huge."""
    whole = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull())
    return df.withColumn("kind", F.when(~whole, NULLS).when(F.exists(vec, lambda x: ~(F.abs(x) < 1e100)), WILD)
                         .otherwise(F.size(vec)))


def _pack_kinds(df: DataFrame, key: str, vec: str, rows: int) -> DataFrame:
    """``source_id, kind, pack, keys, data``: up to ``rows`` vectors of a source and width in one row, by ascending key."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        place = TaskContext.get().partitionId() << 32
        for b in batches:
            source, kinds, keys, vectors = (b.column(i) for i in range(4))
            code = source.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            groups = np.stack([code, kinds.to_numpy(zero_copy_only=False)], axis=1)
            for group in np.unique(groups, axis=0):
                own = np.flatnonzero((groups == group).all(axis=1))
                own = own[pc.array_sort_indices(keys.take(pa.array(own)), null_placement="at_start").to_numpy()]
                for at in range(0, len(own), rows):
                    part = pa.array(own[at:at + rows])
                    flat = vectors.take(part).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    # one packed row a batch: that bounds what the next step holds
                    yield pa.RecordBatch.from_arrays(
                        [source.take(part[:1]), pa.array([group[1]], pa.int32()), pa.array([place], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), keys.take(part)),
                         pa.array([flat.tobytes()], pa.binary())], names=["source_id", "kind", "pack", "keys", "data"])
                    place += 1

    return df.select("source_id", "kind", key, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(
        run, f"source_id {types['source_id']}, kind int, pack long, keys array<{types[key]}>, data binary")


def _near_pairs(queries: DataFrame, corpus: DataFrame, k: int, score_fn: str, higher_is_better: bool,
                tile_rows: int, block_queries: int) -> DataFrame:
    """``qid, qv, source_id, vec_id, v`` of equal widths: per query the k best of each tile, less those that k vectors
    of the task's earlier tiles beat."""
    share = F.pmod(F.xxhash64("pack"), F.lit(SHARES))
    tiles = _pack_kinds(corpus, "vec_id", "v", tile_rows).withColumn("share", share)
    blocks = _pack_kinds(queries, "qid", "qv", block_queries).select(
        "source_id", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"),
        F.col("pack").alias("block"), F.col("keys").alias("qids"), F.col("data").alias("qdata"))

    def lists(m: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    def run(batches):
        best: dict[tuple, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                source, width = b.column("source_id")[i], b.column("kind")[i].as_py()
                ids, qids = b.column("keys")[i].values, b.column("qids")[i].values
                Q = np.frombuffer(b.column("qdata")[i].as_py(), "<f8").reshape(len(qids), width)
                C = np.frombuffer(b.column("data")[i].as_py(), "<f8").reshape(len(ids), width)
                # places stand for ids: a tile's rows ascend by id
                row, col, score = tile_topk(np.arange(len(Q)), Q, np.arange(len(C)), C, k, higher_is_better, score_fn)
                signed = (score if higher_is_better else -score).reshape(len(Q), -1)
                at = (source.as_py(), b.column("block")[i].as_py())
                before = best.pop(at, None)
                if before is None:
                    every, keep = signed, np.arange(len(row))
                else:
                    every = np.concatenate([before, signed], axis=1)
                    beaten = signed < before.min(axis=1, keepdims=True) if before.shape[1] == k else np.zeros(signed.shape, bool)
                    keep = np.flatnonzero(~beaten.ravel())
                best[at] = every if every.shape[1] <= k else np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
                while len(best) > 1 and len(best) * best[at].nbytes > KEPT_BYTES:
                    best.pop(next(iter(best)))
                for lo in range(0, len(keep), OUT_ROWS):
                    r, c = row[keep[lo:lo + OUT_ROWS]], col[keep[lo:lo + OUT_ROWS]]
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(r)), lists(Q[r]), pa.repeat(source, len(r)), ids.take(pa.array(c)), lists(C[c])],
                        names=["qid", "qv", "source_id", "vec_id", "v"])

    kinds = dict(queries.dtypes) | dict(corpus.dtypes)
    return tiles.join(blocks, ["source_id", "kind", "share"]).mapInArrow(
        run, f"qid {kinds['qid']}, qv array<double>, source_id {kinds['source_id']}, vec_id {kinds['vec_id']}, v array<double>")


def _unbounded_pairs(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The pairs beside :func:`_near_pairs`: with a WILD vector all; with nulls or unlike widths, where a query scores
    alike with all vectors of a source and kind, those with the k lowest ids."""
    tame_q, tame_c = queries.where(F.col("kind") != WILD), corpus.where(F.col("kind") != WILD)
    alike = Window.partitionBy("source_id", "kind", F.coalesce(l2_norm("v") == 0, F.lit(False))).orderBy("vec_id")
    first = tame_c.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= k).drop("_place")
    unlike = first.withColumnRenamed("kind", "_kind").join(tame_q, "source_id").where(
        (F.col("kind") != F.col("_kind")) | (F.col("kind") == NULLS))
    wild = corpus.where(F.col("kind") == WILD).drop("kind").join(queries, "source_id")
    asked = tame_c.drop("kind").join(queries.where(F.col("kind") == WILD), "source_id")
    cols = ["qid", "qv", "source_id", "vec_id", "v"]
    return unlike.select(cols).unionByName(wild.select(cols)).unionByName(asked.select(cols))


# ---- tier 2: tiles against query blocks --------------------------------------

def pack_vectors(df: DataFrame, key: str, vec: str, rows: int) -> DataFrame:
    """``source_id, keys, data, width``: up to ``rows`` vectors of a source in one row, packed by
    the task that reads them (``data``: doubles, one vector after the other)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = np.asarray(b.column(0))
            keys = np.asarray(b.column(1))
            vectors = b.column(2)
            out = []
            for s in np.unique(source):
                own = np.flatnonzero(source == s)
                for at in range(0, len(own), rows):
                    part = own[at:at + rows]
                    flat = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    out.append((int(s), keys[part].astype("<i8").tobytes(), flat.tobytes(), len(flat) // len(part)))
            for row in out:  # one packed row a batch: that bounds what the next step holds
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary()),
                     pa.array([row[3]], pa.int32())], names=["source_id", "keys", "data", "width"])

    return df.select(F.col("source_id").cast("int"), F.col(key).cast("bigint"), vec).mapInArrow(
        run, "source_id int, keys binary, data binary, width int")


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, max(width, 1))


def _scores(Q: np.ndarray, C: np.ndarray, score_fn: str) -> np.ndarray:
    """Score of row i of Q with row i of C, products added position by position as the
    built-in expression adds them, so both tiers agree to the last bit."""
    def dots(a, b):
        total = np.zeros(len(a))
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
        return total

    top = dots(Q, C)
    if score_fn == "dot":
        return top
    den = np.sqrt(dots(Q, Q)) * np.sqrt(dots(C, C))
    return np.where(den > 0, top / np.where(den > 0, den, 1.0), 0.0)


def tile_topk(qids, Q, ids, C, k: int, higher_is_better: bool, score_fn: str):
    """``(qid, id, score)`` of the k best rows of C for each row of Q, ties to the lower id.

    A matrix product selects the candidates, with a margin for its rounding;
    only those are scored exactly.
    """
    approx = Q @ C.T
    sizes = np.sqrt((Q * Q).sum(1)), np.sqrt((C * C).sum(1))
    slack = sizes[0] * sizes[1].max(initial=0.0)
    bounded = np.isfinite(slack).all()
    if score_fn != "dot" or not bounded:
        size = sizes[0][:, None] * sizes[1][None, :]
    if score_fn != "dot":
        approx = np.where(size > 0, approx / np.where(size > 0, size, 1.0), 0.0)
        size, slack = np.ones_like(size), np.ones_like(slack)
    keyed = approx if higher_is_better else -approx
    kk = min(k, len(ids))
    unit = 1e-12 * max(Q.shape[1], 1)
    if bounded:  # a pass each for the product, its k-th value of a row, and the test
        at = len(ids) - max(kk, 1)
        least = np.partition(keyed, at, axis=1)[:, at] - 2 * unit * slack  # k rows score at least nearly this
        row, col = np.nonzero(keyed >= least[:, None])
    else:
        margin = unit * size
        least = -np.partition(-(keyed - margin), kk - 1, axis=1)[:, kk - 1]
        row, col = np.nonzero(keyed + margin >= least[:, None])
    exact = _scores(Q[row], C[col], score_fn)
    order = np.lexsort((ids[col], -exact if higher_is_better else exact, row))
    row, col, exact = row[order], col[order], exact[order]
    starts = np.searchsorted(row, np.arange(len(qids)))
    keep = np.arange(len(row)) - starts[row] < kk
    return qids[row[keep]], ids[col[keep]], exact[keep]


HITS_SCHEMA = "qid bigint, source_id int, vec_id bigint, score double"


def knn_arrow(queries: DataFrame, corpus: DataFrame, k: int, score_fn: str = "dot",
              higher_is_better: bool = True, tile_rows: int = TILE_ROWS,
              block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Same result as ``knn``: tiles of ``tile_rows`` vectors against blocks of ``block_queries`` queries."""
    wanted = queries.select("source_id").distinct()  # prunes the scan to the sources some query chose
    tiles = pack_vectors(corpus.join(wanted, "source_id", "left_semi"), "vec_id", "v", tile_rows)
    return knn_tiles(queries, tiles, k, score_fn, higher_is_better, block_queries)


def knn_tiles(queries: DataFrame, tiles: DataFrame, k: int, score_fn: str = "dot", higher_is_better: bool = True,
              block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``knn`` over vectors that are packed already (:func:`pack_vectors`, or a stored table of tiles)."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TILE_SHARES - 1).cast("long")))
    blocks = pack_vectors(queries, "qid", "qv", block_queries).select(
        "source_id", every.alias("share"), F.col("keys").alias("qids"), F.col("data").alias("qdata"), F.col("width").alias("qwidth"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                source, ids, data, width, qids, qdata, qwidth = (b.column(j)[i].as_py() for j in range(7))
                q, v, s = tile_topk(np.frombuffer(qids, dtype="<i8"), _matrix(qdata, qwidth),
                                    np.frombuffer(ids, dtype="<i8"), _matrix(data, width), k, higher_is_better, score_fn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(np.full(len(q), source, dtype=np.int32)), pa.array(v), pa.array(s)],
                    names=["qid", "source_id", "vec_id", "score"])

    share = F.pmod(F.xxhash64("keys"), F.lit(TILE_SHARES)).alias("share")
    met = tiles.select("source_id", share, "keys", "data", "width").join(blocks, ["source_id", "share"])
    partial = met.drop("share").mapInArrow(run, HITS_SCHEMA)
    return topk(partial, ["qid", "source_id"], "score", k, "local_rank", higher_is_better)


def positions_to_docs(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """Index positions turned into document keys (F7): ``hits`` (``source_id, pos``) with the key of
    that position in its source's id list; a position beyond the list keeps a null key."""
    return hits.join(keys.select("source_id", "pos", "doc_id"), ["source_id", "pos"], "left")


def fetch_docs(hits: DataFrame, docs: DataFrame, hit_key: str = "vec_id",
               doc_key: str = "doc_id") -> DataFrame:
    """Late materialisation: attach document rows to the winners only (F8).

    Left outer: a hit whose document is missing keeps its row with nulls.
    Runs after top-k, so only k rows per query carry text through the join.
    """
    return hits.join(docs.withColumnRenamed(doc_key, hit_key), hit_key, "left")
