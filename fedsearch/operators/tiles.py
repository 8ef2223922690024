"""A stored table of vector tiles: written once, extended, searched exactly with pruning (survey F6, L2).

A tile is up to ``tile_rows`` vectors of one source that lie near each other:
every vector goes to the nearest of some pivots (a bounded sample), vectors
are dealt out by ranges of (source, pivot), so a hot source or pivot is many
tasks, and packed where they arrive. With a tile stands its ball: the centre
of its vectors and the largest distance from it. No vector of a tile scores
above ``q.centre + |q| radius``.

:func:`knn_pruned` is the exact top k over all tiles. All balls are compared
with all queries in packs (a row per tile, not per vector); a query first
visits the tiles with the highest bounds that together have k vectors; its
k-th score there then excludes
every other tile whose bound is below it. What is left is searched in cells: a
group of tiles with a group of queries, each sent once per cell. A cell
compares bounds again, and its floors rise with what it finds. Ties end in the
lower id as everywhere.

Scale. Ball packs are cut into shards of about ``PACK_BALLS`` balls and meet the
query blocks in an equi-join on the shard; the first tiles meet the blocks of
queries that want them in an equi-join on the tile. No row stands for a query
and a further tile: where little is pruned, these would be queries times tiles.
Cells hold up to about ``CELL_BYTES`` a side; queries are sent to ``TILE_GROUPS``
groups of tiles, to more only where the tiles are larger than that.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedsearch.operators.retrieve import _matrix, _scores, merge_topk, tile_topk
from fedsearch.session import store

TILE_ROWS = 1_024
PIVOTS = 256
PACK_BALLS = 4_096
BLOCK_QUERIES = 256
#: Groups of tiles at least, and vectors of a cell at most (bytes a side, about).
TILE_GROUPS = 32
CELL_BYTES = 32 << 20
SLAB_QUERIES = 512
EXACT_PAIRS = 65_536
TILES_SCHEMA = "source_id int, tile long, n int, keys binary, data binary, width int, centre binary, radius double"


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors with the smallest id hashes: a bounded sample that only shapes the tiles."""
    rows = vectors.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(n).collect()
    return np.array([r.v for r in rows], dtype=float)


def _pack(tile_rows: int, offset: int):
    """Rows ``source_id, pivot, vec_id, v`` in order -> tiles with their balls."""
    def run(batches):
        key, ids, rows, place = None, [], [], 0
        task = offset

        def close():
            nonlocal place
            x = np.array(rows, dtype="<f8")
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
            place += 1
            return pa.record_batch({
                "source_id": pa.array([key[0]], pa.int32()), "tile": pa.array([task + place], pa.int64()),
                "n": pa.array([len(ids)], pa.int32()), "keys": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                "data": pa.array([x.tobytes()], pa.binary()), "width": pa.array([x.shape[1]], pa.int32()),
                "centre": pa.array([centre.astype("<f8").tobytes()], pa.binary()), "radius": pa.array([radius])})

        for b in batches:
            task = offset + (b.column("task")[0].as_py() << 28) if b.num_rows else task
            for source, pivot, vec_id, v in zip(b.column("source_id").to_pylist(), b.column("pivot").to_pylist(),
                                                b.column("vec_id").to_pylist(), b.column("v")):
                if ids and (key != (source, pivot) or len(ids) == tile_rows):
                    yield close()
                    ids, rows = [], []
                key = (source, pivot)
                ids.append(vec_id)
                rows.append(v.values.to_numpy(zero_copy_only=False))
        if ids:
            yield close()
    return run


def add_vectors(vectors: DataFrame, path: str, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> None:
    """Write ``vectors`` (``source_id, vec_id, v``) as tiles under ``path``, beside those that are there."""
    spark = vectors.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = len([s for s in system.listStatus(at) if s.getPath().getName().startswith("part=")]) if system.exists(at) else 0
    chosen = _pivots(vectors, pivots)
    if not len(chosen):
        return
    sent = spark.sparkContext.broadcast(chosen)  # `pivots` vectors

    def nearest(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, sent.value.shape[1]))
            p = sent.value
            near = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
            yield pa.record_batch([b.column("source_id"), pa.array(near.astype(np.int32)), b.column("vec_id"), b.column("v")],
                                  names=["source_id", "pivot", "vec_id", "v"])

    rows = vectors.select(F.col("source_id").cast("int"), F.col("vec_id").cast("bigint"), F.col("v").cast("array<double>"))
    order = ["source_id", "pivot", "vec_id"]
    placed = store(rows.mapInArrow(nearest, "source_id int, pivot int, vec_id bigint, v array<double>"), "tile-rows")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id().cast("bigint"))
    dealt.mapInArrow(_pack(tile_rows, done << 54), TILES_SCHEMA).write.parquet(os.path.join(path, f"part={done}"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """All tiles under ``path`` at this moment."""
    return spark.read.schema(TILES_SCHEMA + ", part int").parquet(path).drop("part")


def _blocks(queries: DataFrame, key: str, rows: int = BLOCK_QUERIES) -> DataFrame:
    """``queries`` (``key, qid, floor, qv``) sorted by ``key``, packed: up to ``rows`` queries of a key in one row."""
    def run(batches):
        now, ids, floors, vecs = None, [], [], []

        def close():
            return pa.record_batch({key: pa.array([now], pa.int64()), "qids": [np.array(ids, "<i8").tobytes()],
                                    "floors": [np.array(floors, "<f8").tobytes()], "qdata": [np.array(vecs, "<f8").tobytes()],
                                    "qwidth": pa.array([len(vecs[0])], pa.int32())})

        for b in batches:
            for k, qid, floor, v in zip(*(b.column(i).to_pylist() for i in range(4))):
                if ids and (k != now or len(ids) == rows):
                    yield close()
                    ids, floors, vecs = [], [], []
                now = k
                ids.append(qid)
                floors.append(-np.inf if floor is None else floor)
                vecs.append(v)
        if ids:
            yield close()

    return queries.select(F.col(key).cast("bigint"), F.col("qid").cast("bigint"), "floor", "qv").mapInArrow(
        run, f"{key} long, qids binary, floors binary, qdata binary, qwidth int")


def _bounds(queries: DataFrame, packs: DataFrame, shards: int, k: int | None) -> DataFrame:
    """``qid, tile, n, bound``: per query and pack, the tiles with the highest bounds that together have ``k`` vectors,
    or (None) all that reach the query's floor."""
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    blocks = _blocks(queries.select(F.explode(every).alias("shard"), "qid", "floor", "qv").sortWithinPartitions("shard"), "shard")

    def run(batches):
        for b in batches:
            for tiles, sizes, centres, radii, qids, floors, qdata, qwidth in zip(*(b.column(i).to_pylist() for i in range(8))):
                q, c, r, n = _matrix(qdata, qwidth), _matrix(centres, qwidth), np.frombuffer(radii), np.frombuffer(sizes, "<i8")
                size = np.sqrt((q * q).sum(axis=1))
                near = q @ c.T
                # a margin for the rounding of products and of the radius
                top = near + size[:, None] * r[None, :] + 1e-9 * (np.abs(near) + size[:, None] * (1 + r[None, :]))
                if k is None:
                    row, col = np.nonzero(top >= np.frombuffer(floors)[:, None])
                else:
                    order = np.argsort(-top, axis=1, kind="stable")[:, :k]  # a tile has one vector at least
                    held = n[order]
                    row, place = np.nonzero(np.cumsum(held, axis=1) - held < k)
                    col = order[row, place]
                yield pa.record_batch({"qid": np.frombuffer(qids, "<i8")[row], "tile": np.frombuffer(tiles, "<i8")[col],
                                       "n": n[col], "bound": top[row, col]})

    met = packs.join(blocks, "shard").select("tiles", "sizes", "centres", "radii", "qids", "floors", "qdata", "qwidth")
    return met.mapInArrow(run, "qid long, tile long, n long, bound double")


def _ball_packs(tiles: DataFrame, shards: int) -> DataFrame:
    """The balls of a shard as one row: about ``PACK_BALLS`` of them."""
    one = tiles.select(F.pmod(F.xxhash64("tile"), F.lit(shards)).cast("bigint").alias("shard"), "tile", "n", "centre", "radius")

    def run(batches):
        now, tiles, sizes, centres, radii = None, [], [], [], []

        def close():
            return pa.record_batch({"shard": pa.array([now], pa.int64()), "tiles": [np.array(tiles, "<i8").tobytes()],
                                    "sizes": [np.array(sizes, "<i8").tobytes()],
                                    "centres": [b"".join(centres)], "radii": [np.array(radii, "<f8").tobytes()]})

        for b in batches:
            for s, t, n, c, r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if tiles and s != now:
                    yield close()
                    tiles, sizes, centres, radii = [], [], [], []
                now = s
                tiles.append(t)
                sizes.append(n)
                centres.append(c)
                radii.append(r)
        if tiles:
            yield close()

    return one.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "shard long, tiles binary, sizes binary, centres binary, radii binary")


def _visit(visits: DataFrame, queries: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """``qid, source_id, vec_id, score``: the k best of each visited tile for each query that visits it."""
    wanted = visits.join(queries.select("qid", "qv"), "qid").select("tile", "qid", F.lit(None).cast("double").alias("floor"), "qv")
    blocks = _blocks(wanted.repartition("tile", F.xxhash64("qid") % 16).sortWithinPartitions("tile"), "tile")

    def run(batches):
        for b in batches:
            for source, ids, data, width, qids, qdata in zip(*(b.column(i).to_pylist() for i in range(6))):
                q, v, s = tile_topk(np.frombuffer(qids, "<i8"), _matrix(qdata, width), np.frombuffer(ids, "<i8"), _matrix(data, width),
                                    k, True, "dot")
                yield pa.record_batch({"qid": q, "source_id": pa.array(np.full(len(q), source, np.int32)), "vec_id": v, "score": s})

    met = tiles.select("tile", "source_id", "keys", "data", "width").join(blocks, "tile")
    return met.select("source_id", "keys", "data", "width", "qids", "qdata").mapInArrow(
        run, "qid long, source_id int, vec_id long, score double")


def _first_hits(q: DataFrame, tiles: DataFrame, k: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(packs, first visits, first hits)`` of :func:`knn_pruned`, stored."""
    packs = store(_ball_packs(tiles, shards), "ball-packs")
    none = q.withColumn("floor", F.lit(None).cast("double"))
    before = Window.partitionBy("qid").orderBy(F.desc("bound"), "tile").rowsBetween(Window.unboundedPreceding, -1)
    best = _bounds(none, packs, shards, k).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = store(best.where(F.col("held") < k).select("qid", "tile"), "first-visits")
    return packs, first, store(merge_topk(_visit(first, q, tiles, k), k).drop("rank"), "first-hits")


def _with_floor(q: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    floors = hits.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    return q.join(floors, "qid", "left").select("qid", "floor", "qv")


def pruned_visits(queries: DataFrame, tiles: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(first hits, further visits)``: what the first tiles give, and the ``qid, tile`` that their k-th score leaves."""
    shards = max(-(-tiles.count() // PACK_BALLS), 1)
    q = store(queries.select("qid", "qv"), "pruned-queries")
    packs, first, hits = _first_hits(q, tiles, k, shards)
    left = _bounds(_with_floor(q, hits, k), packs, shards, None)
    return hits, left.select("qid", "tile").join(first, ["qid", "tile"], "left_anti")


def _best(found: list[tuple], k: int) -> tuple:
    """``row, id, source, score`` of the k best per row, ties to the lower id, by ascending row."""
    row, ids, source, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return tuple(np.concatenate(x)[order] for x in zip(*found))


def _slab_topk(Q: np.ndarray, floors: np.ndarray, seen: list[list[int]], cell: list[tuple], centres: np.ndarray, radii: np.ndarray,
               k: int) -> tuple | None:
    """The k best vectors of a cell's tiles (``source, ids, vectors``) that reach the floor of each row of Q, without the
    tiles that it has seen."""
    size = np.sqrt((Q * Q).sum(axis=1))
    near = Q @ centres.T
    bound = near + size[:, None] * radii[None, :] + 1e-9 * (np.abs(near) + size[:, None] * (1 + radii[None, :]))
    for i, own in enumerate(seen):
        bound[i, own] = np.nan
    floors, found, new = floors.copy(), [], 0
    for j in np.argsort(-np.fmax.reduce(bound, axis=0), kind="stable"):  # what raises the floors most comes first
        want = np.flatnonzero(bound[:, j] >= floors)
        if not len(want):
            continue
        source, ids, C = cell[j]
        approx = Q[want] @ C.T
        approx += 1e-12 * max(Q.shape[1], 1) * size[want][:, None] * np.sqrt((C * C).sum(axis=1))[None, :]
        r, c = np.nonzero(approx >= floors[want][:, None])
        if len(r) > 2 * k * len(want):  # floors still low: the tile's own k best are enough
            r, v, s = tile_topk(want, Q[want], ids, C, k, True, "dot")
        else:
            r, v = want[r], ids[c]
            s = np.concatenate([_scores(Q[r[a:a + EXACT_PAIRS]], C[c[a:a + EXACT_PAIRS]], "dot")
                                for a in range(0, len(r), EXACT_PAIRS)] or [np.zeros(0)])
        ok = s >= floors[r]
        if ok.any():
            found.append((r[ok], v[ok], np.full(ok.sum(), source, np.int32), s[ok]))
            new += len(found[-1][0])
        if new > k * len(Q) // 2:
            found, new = [_best(found, k)], 0
            row, _, _, score = found[0]
            last = np.searchsorted(row, np.arange(len(Q)), "right") - 1
            full = np.bincount(row, minlength=len(Q)) == k
            floors[full] = np.maximum(floors[full], score[last[full]])
    return _best(found, k) if found else None


def _cells(q: DataFrame, tiles: DataFrame, k: int, tile_groups: int, query_groups: int) -> DataFrame:
    """``qid, source_id, vec_id, score``: for each query of ``q`` (``qid, floor, qv, seen``) and group of tiles, the k best
    vectors that reach the floor, in tiles that the query has not seen."""
    t = F.pmod(F.xxhash64("tile"), F.lit(tile_groups))
    h = F.pmod(F.xxhash64("qid"), F.lit(query_groups))
    groups = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = tiles.select(t.alias("t"), groups(query_groups).alias("h"), "tile", "source_id", "keys", "data", "width", "centre", "radius")
    right = q.select(groups(tile_groups).alias("t"), h.alias("h"), F.col("qid").cast("long").alias("qid"), "floor", "qv", "seen")
    out = pa.schema([("qid", pa.int64()), ("source_id", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(_, own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return out.empty_table()
        parts = zip(*(own.column(x).to_pylist() for x in ("source_id", "keys", "data", "width")))
        cell = [(source, np.frombuffer(keys, "<i8"), _matrix(data, width)) for source, keys, data, width in parts]
        centres = np.array([np.frombuffer(c, "<f8") for c in own.column("centre").to_pylist()])
        radii = own.column("radius").to_numpy()
        qids = asked.column("qid").to_numpy()
        floors = np.array([-np.inf if f is None else f for f in asked.column("floor").to_pylist()])
        Q = asked.column("qv").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1)
        place = {t: j for j, t in enumerate(own.column("tile").to_pylist())}
        seen = [[place[t] for t in ts or () if t in place] for ts in asked.column("seen").to_pylist()]
        got = []
        for at in range(0, len(qids), SLAB_QUERIES):
            part = slice(at, at + SLAB_QUERIES)
            best = _slab_topk(Q[part], floors[part], seen[part], cell, centres, radii, k)
            if best is not None:
                row, ids, source, score = best
                got.append(pa.table([qids[at + row], source, ids, score], schema=out))
        return pa.concat_tables(got) if got else out.empty_table()

    return left.groupBy("t", "h").cogroup(right.groupBy("t", "h")).applyInArrow(
        search, "qid long, source_id int, vec_id long, score double")


def knn_pruned(queries: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """Exact top k by dot product over all ``tiles`` for each of ``queries`` (``qid, qv``): the rows of ``knn_global``."""
    have = tiles.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n").cast("double") * F.col("width") * 8).alias("b")).first()
    q = store(queries.select("qid", "qv"), "pruned-queries")
    asked = q.agg(F.sum(F.size("qv").cast("double") * 8)).first()[0] or 0
    _, first, hits = _first_hits(q, tiles, k, max(-(-have.n // PACK_BALLS), 1))
    seen = first.groupBy("qid").agg(F.collect_list("tile").alias("seen"))  # k tiles at most
    found = _cells(_with_floor(q, hits, k).join(seen, "qid", "left"), tiles, k,
                   max(TILE_GROUPS, int(-(-(have.b or 0) // CELL_BYTES))), max(1, int(-(-asked // CELL_BYTES))))
    further = found.join(q.select("qid"), "qid")  # as the first hits: an id that comes twice asks twice
    return merge_topk(hits.unionByName(further.select("qid", "source_id", "vec_id", "score")), k)
