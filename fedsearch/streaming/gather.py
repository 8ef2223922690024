"""Streaming operators (survey 2.L).

The reference is a live service: queries arrive, are routed, fan out to
sources, and are answered once every routed source has replied. Here that is
a Structured Streaming job over an event stream:

  route event  (qid, ts, kind='route', expected = number of routed sources)
  reply event  (qid, ts, kind='reply', source_id, n_hits, bytes)  one per source

``gather_barrier`` keeps per-query state with ``applyInPandasWithState``. A
query waits from its first event for a fixed time: it emits a ``complete`` row
when that many different sources replied in time (L3), at once when nothing
was routed (L4), and a ``timeout`` row when the watermark passes its deadline
first. Replies that come twice, after the deadline or after completion are
dropped and counted; the count leaves in a ``dropped`` row when the state goes
(L5). What counts is decided by event times and source ids, so the result does
not depend on where micro-batches are cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappush, heapreplace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fedsearch.session import store

EVENT_SCHEMA = ("qid bigint, ts timestamp, kind string, source_id int, expected int, n_hits bigint, bytes bigint")
GATHER_SCHEMA = ("qid bigint, status string, expected int, n_sources int, n_hits bigint, "
                 "bytes bigint, dropped int")
STATE_SCHEMA = ("expected int, sources array<int>, n_hits bigint, bytes bigint, dropped int, "
                "deadline bigint, status string, early array<array<bigint>>")

QUERY_TIMEOUT_MS = 300_000  # a query waits at most 300 s for its sources


def _make_gather(timeout_ms: int):
    def gather(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        qid = int(key[0])
        if state.exists:
            expected, sources, n_hits, nbytes, dropped, deadline, status, early = state.get
        else:
            expected, sources, n_hits, nbytes, dropped, deadline, status, early = -1, [], 0, 0, 0, None, "", []
        sources = list(sources)
        # replies (ts, source, n_hits, bytes) that came before their route: only it tells whether they are in time
        early = [[int(x) for x in reply] for reply in early]

        def row(name: str, lost: int = 0) -> pd.DataFrame:
            return pd.DataFrame({"qid": [qid], "status": [name], "expected": [max(expected, 0)],
                                 "n_sources": [len(sources)], "n_hits": [n_hits], "bytes": [nbytes],
                                 "dropped": [lost]})

        def take(ts: int, source: int, hits: int, size: int) -> None:
            nonlocal dropped, n_hits, nbytes
            if status or ts > deadline or source in sources:
                dropped += 1
            else:
                sources.append(source)
                n_hits, nbytes = n_hits + hits, nbytes + size

        def take_early() -> None:
            for reply in sorted(early):
                take(*reply)
            early.clear()

        for pdf in [] if state.hasTimedOut else pdfs:
            pdf = pdf.sort_values(["ts", "source_id"], kind="stable")
            at = pdf["ts"].astype("datetime64[ms, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[ms]").astype("int64")
            if deadline is None:
                deadline = int(at.min()) + timeout_ms
            for kind, ts, source, want, hits, size in zip(pdf["kind"], at, pdf["source_id"], pdf["expected"],
                                                          pdf["n_hits"], pdf["bytes"]):
                if kind == "route":
                    deadline, expected = int(ts) + timeout_ms, int(want)
                    take_early()
                elif expected < 0 and not status:
                    early.append([int(ts), int(source), int(hits), int(size)])
                    deadline = min(deadline, int(ts) + timeout_ms)
                else:
                    take(int(ts), int(source), int(hits), int(size))

        if not status and 0 <= expected <= len(sources):
            status = "complete"
            yield row(status)
        now = state.getCurrentWatermarkMs()
        if not status and now >= deadline:
            take_early()
            status = "timeout"
            yield row(status)
        # a finished query is kept for one more waiting time: a reply that comes then is
        # known to be too late and does not open a query of its own
        until = deadline + timeout_ms if status else deadline
        if now >= until:
            if dropped:
                yield row("dropped", dropped)
            state.remove()
        else:
            state.update((expected, sources, n_hits, nbytes, dropped, deadline, status, early))
            state.setTimeoutTimestamp(until)
    return gather


def gather_barrier(events: DataFrame, timeout_ms: int = QUERY_TIMEOUT_MS, delay: str = "10 minutes") -> DataFrame:
    """Per-query barrier over a stream of events; ``delay``: how far events may come out of order."""
    return events.withWatermark("ts", delay).groupBy("qid").applyInPandasWithState(
        _make_gather(timeout_ms), GATHER_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def gathered(rows: DataFrame) -> DataFrame:
    """One row per query of :func:`gather_barrier`'s rows: its outcome and what was dropped."""
    outcome = F.col("status") != "dropped"
    first = [F.max(F.when(outcome, F.col(c))).alias(c) for c in ("status", "expected", "n_sources", "n_hits", "bytes")]
    return rows.groupBy("qid").agg(*first, F.sum("dropped").cast("int").alias("dropped"))


def route_events(routed: DataFrame, queries: DataFrame) -> DataFrame:
    """One route event per query (``qid, ts``) carrying its expected reply count (0 allowed)."""
    n = routed.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("expected"))
    q = queries.select("qid", "ts").join(n, "qid", "left")
    return q.select("qid", "ts", F.lit("route").alias("kind"), F.lit(None).cast("int").alias("source_id"),
                    F.coalesce("expected", F.lit(0)).alias("expected"),
                    F.lit(None).cast("bigint").alias("n_hits"), F.lit(None).cast("bigint").alias("bytes"))


def reply_events(replies: DataFrame) -> DataFrame:
    """Reply events of ``replies`` (``qid, ts, source_id, n_hits, bytes``): a source's whole answer as one message."""
    return replies.select("qid", "ts", F.lit("reply").alias("kind"), F.col("source_id").cast("int"),
                          F.lit(None).cast("int").alias("expected"), "n_hits", "bytes")


def running_accuracy(graded: DataFrame, by: list[str]) -> DataFrame:
    """Running totals of a stream of graded answers (L7); use complete mode."""
    c = F.col("correct").cast("int")
    return graded.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                                   F.sum(c).cast("bigint").alias("n_correct"),
                                   F.avg(c.cast("double")).alias("accuracy"))


def skip_done_stream(stream: DataFrame, done: DataFrame, keys: list[str], ts: str | None = None,
                     bound: str = "1 hour") -> DataFrame:
    """Never answer the same question twice (L8): a stream-static anti join with the log of earlier runs and, with the
    event time ``ts``, the first of the questions that the stream itself repeats within ``bound``."""
    fresh = stream.join(done.select(*keys).distinct(), keys, "left_anti")
    return fresh if ts is None else fresh.withWatermark(ts, bound).dropDuplicatesWithinWatermark(keys)


ADMITTED_SCHEMA = "router string, qid bigint, arrived timestamp, started timestamp, waited_ms bigint, waiting int"
_QUEUE_SCHEMA = "ends array<bigint>, held array<array<bigint>>, starts array<bigint>"


def _make_admission(limit: int):
    def admit(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # ends: when the running queries end (a heap); held: (arrival, qid, duration) behind the watermark;
        # starts: starts still to come, in order
        ends, held, starts = ([list(x) for x in state.get] if state.exists else ([], [], []))
        held = [tuple(int(x) for x in h) for h in held]
        if not state.hasTimedOut:
            for pdf in pdfs:
                at = pdf["ts"].astype("datetime64[ms, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[ms]").astype("int64")
                held += zip(at.tolist(), pdf["qid"].tolist(), pdf["duration_ms"].tolist())
        now = state.getCurrentWatermarkMs()
        held.sort()
        due = bisect_left(held, (now,))  # no earlier arrival can come any more
        out = []
        for arrived, qid, duration in held[:due]:
            start = arrived if len(ends) < limit else max(arrived, ends[0])
            if len(ends) < limit:
                heappush(ends, start + duration)
            else:
                heapreplace(ends, start + duration)
            starts = starts[bisect_right(starts, arrived):]
            out.append((str(key[0]), qid, arrived, start, start - arrived, len(starts)))
            starts.append(start)
        held = held[due:]
        state.update((ends, [list(h) for h in held], starts))
        if held:  # fires once the watermark has passed all that are held
            state.setTimeoutTimestamp(max(held[-1][0], now) + 1)
        if out:
            rows = pd.DataFrame(out, columns=["router", "qid", "arrived", "started", "waited_ms", "waiting"])
            for c in ("arrived", "started"):
                rows[c] = pd.to_datetime(rows[c], unit="ms")
            yield rows
    return admit


def admission(queries: DataFrame, limit: int, delay: str) -> DataFrame:
    """At most ``limit`` queries of a router run at a time, the others wait in the order of their arrival.

    ``queries``: a stream of ``router, qid, ts, duration_ms``. A query starts
    when it arrives or, if ``limit`` are running, when the first of them ends;
    its row says when, how long it waited and how many waited before it.
    Arrivals are held until the watermark has passed them, so the outcome
    does not depend on how the stream is cut. A router is one queue and so
    one key: its state is ``limit`` end times, the starts still ahead and the
    arrivals within ``delay``.
    """
    return queries.withWatermark("ts", delay).groupBy("router").applyInPandasWithState(
        _make_admission(limit), ADMITTED_SCHEMA, _QUEUE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def write_in_time_order(events: DataFrame, path: str, ts: str = "ts", slices: int = 4, rows_per_file: int = 50_000) -> int:
    """Write ``events`` as files that a file stream reads in the order of event time; files per trigger.

    A file stream takes files by their age. The events are cut into ``slices``
    ranges of time with about equally many rows, written one after the other
    as the same number of files each: with that number per trigger, a
    micro-batch is a range of time and no event comes behind a later one.
    """
    spark = events.sparkSession
    rows = store(events.repartitionByRange(ts).sortWithinPartitions(ts), "events")  # a slice reads its own part
    cuts = [(i + 1) / slices for i in range(slices - 1)]
    found = rows.agg(F.percentile_approx(F.unix_micros(ts), F.array(*map(F.lit, cuts)), 10_000).alias("c"),
                     F.count(F.lit(1)).alias("n")).first()
    bounds = sorted({c for c in found.c or []})
    # few enough that no file of a slice is empty
    files = max(1, min(spark.sparkContext.defaultParallelism, found.n // slices // rows_per_file))
    at = F.timestamp_micros
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows if low is None else rows.where(F.col(ts) >= at(F.lit(low)))
        part = part if high is None else part.where(F.col(ts) < at(F.lit(high)))
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return files


def start(df: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None, **trigger):
    """Start a query that appends to Parquet files under ``path``.

    State partitions are fixed when a stream first starts; they default to
    the cluster's cores (every micro-batch runs one task per partition), not
    to the batch shuffle setting, which is restored right after.
    """
    conf = df.sparkSession.conf
    parts = state_partitions or df.sparkSession.sparkContext.defaultParallelism
    saved = conf.get("spark.sql.shuffle.partitions", None)
    conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return (df.writeStream.format("parquet").outputMode("append").option("path", path)
                  .option("checkpointLocation", checkpoint).trigger(**trigger).start())
    finally:
        if saved is None:
            conf.unset("spark.sql.shuffle.partitions")
        else:
            conf.set("spark.sql.shuffle.partitions", saved)


def finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_available(df: DataFrame, root: str) -> DataFrame:
    """Drain a streaming DataFrame with ``availableNow`` into Parquet files under ``root``."""
    finish(start(df, f"{root}/out", f"{root}/checkpoint", availableNow=True))
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


def run_complete(df: DataFrame, root: str) -> DataFrame:
    """Drain running totals: each micro-batch writes all of them anew; the last one's are returned."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    finish(df.writeStream.outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    every = df.sparkSession.read.parquet(f"{root}/out")
    return every.where(F.col("epoch") == every.agg(F.max("epoch").alias("e")).scalar()).drop("epoch")


def route_stream(queries: DataFrame, centroids: DataFrame, n_sources: int, threshold: float,
                 slope: float = 4.0) -> DataFrame:
    """Routing of arriving queries (L1): each (query, source) pair is scored
    against the static source centroids (stream-static equi-join on
    ``source_id``) and kept when the unrounded probability is strictly above
    the threshold (E3). ``n_sources`` is the federation size (configuration)."""
    from fedsearch.functions.vectors import dot
    pairs = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_sources - 1))).alias("source_id"))
    j = pairs.join(centroids, "source_id")
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(slope) * dot("qv", "seed")))
    return j.select("qid", "source_id", prob.alias("prob")).where(F.col("prob") > F.lit(threshold))


def retrieve_stream(routed: DataFrame, tiles_path: str, k: int, out_path: str, checkpoint: str):
    """Per-source search of arriving routed queries (L2): every micro-batch joins the stored tiles
    (``operators.tiles``) as they are then, vectors added since the last one among them, and appends its hits."""
    from fedsearch.operators.retrieve import knn_tiles
    from fedsearch.operators.tiles import read_tiles

    def run(batch: DataFrame, epoch: int) -> None:
        hits = knn_tiles(batch, read_tiles(batch.sparkSession, tiles_path), k).withColumn("epoch", F.lit(epoch))
        # idempotent per epoch: a retried batch rewrites its own partition only
        hits.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    finish(routed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    return routed.sparkSession.read.parquet(out_path)
