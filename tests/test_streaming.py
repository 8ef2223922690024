"""Gather barrier: duplicates, late and missing replies, unrouted queries, any cut into micro-batches."""

import datetime as dt

import pytest

from fedsearch.streaming import gather as S

T0 = dt.datetime(2024, 1, 1)


def ev(qid, sec, kind, source=None, expected=None, hits=None):
    return (qid, T0 + dt.timedelta(seconds=sec), kind, source, expected, hits, None if hits is None else 10 * hits)


EVENTS = [
    ev(1, 0, "route", expected=2), ev(1, 1, "reply", 0, hits=5), ev(1, 2, "reply", 1, hits=3),          # complete
    ev(2, 0, "route", expected=2), ev(2, 1, "reply", 0, hits=5), ev(2, 2, "reply", 0, hits=5),          # one twice
    ev(3, 0, "route", expected=0),                                                                       # unrouted
    ev(4, 0, "route", expected=1), ev(4, 301, "reply", 3, hits=9),                                       # too late
    ev(5, 0, "route", expected=1), ev(5, 299, "reply", 3, hits=9), ev(5, 400, "reply", 3, hits=9),      # in time, again
    ev(6, 0, "route", expected=3), ev(6, 299, "reply", 3, hits=1), ev(6, 299, "reply", 4, hits=1),      # one is missing
    ev(7, 1, "reply", 2, hits=2), ev(7, 2, "route", expected=1),                                         # reply first
]
WANT = {1: ("complete", 2, 2, 8, 80, 0), 2: ("timeout", 2, 1, 5, 50, 1), 3: ("complete", 0, 0, 0, 0, 0),
        4: ("timeout", 1, 0, 0, 0, 1), 5: ("complete", 1, 1, 9, 90, 1), 6: ("timeout", 3, 2, 2, 20, 0),
        7: ("complete", 1, 1, 2, 20, 0)}


@pytest.mark.parametrize("cut", [1, 4, len(EVENTS)])
def test_gather_is_the_same_for_any_batches(spark, tmp_path, cut):
    src = str(tmp_path / "in")
    batches = [EVENTS[i:i + cut] for i in range(0, len(EVENTS), cut)]
    batches += [[ev(-1, 10 ** 6, "route", expected=0)], [ev(-2, 2 * 10 ** 6, "route", expected=0)]]
    for b in batches:
        spark.createDataFrame(b, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(S.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    rows = S.run_available(S.gather_barrier(stream, delay="20 minutes"), str(tmp_path / "q"))
    got = {r.qid: (r.status, r.expected, r.n_sources, r.n_hits, r.bytes, r.dropped)
           for r in S.gathered(rows.where("qid > 0")).collect()}
    assert got == WANT


def test_gather_stream_at_any_span_of_event_time(spark, monkeypatch):
    """Query ids, and so event times, far apart; every event in a file of its own, the last ones first."""
    from fedsearch.plans import q_stream
    far = [ev(q, q + sec, *rest, **more) for q in (0, 1_000_000, 2_500_000) for sec, rest, more in (
        (0, ("route",), {"expected": 2}), (1, ("reply", 0), {"hits": 5}), (400, ("reply", 1), {"hits": 3}))]
    far += [ev(q, q + sec, *rest, **more) for q in (1, 1_000_001, 2_500_001) for sec, rest, more in (
        (0, ("route",), {"expected": 1}), (1, ("reply", 0), {"hits": 5}), (2, ("reply", 0), {"hits": 5}))]
    events = spark.createDataFrame(spark.sparkContext.parallelize(far[::-1], len(far)), S.EVENT_SCHEMA)
    monkeypatch.setattr(q_stream, "_gather_events", lambda *_: events)
    got = {r.qid: (r.status, r.expected, r.n_sources, r.n_hits, r.bytes, r.dropped)
           for r in q_stream.gather_stream(spark, None).collect()}
    assert got == {q + i: want for q in (0, 1_000_000, 2_500_000)
                   for i, want in enumerate([("timeout", 2, 1, 5, 50, 1), ("complete", 1, 1, 5, 50, 1)])}


def replayed(spark, tmp_path, events, schema, slices):
    df = spark.createDataFrame(events, schema).repartition(7)
    files = S.write_in_time_order(df, str(tmp_path / "in"), slices=slices)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))


def test_timeouts_leave_while_the_stream_runs(spark, tmp_path):
    """A query a second for 6,000 s, every second one unanswered; no closing event."""
    events = [e for q in range(6000) for e in ([ev(q, q, "route", expected=1)] + ([ev(q, q + 1, "reply", 0, hits=1)] if q % 2 else []))]
    stream = replayed(spark, tmp_path, events, S.EVENT_SCHEMA, 12)
    q = S.start(S.gather_barrier(stream, delay="30 seconds"), str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    S.finish(q)
    marks = [p["eventTime"]["watermark"] for p in q.recentProgress if p["eventTime"]]
    assert len(set(marks)) >= 10 and marks == sorted(marks)
    # open: a slice of 500 s and what waits or is remembered for twice 300 s and the delay
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 1700
    rows = spark.read.schema(S.GATHER_SCHEMA).parquet(str(tmp_path / "out"))
    got = {r.qid: r.status for r in rows.collect()}
    assert sum(s == "complete" for s in got.values()) == 3000
    late = {q for q, s in got.items() if s == "timeout"}
    assert late >= set(range(0, 5600, 2)) and not any(q % 2 for q in late)


def plain_queue(arrivals, limit):
    """(qid, ms, duration) -> qid: (start, number waiting before it)."""
    ends, out = [], {}
    for qid, at, duration in sorted(arrivals, key=lambda a: (a[1], a[0])):
        ends.sort()
        start = at if len(ends) < limit else max(at, ends[0])
        ends = (ends if len(ends) < limit else ends[1:]) + [start + duration]
        out[qid] = (start, sum(s > at for s, _ in out.values()))
    return out


@pytest.mark.parametrize("slices", [1, 5])
def test_admission_is_a_queue(spark, tmp_path, slices):
    import random
    r = random.Random(4)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    queue = {name: [(i, base + r.randrange(3_000) * 1000, r.randrange(1, 400) * 1000) for i in range(n)] for name, n in (("a", 300), ("b", 40))}
    schema = "router string, qid long, ts timestamp, duration_ms long"
    rows = [(name, i, dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None), d)
            for name, qs in queue.items() for i, ms, d in qs]
    stream = replayed(spark, tmp_path, rows, schema, slices)
    for beat in (1, 2):
        spark.createDataFrame([(n, -1, T0 + dt.timedelta(days=beat), 0) for n in queue], schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    got = S.run_available(S.admission(stream, 20, "30 seconds"), str(tmp_path / "q")).where("qid >= 0").collect()
    for name, qs in queue.items():
        want = plain_queue(qs, 20)
        mine = {x.qid: (int(x.started.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), x.waiting) for x in got if x.router == name}
        assert mine == want
        assert all(x.waited_ms == (x.started - x.arrived).total_seconds() * 1000 for x in got)
    assert any(x.waited_ms for x in got if x.router == "a") and not any(x.waited_ms for x in got if x.router == "b")


def test_repeats_inside_and_outside_the_bound(spark, tmp_path):
    """Asked again after ten seconds: known; after ten days, the watermark being past it: anew. Ids of the log never pass."""
    at = [(1000 + day * 100 + q, T0 + dt.timedelta(days=day, seconds=q)) for q in range(100) for day in (5, 15)]
    at += [(q, T0 + dt.timedelta(days=day, seconds=q + again)) for q in range(50) for day in (0, 10, 20) for again in (0, 10)]
    stream = replayed(spark, tmp_path, at, "qid long, ts timestamp", 10)
    done = spark.createDataFrame([(3,), (4,), (4,)], "qid long")
    got = S.run_available(S.skip_done_stream(stream, done, ["qid"], "ts", "1 hour"), str(tmp_path / "q")).where("qid < 1000").groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in got} == {q: 3 for q in range(50) if q not in (3, 4)}


def test_running_totals_keep_the_last_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for b in ([("x", True), ("x", False)], [("y", True)], [("x", True)]):
        spark.createDataFrame(b, "bank string, correct boolean").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("bank string, correct boolean").option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_complete(S.running_accuracy(stream, ["bank"]), str(tmp_path / "q"))
    assert {r.bank: (r.total, r.n_correct) for r in out.collect()} == {"x": (3, 2), "y": (1, 1)}
