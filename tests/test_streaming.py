import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import store
from glossa.sources.tables import Table, TableStore
from glossa.streaming import timed
from glossa.streaming.state import first_seen, minute_counts, segments, sliding_limiter


def run(spark, tmp_path, events, make, mode, name):
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_minute_counts_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, i) for i in range(400)], "user_id long, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    got = run(spark, tmp_path, events, minute_counts, "complete", "minutes")
    want = events.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    assert sorted((r.user_id, r.minute, r.n) for r in got.collect()) == sorted((r.user_id, r.minute, r.n) for r in want.collect())


def test_first_seen_keeps_one_row_per_key(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 5) for i in range(40)], "event_id long, k long").withColumn("ts", F.timestamp_seconds("event_id"))
    got = run(spark, tmp_path, events, lambda s: first_seen(s, "k"), "append", "firsts")
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 3, 4]


def clock(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, ms long").selectExpr("user_id", "event_id", "timestamp_millis(ms) as ts")


def test_limiter_counts_calls_that_are_a_minute_old(spark):
    calls = clock(spark, [(1, i, i) for i in range(10)] + [(1, 10, 60_000), (1, 11, 60_001), (1, 12, 60_001), (2, 13, 5)])
    got = {r.event_id: r.accepted for r in sliding_limiter(calls, "user_id").collect()}
    assert got == {i: True for i in range(10)} | {10: False, 11: True, 12: False, 13: True}


def folded(calls, limit, span):
    """accepted by event_id, one call after the other."""
    recent, out = {}, {}
    for who, event_id, t in sorted(calls, key=lambda c: (c[2], c[1])):
        q = recent.setdefault(who, deque())
        while q and t - q[0] > span:
            q.popleft()
        out[event_id] = len(q) < limit
        if out[event_id]:
            q.append(t)
    return out


@pytest.mark.parametrize(("step", "limit", "span"), [(40, 3, 100), (400, 3, 100), (5, 10, 60), (2_000_000, 2, 7_200_000), (4_000_000, 2, 7_200_000)])
def test_limiter_cut_at_gaps_equals_one_fold(spark, step, limit, span):
    rng, t, calls = random.Random(step), 0, []
    for i in range(400):
        t += rng.choice([0, 1, step // 2, step, 3 * step])
        calls.append((rng.choice([1, 1, 1, 2, None]), i, t))
    df = clock(spark, calls).repartition(3)
    got = {r.event_id: r.accepted for r in sliding_limiter(df, "user_id", limit, span).collect()}
    assert got == folded(calls, limit, span)
    starts = {(r.user_id, r.start) for r in segments(df.select("user_id", "event_id", F.unix_millis("ts").alias("t")), "user_id", span).collect()}
    want, last = set(), {}
    for who, _, t in sorted(calls, key=lambda c: c[2]):
        if who not in last or t - last[who] > span:
            want.add((who, t))
        last[who] = t
    assert starts == want
    assert sliding_limiter(df.limit(0), "user_id").count() == 0


DAY = 86_400_000


def arriving(spark, tmp_path, *batches):
    """A stream that takes the rows (user_id, event_id, ms after a day of 1972) of a batch with each micro-batch, and then one a year later, whose watermark is past them all."""
    batches = [[(who, e, ms + 1000 * DAY) for who, e, ms in b] for b in batches]
    last = (0, -1, max(ms for b in batches for _, _, ms in b) + 365 * DAY)
    for i, rows in enumerate([*batches, [last]]):
        clock(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    kind = clock(spark, [last]).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_late_events_are_placed_by_their_time(spark, tmp_path):
    calls = [(i % 3, i, i * 2500 + (i % 7) * 900) for i in range(90)]
    mixed = random.Random(4).sample(calls, len(calls))  # all are at most four minutes late
    stream = arriving(spark, tmp_path, mixed[:30], mixed[30:60], mixed[60:])
    got = {r.event_id: r.accepted for r in timed.drained(timed.limited(stream, "user_id", limit=4)).collect()}
    assert got == folded(calls, 4, 60_000) and not all(got.values())


def test_quota_of_days(spark, tmp_path):
    days = [(i % 2, i, i * 9_000_000) for i in range(60)]
    got = timed.drained(timed.under_quota(arriving(spark, tmp_path, days[:20], days[20:]), "user_id", late="1 day"))
    want = store.within_quota(clock(spark, days), "user_id", F.col("ts"), ["ts", "event_id"])
    assert sorted((r.event_id, r.nth) for r in got.where("nth > 0").collect()) == sorted((r.event_id, r.nth) for r in want.collect()) and got.count() == 60


def test_cache_with_a_lifetime(spark, tmp_path):
    events = [(1, 0, 0), (1, 1, 30 * DAY), (1, 2, 30 * DAY + 1), (1, 3, 31 * DAY), (2, 4, 31 * DAY)]
    got = timed.drained(timed.cached(arriving(spark, tmp_path, events[:2], events[2:]), "user_id"))
    assert {r.event_id: r.hit for r in got.collect()} == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_reviews_over_batches_equal_one_fold(spark, tmp_path):
    rows = [(c, 10 * c + i, i * 1000) for c in range(1, 4) for i in range(9)]
    mixed = random.Random(1).sample(rows, len(rows))
    stream = arriving(spark, tmp_path, mixed[:9], mixed[9:]).withColumn("ok", F.col("event_id") % (F.col("user_id") + 2) != 0).withColumnRenamed("user_id", "card")
    got = timed.drained(timed.reviewed(stream)).groupBy("card").agg(F.max_by(F.struct("box", "correct", "incorrect"), F.col("correct") + F.col("incorrect")).alias("s")).select("card", "s.*")
    batch = clock(spark, rows).select(F.col("user_id").alias("card"), "event_id", "ts", (F.col("event_id") % (F.col("user_id") + 2) != 0).alias("correct"))
    assert sorted(map(tuple, got.collect())) == sorted((r.card, r.box, r.correct, r.incorrect) for r in store.review_fold(batch).collect())


def test_state_of_idle_keys_is_dropped(spark, tmp_path):
    """A processor whose state is a plain dictionary in place of Spark's."""

    class Held:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def clear(self):
            self.value = None

        def update(self, value):
            self.value = value

        def put(self, value):
            self.value = list(value)

        def appendList(self, value):
            self.value = [*(self.value or []), *value]

    class Handle:
        def __init__(self):
            self.timers = set()

        def getListState(self, *a):
            return Held()

        getValueState = getListState

        def registerTimer(self, t):
            self.timers.add(t)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def decide(kept, t, ok):
        return [len(kept or [])], [*(kept or []), t]

    p = timed.InTimeOrder(decide, lambda kept: kept[-1] + 100)
    p.init(h := Handle())
    feed = lambda *ts: list(p.handleInputRows((1,), [{"t": t, "event_id": t, "ok": True} for t in ts], Now(0)))

    def at(ms):
        fired = [t for t in h.timers if t <= ms]
        h.timers.difference_update(fired)
        return [(r.event_id, r.result[0]) for _ in fired for r in p.handleExpiredTimer((1,), Now(ms), None)]

    feed(30, 10, 50)
    assert at(9) == [] and at(40) == [(10, 0), (30, 1)] and len(p.waiting.value) == 1
    feed(45)
    assert at(60) == [(45, 2), (50, 3)] and p.waiting.value is None and p.kept.value is not None
    assert at(149) == [] and p.kept.value is not None
    assert at(150) == [] and p.kept.value is None and not h.timers  # nothing is left of an idle key
    feed(400, 600)
    assert at(700) == [(400, 0), (600, 0)]  # what was kept ended between them
    assert p.kept.value is None and p.waiting.value is None


def test_once_is_resumed_in_mid_batch(spark, tmp_path):
    """A run that breaks off before a commit, one that breaks off behind it, then a whole one: each word once, each batch once."""
    rows = [[(b * 3 + i, b * 10 + i, b * 10 * DAY) for i in range(4)] for b in range(4)]  # a batch begins with the last word of the one before, ten days on
    for i, b in enumerate(rows):
        clock(spark, b).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    tables = {"words": Table("user_id long, event_id long, ts timestamp", "user_id"), "batches": timed.BATCHES}
    target = TableStore(spark, str(tmp_path / "store"), tables)
    stream = lambda: spark.readStream.schema(clock(spark, rows[0]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    claim, seen = target._claim, []

    def breaks(version, token):
        seen.append(version)
        if len(seen) == 2:
            raise OSError("before the commit")
        won = claim(version, token)
        if len(seen) == 4:
            raise OSError("behind the commit")
        return won

    target._claim = breaks
    for _ in range(2):
        with pytest.raises(Exception, match="the commit"):
            timed.first_ever(stream(), target, "words", ["ts", "event_id"], str(tmp_path / "c"))
    timed.first_ever(stream(), target, "words", ["ts", "event_id"], str(tmp_path / "c"))
    got = sorted((r.user_id, r.event_id) for r in target.read("words").collect())
    want = {}
    for b in rows:
        for w, e, _ in b:
            want.setdefault(w, e)
    assert got == sorted(want.items())
    assert sorted(map(tuple, target.read("batches").collect())) == [(0, 4), (1, 3), (2, 3), (3, 3)]


def test_waiting_events_are_packed(spark, tmp_path):
    """a micro-batch's events of a key come to its state as one row and wait there as one value, not each by itself."""
    calls = [(i % 5, i, 1000 * DAY + i * 90_000) for i in range(3000)]
    clock(spark, calls).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clock(spark, calls[:1]).schema).parquet(str(tmp_path / "in"))
    with timed.state_store(spark):
        q = timed.under_quota(stream, "user_id").writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    values = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators]
    assert values and max(values) <= 4 * 5  # a few for each key, whatever the number of its events
    seen, want = {}, {}
    for who, e, t in calls:
        if t <= calls[-1][2] - 600_000:
            n = seen[who, t // DAY] = seen.get((who, t // DAY), 0) + 1
            want[e] = n if n <= 3 else 0
    assert {r.event_id: r.nth for r in spark.table("packed").collect()} == want


def test_packs_of_a_task_and_rows_of_a_key_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(timed, "PACK", 4)
    monkeypatch.setattr(timed, "OUT", 3)
    rows = pa.RecordBatch.from_pydict({"key": ["a", None, "a", "b", "a", None], "t": [5, 4, 3, 2, 1, 0], "event_id": [1, 2, None, 4, 5, 6], "ok": [True, None, False, True, True, True]})
    got = [(k, np.frombuffer(e, timed.EVENT).tolist()) for b in timed.packed(iter([rows.slice(0, 4), rows.slice(4)])) for k, e in zip(*b.to_pydict().values())]
    assert got == [("a", [(5, 1, True, True), (3, 0, False, False)]), (None, [(4, 2, True, False)]), ("b", [(2, 4, True, True)]), ("a", [(1, 5, True, True)]), (None, [(0, 6, True, True)])]
    assert list(timed.packed(iter([]))) == []

    class Kept(list):
        def appendList(self, values):
            self.extend(values)

        def get(self):
            return list(self)

        def exists(self):
            return bool(self)

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 6)

    p = timed.InPacks(lambda kept, t, ok: ([t], None), lambda kept: None)
    p.waiting, timers = Kept(), []
    p.kept = type("None_", (), {"get": lambda self: None, "exists": lambda self: False, "clear": lambda self: None})()
    p.handle = type("Handle", (), {"registerTimer": lambda self, t: timers.append(t)})()
    packs = [{"events": np.array([(t, 100 - t, True, True) for t in some], timed.EVENT).tobytes()} for some in ([9, 6, 12, 7], [11, 5, 8, 10])]
    list(p.handleInputRows(("a",), iter(packs), Now))  # the one at 5 is older than the watermark
    assert [len(e) // timed.EVENT.itemsize for e, in p.waiting] == [4, 3] and timers == [6]
    Now.getCurrentWatermarkInMs = staticmethod(lambda: 10)
    assert [(r.event_ids, r.results) for r in p.handleExpiredTimer(("a",), Now, None)] == [([94, 93, 92], [[6], [7], [8]]), ([91, 90], [[9], [10]])]
    assert [np.frombuffer(e, timed.EVENT)["t"].tolist() for e, in p.waiting] == [[11, 12]] and timers == [6, 11]


def test_null_keys_ids_and_times_of_a_stream(spark, tmp_path):
    """Null is a key of its own, an event without an id comes last of its time, one without a time is left out."""
    rows = [("x", 1, 10), ("x", None, 10), (None, 2, 20), ("x", 3, None), (None, 4, 30), ("x", 0, 10), ("end", 9, 5 * DAY)]
    events = spark.createDataFrame(rows, "who string, event_id long, ms long").selectExpr("who", "event_id", "timestamp_millis(ms) as ts")
    events.write.parquet(str(tmp_path / "in"))
    got = timed.drained(timed.under_quota(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "who", quota=2))
    assert {(r.who, r.event_id, r.nth) for r in got.collect()} == {("x", 0, 1), ("x", 1, 2), ("x", None, 0), (None, 2, 1), (None, 4, 2)} and got.count() == 5
    assert got.dtypes == [("who", "string"), ("event_id", "bigint"), ("nth", "bigint")]


def test_an_event_late_by_the_whole_delay_is_placed(spark, tmp_path):
    delay = 600_000
    first, second = [(1, 0, 0), (1, 1, delay + 50)], [(1, 2, 50), (1, 3, 49), (1, 4, 60)]  # the watermark is at 50 when the second micro-batch comes, so 3 is late
    got = timed.drained(timed.under_quota(arriving(spark, tmp_path, first, second), "user_id", quota=10))
    assert {r.event_id: r.nth for r in got.collect()} == {0: 1, 2: 2, 4: 3, 1: 4}
