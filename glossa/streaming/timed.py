"""Streams that decide about each event in the order of event time, with state that ends.

Events are dealt by their key and packed, many in one value, before they come to its state. They wait there until the watermark says
that no earlier one can come, so an event that is late by up to the stated delay is placed where it belongs, whatever micro-batch brings
it; one that is later than that is left out. A timer at the least waiting time then folds what is due; another
one clears what is kept once it is as good as nothing. So the state of a key holds the events of one delay and a few numbers, and none
when it has been idle. The state store must be RocksDB (state_store())."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from glossa.functions import constants as K
from glossa.sources.readers import scratch
from glossa.sources.tables import Table, TableStore

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """RocksDB as the state store of queries that start inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: An event as it waits, in a few bytes: its time in ms, its id (if known), and whether it went well.
EVENT = np.dtype([("t", "<i8"), ("event_id", "<i8"), ("known", "?"), ("ok", "?")])
#: At most so many events are packed at once, and so many come out of state in one row.
PACK, OUT = 200_000, 10_000


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, events: the events (key, t, event_id, ok) of each key in one value, an array of EVENT; once for every PACK events of a task."""

    def together(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows["key"].chunk(0).dictionary_encode("encode")
        of = keys.indices.to_numpy()
        events = np.empty(rows.num_rows, EVENT)
        events["t"], events["known"] = rows["t"].to_numpy(), rows["event_id"].is_valid().to_numpy()
        events["event_id"], events["ok"] = rows["event_id"].fill_null(0).to_numpy(), rows["ok"].fill_null(False).to_numpy()
        ends = np.cumsum(np.bincount(of, minlength=len(keys.dictionary))) * EVENT.itemsize
        data = [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4")), pa.py_buffer(events[np.argsort(of, kind="stable")].tobytes())]
        return pa.RecordBatch.from_arrays([keys.dictionary, pa.Array.from_buffers(pa.binary(), len(ends), data)], ["key", "events"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= PACK:
            yield together(held)
            held, n = [], 0
    if n:
        yield together(held)


class InTimeOrder(StatefulProcessor):
    """decide(kept, time in ms, ok) of each event in time order gives (result, kept); kept is a list of whole numbers, None at first and after
    the time until(kept), from which it makes no difference (None: never). Waiting events are packed, those of a micro-batch in one value."""

    def __init__(self, decide: Callable, until: Callable):
        self.decide, self.until = decide, until

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.kept = handle.getValueState("kept", "numbers array<long>")

    def wait(self, events: np.ndarray) -> None:
        self.waiting.appendList([(events[i : i + PACK].tobytes(),) for i in range(0, len(events), PACK)])
        self.handle.registerTimer(int(events["t"].min()))

    def decided(self, now: int) -> Iterator[tuple]:
        """event_id and result of each event that is due; the others wait on."""
        events = np.frombuffer(b"".join(bytes(e[0]) for e in self.waiting.get() or ()), EVENT)
        events = events[np.lexsort((events["event_id"], ~events["known"], events["t"]))]
        n = int(np.searchsorted(events["t"], now, "right"))
        had = self.kept.get()
        kept = list(had[0]) if had is not None else None
        for t, event_id, known, ok in events[:n].tolist():
            if kept is not None and (end := self.until(kept)) is not None and end <= t:
                kept = None
            result, kept = self.decide(kept, t, ok)
            yield event_id if known else None, result
        if n:
            self.waiting.clear()
        if 0 < n < len(events):
            self.wait(events[n:])
        end = None if kept is None else self.until(kept)
        if kept is None or end is not None and end <= now and n == len(events):
            if had is not None:
                self.kept.clear()
        elif n:
            self.kept.update((kept,))
            if end is not None and end > now:
                self.handle.registerTimer(end)

    def handleInputRows(self, key, rows, timerValues):
        self.wait(np.array([(r["t"], r["event_id"] or 0, r["event_id"] is not None, bool(r["ok"])) for r in rows], EVENT))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for event_id, result in self.decided(timerValues.getCurrentWatermarkInMs()):
            yield Row(key=key[0], event_id=event_id, result=result)

    def close(self) -> None:
        pass


class InPacks(InTimeOrder):
    """The same for events that come packed and go in rows of up to OUT of them, for a row costs Python far more than an event. Those that are
    older than the watermark when they come are left out."""

    def handleInputRows(self, key, rows, timerValues):
        events = np.frombuffer(b"".join(r["events"] for r in rows), EVENT)
        events = events[events["t"] >= timerValues.getCurrentWatermarkInMs()]
        if len(events):
            self.wait(events)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        decided = self.decided(timerValues.getCurrentWatermarkInMs())
        while some := list(islice(decided, OUT)):
            yield Row(key=key[0], event_ids=[e for e, _ in some], results=[r for _, r in some])


def in_time_order(events: DataFrame, who: str, decide: Callable, until: Callable, late: str) -> DataFrame:
    """key, event_id, result (whole numbers) of each event of a stream (who, event_id, ts, and ok if there is such a column). Events without a time are left out."""
    kind = events.schema[who].dataType.simpleString()
    ok = F.col("ok") if "ok" in events.columns else F.lit(True)
    rows = events.select(F.col(who).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), ok.alias("ok"))
    rows = rows.where(F.col("ts").isNotNull()).withWatermark("ts", late).select("key", F.unix_millis("ts").alias("t"), "event_id", "ok")
    packs = rows.repartition("key").mapInArrow(packed, f"key {kind}, events binary")
    out = packs.groupBy("key").transformWithState(InPacks(decide, until), f"key {kind}, event_ids array<long>, results array<array<long>>", "Append", "EventTime")
    out = out.select("key", F.explode(F.arrays_zip("event_ids", "results")).alias("e"))
    return out.select("key", F.col("e.event_ids").alias("event_id"), F.col("e.results").alias("result"))


def reviewed(events: DataFrame, who: str = "card", late: str = "10 minutes", lifetime_ms: int | None = None) -> DataFrame:
    """who, event_id, box, correct, incorrect: a card's state after each review. With a lifetime, a card without reviews for so long counts as new; else
    its four numbers stay."""

    def decide(kept, t, ok):
        box, right, wrong, _ = kept or (1, 0, 0, 0)
        kept = [min(box + 1, 5), right + 1, wrong, t] if ok else [1, right, wrong + 1, t]
        return kept[:3], kept

    out = in_time_order(events, who, decide, lambda kept: None if lifetime_ms is None else kept[3] + lifetime_ms, late)
    return out.select(F.col("key").alias(who), "event_id", *(F.col("result")[i].alias(c) for i, c in enumerate(("box", "correct", "incorrect"))))


def limited(events: DataFrame, who: str, limit: int = K.LIMITER_CALLS, span_ms: int = K.LIMITER_MS, late: str = "10 minutes") -> DataFrame:
    """who, event_id, accepted: fewer than limit accepted calls are at most span_ms older. What is kept ends when the last accepted call is older."""

    def decide(kept, t, ok):
        recent = [x for x in kept or [] if t - x <= span_ms]
        took = len(recent) < limit
        return [int(took)], [*recent, t] if took else recent

    out = in_time_order(events, who, decide, lambda kept: kept[-1] + span_ms + 1, late)
    return out.select(F.col("key").alias(who), "event_id", (F.col("result")[0] == 1).alias("accepted"))


def under_quota(events: DataFrame, who: str, quota: int = K.DAILY_QUOTA, late: str = "10 minutes") -> DataFrame:
    """who, event_id, nth: the event's place in its owner's day, 0 beyond the quota. What is kept ends with the day."""

    def decide(kept, t, ok):
        day, n = kept if kept and kept[0] == t // K.DAY_MS else (t // K.DAY_MS, 0)
        return [n + 1 if n < quota else 0], [day, min(n + 1, quota)]

    out = in_time_order(events, who, decide, lambda kept: (kept[0] + 1) * K.DAY_MS, late)
    return out.select(F.col("key").alias(who), "event_id", F.col("result")[0].alias("nth"))


def cached(events: DataFrame, key: str, ttl_ms: int = K.FALLBACK_TTL_MS, late: str = "10 minutes") -> DataFrame:
    """key, event_id, hit: the key was stored at most ttl_ms before; a miss stores it anew. What is kept ends with its lifetime."""

    def decide(kept, t, ok):
        return [int(bool(kept))], kept or [t]

    out = in_time_order(events, key, decide, lambda kept: kept[0] + ttl_ms + 1, late)
    return out.select(F.col("key").alias(key), "event_id", (F.col("result")[0] == 1).alias("hit"))


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream gives for all that its source has now, as a table: it is run until its source is read up, then the watermark of the last event
    holds. With a folder a later call goes on where an earlier one ended."""
    spark = stream.sparkSession
    at = folder or scratch(spark, "stream")
    with state_store(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


#: A table for first_ever() and once(): which micro-batches a store has taken in.
BATCHES = Table("batch long, rows long", "batch", buckets=1)


def once(stream: DataFrame, store: TableStore, change: Callable, folder: str, log: str = "batches") -> None:
    """Takes all that a stream's source has now into a store, micro-batch by micro-batch, each exactly once: change(transaction, batch) and the
    batch's number in the table log are one transaction. A run that breaks off, before or after that commit, is resumed from folder,
    and a batch that comes again finds its number there."""

    def take(batch: DataFrame, number: int) -> None:
        def both(tx):
            if tx.read(log).where(F.col("batch") == number).isEmpty():
                n = change(tx, batch)
                tx.insert(log, batch.sparkSession.createDataFrame([(number, n or 0)], "batch long, rows long"))

        store.run(both)

    with state_store(stream.sparkSession):
        stream.writeStream.foreachBatch(take).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def first_ever(events: DataFrame, store: TableStore, name: str, order: list[str], folder: str) -> None:
    """Puts the first event of each key into a store's table, however long ago it came: the keys are those of the table, on disk, so
    nothing grows in memory and no key comes in again."""
    once(events, store, lambda tx, batch: tx.insert_or_ignore(name, batch, order), folder)
