"""The sliding limiter on a table, and streams of built-in aggregates."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import constants as K


def segments(calls: DataFrame, who: str, span_ms: int, block_ms: int = K.DAY_MS // 24) -> DataFrame:
    """calls (who, t, event_id) with start: the latest call of the owner, up to this one, that none came before within span_ms.

    Gaps are found inside blocks of time, and between a block's first call and the last one before it by a window over an
    owner's blocks, so no task sorts all calls of an owner."""
    rows = calls.withColumn("_block", F.floor(F.col("t") / block_ms))
    inside = Window.partitionBy(who, "_block").orderBy("t", "event_id")
    begins = F.when(F.lag("t").over(inside).isNull() | (F.col("t") - F.lag("t").over(inside) > span_ms), F.col("t"))
    rows = rows.withColumn("_begins", begins)
    each = rows.groupBy(who, "_block").agg(F.min("t").alias("_from"), F.max("t").alias("_to"), F.max("_begins").alias("_last"))
    over = Window.partitionBy(who).orderBy("_block")
    each = each.withColumn("_joined", F.coalesce(F.col("_from") - F.lag("_to").over(over) <= span_ms, F.lit(False)))
    # A block whose calls all go on from the one before begins nothing of its own.
    own = F.when(~(F.col("_joined") & (F.col("_last") == F.col("_from"))), F.col("_last"))
    before = F.last(own, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(F.col(who).alias("_who"), F.col("_block").alias("_b"), "_from", "_joined", before.alias("_before"))
    met = rows.join(each, F.col(who).eqNullSafe(F.col("_who")) & (F.col("_block") == F.col("_b")))
    last = F.max(F.when(~(F.col("_joined") & (F.col("_begins") == F.col("_from"))), F.col("_begins"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("start", F.coalesce(last, "_before")).select(*calls.columns, "start")


def sliding_limiter(calls: DataFrame, who: str, limit: int = K.LIMITER_CALLS, span_ms: int = K.LIMITER_MS) -> DataFrame:
    """who, event_id, accepted: a call is accepted if fewer than limit accepted ones are at most span_ms older.

    After a gap of more than span_ms nothing is remembered, so an owner's calls are dealt over tasks at such gaps, and folded in
    time order between them; a task keeps the last accepted times of one stretch. Calls without a time are left out."""

    def run(batches):
        stretch, recent = None, deque()
        for batch in batches:
            out = []
            for o, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (o, s) != stretch:
                    stretch, recent = (o, s), deque()
                while recent and t - recent[0] > span_ms:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.bool_())], [who, "event_id", "accepted"])

    kind = calls.schema[who].dataType.simpleString()
    rows = calls.select(who, "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    cut = segments(rows, who, span_ms).select(who, "start", "t", "event_id").repartition(who, "start").sortWithinPartitions(who, "start", "t", "event_id")
    return cut.mapInArrow(run, f"{who} {kind}, event_id long, accepted boolean")


def minute_counts(events: DataFrame, who: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Calls per owner and minute, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), who).agg(F.count("*").alias("n")).select(who, F.col("window.start").alias("minute"), "n", F.greatest(F.col("n") - K.PER_MINUTE, F.lit(0)).alias("rejected"))


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
