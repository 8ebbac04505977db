"""What the operators of this subpackage share: shared-folder tables and byte-level text access in Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; a longer text is taken alone and whole.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and driver and executors are one process (as in tests) a temporary folder is used and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-glossa-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glossa-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read from there: a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), name)
    out = df.write.mode("error")
    (out.option("compression", codec) if codec else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, columns: list[str]) -> str:
    """name, with as many underscores behind it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes in fewer files than there are cores (a file of one row group is read by one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def spread_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, seed: str, share: int = 1000) -> DataFrame:
    """left with the columns of right (unique by on, but for on and weight) that has its value of on, null where none has.

    weight: how many rows of left have the value, of total. Values with more than total / share rows, of which there are fewer
    than share, are broadcast; rows without a partner to look for go by the column seed: no task gets all rows of a value."""
    bound, values = total // share, [c for c in right.columns if c not in (on, weight)]
    hot = F.broadcast(right.where(F.col(weight) > bound).select(F.col(on).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values)))
    cold = right.where(F.col(weight) <= bound).select(F.col(on).alias("_cold"), F.lit(True).alias("_is"), *(F.col(c).alias(f"_cold_{c}") for c in values))
    met = left.join(hot, F.col(on) == F.col("_hot"), "left").withColumn("_asks", F.col(on).isNotNull() & F.col("_hot").isNull())
    other = F.xxhash64(seed).cast("string") if left.schema[on].dataType.typeName() == "string" else F.xxhash64(seed)
    met = met.withColumn("_by", F.when(F.col("_asks"), F.col(on)).otherwise(other))
    met = met.join(cold, (F.col("_by") == F.col("_cold")) & (F.col("_asks") == F.col("_is")), "left")
    return met.select(*left.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch with at most about limit bytes of text each, with the bytes and offsets of their texts (null: empty)."""
    arr = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, all else as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of True that no text border cuts through, and for each text the index of its first run."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = offs[(offs > 0) & (offs < n)]
    start[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _BASE_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        out = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INV, np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[s:e], by prefix sums of a polynomial: the same bytes give the same hash wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", len(data)), out=total[1:])
    h = (total[e] - total[s]) * _power("down", len(data) + 1)[s]
    return mix(h + (e - s).astype(np.uint64))
