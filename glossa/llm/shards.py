"""Sharding by size-tiered compaction (operator 10), in DataFrame operations only.

Arrivals are written as runs of small immutable files. Runs whose bytes lie in the same tier (powers of the fan-in) are
merged, as soon as a tier has fan-in of them, into one run of files near the target size: partitions are joined without
a shuffle, so no key is hot. Every change commits a manifest. Its table is written first; then a folder that holds only a
file named by the writer's token is renamed to the number that follows the version the change was planned on. A rename
moves the folder at once or, where another writer has taken the number, leaves that writer's token in its place: then the
change is planned anew on the newer version, and a merge whose runs are gone is dropped. So a version is whole or absent, and
no two changes build on the same one. Folders of commits stay for good, also when their version's files are gone, so a number is
never free again and a writer that was late by any time finds it taken. Readers follow the highest version, so they see the old
or the new files, never both.

vacuum() deletes what no kept version names. The newest versions are kept, and for a stated time also each version that another has
followed; files that no version names yet, of writers still at work or dead ones, are left alone for that time too. A writer whose version's manifest
was deleted meanwhile plans anew; readers must finish within the time, and writers too, whose files are else gone (an error, never a version without them).

The folder must lie in a file system with atomic renames (HDFS, or a local or mounted disk that all share); object stores copy
on rename and do not qualify.

Cases: all columns, nulls, very long texts and repeated rows are kept as they are, whatever a column's name; an arrival
without rows makes no run; a store without runs reads as an empty table; a folder of a commit without a token (none is made
by a writer that dies, for renames are atomic) is no version. The driver holds a row per run, of which there are fan-in times
the number of tiers; append(by=) makes a run of each value of its column, so that column must have few."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import free, shared_dir

MANIFEST = "run string, tier int, path string, bytes long, rows long"


class ShardStore:
    """root: a folder that driver and executors share. base_bytes: the top of the lowest tier."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fan_in, self.base = spark, root.rstrip("/"), target_bytes, fan_in, base_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, files: bool) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if f.isFile() == files) if self._fs.exists(at) else []

    def _token(self, version: int) -> str | None:
        """The token of the writer that committed a version."""
        return next((n for n in self._names(f"commits/{version}", True) if not n.startswith(".")), None)

    def _written(self) -> dict[int, list[str]]:
        """Tokens of the manifests that are there, by the version they were written for; committed or not."""
        out: dict[int, list[str]] = {}
        for version, _, token in (name.partition("-") for name in self._names("manifests", False)):
            out.setdefault(int(version), []).append(token)
        return out

    def versions(self) -> list[int]:
        """Committed versions whose manifests are kept."""
        return sorted(v for v, tokens in self._written().items() if self._token(v) in tokens)

    def newest(self) -> int:
        """The highest committed version, 0 if there is none."""
        written = self._written()
        return next((v for v in sorted(written, reverse=True) if self._token(v) in written[v]), 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per file of a version (the newest if none is given)."""
        version = self.newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}-{self._token(version)}")

    def _claim(self, version: int, token: str) -> bool:
        """Makes token the writer of version, if it has none."""
        made, at = f"{self.root}/commits/.new-{token}", self._path(f"{self.root}/commits/{version}")
        self._fs.create(self._path(f"{made}/{token}"), False).close()
        try:
            self._fs.rename(self._path(made), at)
        except Exception as e:  # some file systems raise where the name is taken
            if not self._fs.exists(at):
                raise e
        won = self._token(version) == token
        for left in () if won else (made, f"{self.root}/commits/{version}/.new-{token}"):
            self._fs.delete(self._path(left), True)
        return won

    def _commit(self, change: Callable[[DataFrame], DataFrame | None]) -> int | None:
        """Commits change(newest manifest) as the version after it; plans anew when another writer was faster. None: nothing to commit."""
        while True:
            planned, token = self.newest(), uuid.uuid4().hex
            path = f"{self.root}/manifests/{planned + 1}-{token}"
            try:
                files = change(self.manifest(planned))
                if files is None:
                    return None
                files.coalesce(1 + files.count() // 1_000_000).write.parquet(path)
            except Exception:
                if not planned or planned in self.versions():
                    raise
                continue  # the manifest was vacuumed while the change was planned on it
            if not self._fs.exists(self._path(path)):
                raise RuntimeError("the change took longer than vacuum() leaves the files of unfinished ones")
            if self._claim(planned + 1, token):
                return planned + 1
            self._fs.delete(self._path(path), True)

    def _tier(self, size: int) -> int:
        return 0 if size <= self.base else math.ceil(math.log(size / self.base, self.fan_in) - 1e-9)

    def _files(self, folder: str, schema, run) -> DataFrame:
        """The manifest rows of files below folder, without those that hold no rows."""
        rows = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        files = rows.groupBy("path").agg(F.any_value("bytes").alias("bytes"), F.count("*").alias("rows"))
        return files.withColumn("run", run(F.col("path")))

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Writes arrivals as a run of small files (one run for each value of the column by) and commits them; by is not stored."""
        name = f"run-{uuid.uuid4().hex[:12]}"
        folder = f"{self.root}/data/{name}"
        schema = arrivals.drop(by).schema if by else arrivals.schema
        (arrivals.write.partitionBy(by) if by else arrivals.write).parquet(folder)
        if by:
            files = self._files(folder, schema, lambda p: F.concat(F.lit(f"{name}/"), F.regexp_extract(p, "/([^/=]*=[^/]*)/[^/]*$", 1)))
        else:
            files = self._files(folder, schema, lambda p: F.lit(name))
        sizes = files.groupBy("run").agg(F.sum("bytes").alias("size"))
        tier = F.when(F.col("size") <= self.base, 0).otherwise(F.ceil(F.log(float(self.fan_in), F.col("size") / self.base) - 1e-9))
        new = files.join(sizes.select(F.col("run").alias("r"), tier.cast("int").alias("tier")), F.col("run") == F.col("r")).select("run", "tier", "path", "bytes", "rows")
        return self._commit(lambda manifest: manifest.unionAll(new))

    def runs(self) -> list[tuple]:
        """(run, tier, bytes, rows), by run: one row per run, of which there are about fan-in times as many as tiers."""
        return [tuple(r) for r in self.manifest().groupBy("run", "tier").agg(F.sum("bytes"), F.sum("rows")).orderBy("run").collect()]

    def compact(self, schema) -> int:
        """Merges tiers, the lowest first, until none has fan-in runs; returns the newest version."""
        while True:
            tiers: dict[int, list[tuple]] = {}
            for r in self.runs():
                tiers.setdefault(r[1], []).append(r)
            full = min((t for t, rs in tiers.items() if len(rs) >= self.fan_in), default=None)
            if full is None:
                return self.newest()
            self.merge(tiers[full], full, schema)

    def merge(self, runs: list[tuple], tier: int, schema) -> int | None:
        """Writes runs (of runs()) as one run and commits it in their place; None, and nothing, if any of them is gone by then."""
        name, size = f"run-{uuid.uuid4().hex[:12]}", sum(r[2] for r in runs)
        folder, names = f"{self.root}/data/{name}", [r[0] for r in runs]
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{r}" for r in names))
        rows.coalesce(max(1, round(size / self.target))).write.parquet(folder)
        new = self._files(folder, schema, lambda p: F.lit(name)).withColumn("tier", F.lit(max(tier + 1, self._tier(size)))).select("run", "tier", "path", "bytes", "rows")

        def change(manifest: DataFrame) -> DataFrame | None:
            if manifest.where(F.col("run").isin(names)).select("run").distinct().count() < len(names):
                return None
            return manifest.where(~F.col("run").isin(names)).unionAll(new)

        version = self._commit(change)
        if version is None:
            self._fs.delete(self._path(folder), True)
        return version

    def _age(self, path: str) -> float:
        """Seconds since a file or folder was last changed, 0 if it is gone."""
        at = self._path(f"{self.root}/{path}")
        return time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 if self._fs.exists(at) else 0.0

    def vacuum(self, keep: int = 1, seconds: float = 86_400) -> None:
        """Deletes the manifests of versions that are neither among the last keep ones nor were followed by another less than seconds ago,
        and files and manifests of at least that age that no kept version names. Commits stay."""
        have = self.versions()
        kept = {v for i, v in enumerate(have) if i >= len(have) - max(1, keep) or self._age(f"commits/{have[i + 1]}") < seconds}
        named = {r[0] for v in kept for r in self.manifest(v).select("run").distinct().collect()}
        for run in self._names("data", False):
            parts = [f"{run}/{p}" for p in self._names(f"data/{run}", False) if "=" in p] or [run]
            for part in parts:
                if part not in named and self._age(f"data/{part}") >= seconds:
                    self._fs.delete(self._path(f"{self.root}/data/{part}"), True)
        for v, tokens in self._written().items():
            for token in tokens:
                committed = v in have and token == self._token(v)
                if committed and v not in kept or not committed and self._age(f"manifests/{v}-{token}") >= seconds:
                    self._fs.delete(self._path(f"{self.root}/manifests/{v}-{token}"), True)

    def read(self, schema, where: str | None = None) -> DataFrame:
        """The rows of the newest version; where: the name of a column that is added, with each row's run, tier and shard (its file)."""
        runs = self.runs()
        at = "struct<run: string, tier: int, shard: string>"
        if not runs:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(where, F.lit(None).cast(at)) if where else rows
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{r[0]}" for r in runs))
        if not where:
            return rows
        path = F.regexp_replace(F.col("_metadata.file_path"), "^.*/data/", "")
        run, shard = (F.regexp_extract(path, p, 1) for p in ("^(.*)/[^/]*$", "([^/]*)$"))
        tiers = F.create_map(*(F.lit(x) for r in runs for x in r[:2]))
        return rows.select(*(F.col(f"`{c}`") for c in rows.columns), F.struct(run.alias("run"), tiers[run].alias("tier"), shard.alias("shard")).alias(where))


#: Shares, in 64ths, of the arrivals into which op10 deals a table: four small, four middling, four large ones.
SHARES = (1, 1, 1, 1, 3, 3, 3, 3, 12, 12, 12, 12)


def sharded(docs: DataFrame, key: str = "doc_id", target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20) -> DataFrame:
    """Deals docs into arrivals by a hash of the key, appends and compacts them, and returns key, run, tier, shard and version of each row."""
    store = ShardStore(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/store", target_bytes, fan_in, base_bytes)
    borders = [sum(SHARES[:i]) for i in range(1, len(SHARES) + 1)]
    of = F.coalesce(*(F.when(F.pmod(F.xxhash64(key), F.lit(64)) < b, i) for i, b in enumerate(borders)))
    arrival, at = free("arrival", docs.columns), free("at", docs.columns)
    store.append(docs.withColumn(arrival, of), by=arrival)
    version = store.compact(docs.schema)
    store.vacuum(seconds=0)  # nobody else knows this store
    rows = store.read(docs.schema, where=at)
    return rows.select(F.col(f"`{key}`"), *(F.col(f"`{at}`.{c}").alias(c) for c in ("run", "tier", "shard")), F.lit(version).cast("long").alias("version"))
