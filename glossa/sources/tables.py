"""Tables of a store that change together: a transaction over several of them is one version, seen whole or not at all.

A table's rows lie in Parquet parts, dealt into buckets by a hash of the key; a version lists the parts of all tables. Inserts add parts; updates,
upserts and deletes write the buckets anew that hold their keys, and no others. A version's list is written to a folder of its
own, and renaming that folder to the next number commits it. A rename finds the number free or taken: then another writer was
faster, and the transaction runs again on what that writer left. Numbers are never free again, for folders of commits stay. What a
writer wrote that failed before its rename is in no version. Needs a file system with atomic renames (HDFS or a shared disk).

Counts that a transaction returns come from the parts' row counts or from the join that finds the rows, so nothing is
collected but a row per part."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators import store as S
from glossa.sources.readers import scratch

PARTS, BUCKET = "name string, bucket int, folder string, rows long", "store_bucket"
T = TypeVar("T")


@dataclass(frozen=True)
class Table:
    """schema: columns as DDL. key: its values are unique and not null, as are those of unique. parent: another table and the own column that holds its key; rows go with their parent."""

    schema: str
    key: str
    unique: str | None = None
    parent: tuple[str, str] | None = None
    buckets: int = 16

    def bucket(self, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(column or self.key), F.lit(self.buckets)).cast("int")


class Conflict(Exception):
    """Rows would repeat a key or a unique value."""


class TableStore:
    """root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _age(self, path: str) -> float:
        """Seconds since a folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{path}")).getModificationTime() / 1000

    def newest(self) -> int:
        """The highest version, 0 before the first."""
        return max((int(n) for n in self._names("commits") if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[tuple]:
        """(table, bucket, folder, rows) of a version, the newest if none is given."""
        version = self.newest() if version is None else version
        return sorted(map(tuple, self.spark.read.schema(PARTS).json(f"{self.root}/commits/{version}").collect())) if version else []

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(name, [p[2] for p in self.parts(version) if p[0] == name])

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _claim(self, version: int, token: str) -> bool:
        """Makes the list of parts that token has written the version, if there is none."""
        new, at = f"{self.root}/commits/.new-{token}", f"{self.root}/commits/{version}"
        try:
            if not self._fs.exists(self._path(at)):
                self._fs.rename(self._path(new), self._path(at))
        except Exception as e:  # some file systems raise where the name is taken
            if not self._fs.exists(self._path(at)):
                raise e
        won = self._fs.exists(self._path(f"{at}/_by-{token}"))
        for left in () if won else (new, f"{at}/.new-{token}"):
            self._fs.delete(self._path(left), True)
        return won

    def run(self, change: Callable[[Transaction], T]) -> T:
        """Commits what change does to the newest version and returns what it returns. change runs again where another writer was faster; an error
        in it, and a transaction that changes nothing, commit nothing."""
        while True:
            planned, token = self.newest(), uuid.uuid4().hex
            tx = Transaction(self, self.parts(planned))
            out = change(tx)
            if sorted(tx.parts) == sorted(tx.before):
                return out
            new = f"{self.root}/commits/.new-{token}"
            self.spark.createDataFrame(tx.parts, PARTS).coalesce(1).write.json(new)
            self._fs.create(self._path(f"{new}/_by-{token}"), False).close()
            if self._claim(planned + 1, token):
                return out

    def vacuum(self, keep: int = 1, seconds: float = 86_400) -> int:
        """Deletes parts that neither the last keep versions, nor those followed by another less than seconds ago, nor changes younger than that name.
        Returns how many folders went. Older versions can no longer be read, their numbers stay taken."""
        last = self.newest()
        kept = [v for v in range(1, last + 1) if v > last - max(1, keep) or self._age(f"commits/{v + 1}") < seconds]
        named, gone = {p[2] for v in kept for p in self.parts(v)}, 0
        for name in self._names("data"):
            for change in self._names(f"data/{name}"):
                for part in self._names(f"data/{name}/{change}"):
                    folder = f"{name}/{change}/{part}"
                    if part.startswith(BUCKET) and folder not in named and self._age(f"data/{folder}") >= seconds:
                        gone += bool(self._fs.delete(self._path(f"{self.root}/data/{folder}"), True))
        return gone


class Transaction:
    """Changes of a store's tables, which see each other; none is seen by others before the commit."""

    def __init__(self, store: TableStore, parts: list[tuple]):
        self.store, self.before, self.parts = store, list(parts), list(parts)

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        return self.store._rows(name, [p[2] for p in self.parts if p[0] == name and (buckets is None or p[1] in buckets)])

    def count(self, name: str, buckets: set[int] | None = None) -> int:
        return sum(p[3] for p in self.parts if p[0] == name and (buckets is None or p[1] in buckets))

    def _write(self, name: str, rows: DataFrame, instead: set[int] | None = None) -> int:
        """Adds rows as parts, in place of those of some buckets; returns how many rows a table has more."""
        table, change, before = self.store.tables[name], uuid.uuid4().hex[:16], self.count(name)
        columns = self.store.spark.createDataFrame([], table.schema).schema
        typed = rows.select(*(F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in columns)).withColumn(BUCKET, table.bucket())
        at = f"{self.store.root}/data/{name}/{change}"
        # A bucket beyond the advised size is written by several tasks.
        typed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(at)
        new = [(name, b, f"{name}/{change}/{BUCKET}={b}", n) for b, n in self.store.spark.read.schema(f"`{table.key}` string, {BUCKET} int").parquet(at).groupBy(BUCKET).count().collect()] if any(n.startswith(BUCKET) for n in self.store._names(f"data/{name}/{change}")) else []
        self.parts = [p for p in self.parts if not (instead and p[0] == name and p[1] in instead)] + new
        return self.count(name) - before

    def _buckets(self, name: str, keys: DataFrame, column: str) -> set[int]:
        """The buckets in which keys lie."""
        return {r[0] for r in keys.select(self.store.tables[name].bucket(column)).distinct().collect()}

    def _unique(self, name: str) -> list[str]:
        table = self.store.tables[name]
        return [c for c in (table.key, table.unique) if c]

    def insert(self, name: str, rows: DataFrame) -> int:
        """Adds rows, all of them: a null, repeated or present key or unique value is a Conflict. Returns their number."""
        table = self.store.tables[name]
        for c in self._unique(name):
            values = rows.select(c)
            if not values.where(F.col(c).isNull()).isEmpty() or not values.groupBy(c).count().where("count > 1").isEmpty():
                raise Conflict(f"{name}.{c} repeats")
            there = self.read(name, self._buckets(name, rows, c) if c == table.key else None)
            if not values.join(there, c, "left_semi").isEmpty():
                raise Conflict(f"{name}.{c} is there already")
        return self._write(name, rows)

    def insert_or_ignore(self, name: str, rows: DataFrame, order: list[str]) -> int:
        """Adds rows one after the other by order, but those of which the key or unique value is null or there already. Returns how many came in.

        A row that another one keeps out keeps out none itself. So rows come in by rounds: first those that no earlier row
        shares a value with; what they keep out goes, and the next round deals with the rest."""
        values = self._unique(name)
        rest = rows.where(" and ".join(f"`{c}` is not null" for c in values))
        for c in values:
            rest = rest.join(self.read(name).select(c), c, "left_anti")
        taken = None
        while True:
            firsts = [F.row_number().over(Window.partitionBy(c).orderBy(*order)) == 1 for c in values]
            marked = rest.withColumns({f"_first{i}": f for i, f in enumerate(firsts)})
            marked = self._stored(marked.withColumn("_in", F.expr(" and ".join(f"_first{i}" for i in range(len(values))))).drop(*(f"_first{i}" for i in range(len(values)))))
            came = marked.where("_in").drop("_in")
            taken = came if taken is None else taken.unionByName(came)
            rest = marked.where("not _in").drop("_in")
            for c in values:
                rest = rest.join(came.select(c), c, "left_anti")
            if len(values) == 1 or rest.isEmpty():
                return self._write(name, taken)

    def _stored(self, df: DataFrame) -> DataFrame:
        at = scratch(self.store.spark, "rows")
        df.write.parquet(at)
        return self.store.spark.read.schema(df.schema).parquet(at)

    def upsert(self, name: str, rows: DataFrame, seq: str) -> int:
        """Puts rows in place of those with their keys, of a key the one with the greatest seq (a column of rows). Returns how many keys are new."""
        table = self.store.tables[name]
        touched = self._buckets(name, rows, table.key)
        last = rows.groupBy(table.key).agg(F.max_by(F.struct(*rows.columns), seq).alias("row")).select("row.*")
        there = self.read(name, touched).join(last.select(table.key), table.key, "left_anti")
        n = self._write(name, there.unionByName(last.select(*there.columns)), touched)
        self._checked(name)
        return n

    def update(self, name: str, changes: DataFrame, columns: list[str]) -> int:
        """Gives rows the values of changes (one row a key; null: no change) in columns. Returns how many rows it met."""
        table = self.store.tables[name]
        touched = self._buckets(name, changes, table.key)
        rows = self.read(name, touched)
        met = rows.join(changes.select(table.key), table.key, "left_semi").count()
        if met:
            self._write(name, S.updated(rows, changes, table.key, columns), touched)
            if table.unique in columns:
                self._checked(name)
        return met

    def _checked(self, name: str) -> None:
        unique = self.store.tables[name].unique
        if unique and not self.read(name).groupBy(unique).count().where("count > 1").isEmpty():
            raise Conflict(f"{name}.{unique} repeats")

    def delete(self, name: str, keys: DataFrame) -> dict[str, int]:
        """Deletes the rows of keys (a column of the key's name) and all rows that hang on them. Returns how many of each table went."""
        table, out = self.store.tables[name], {}
        for child, t in self.store.tables.items():
            if t.parent and t.parent[0] == name:
                on = t.parent[1]
                below = self.read(child).join(keys.select(F.col(table.key).alias(on)), on, "left_semi").select(t.key)
                for of, n in self.delete(child, below).items():
                    out[of] = out.get(of, 0) + n
        touched = self._buckets(name, keys, table.key)
        gone = -self._write(name, self.read(name, touched).join(keys.select(table.key), table.key, "left_anti"), touched) if touched & {p[1] for p in self.parts if p[0] == name} else 0
        return out | {name: gone}

    def clear(self, *names: str) -> dict[str, int]:
        """Empties tables. Returns how many rows each had."""
        had = {n: self.count(n) for n in names}
        self.parts = [p for p in self.parts if p[0] not in names]
        return had
