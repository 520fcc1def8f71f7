"""Tables that change together: staged rows of several tables become visible by one manifest, or not at all.

A commit writes its rows to new folders, then one manifest that names the folders of every table. Readers see the latest
manifest; what a killed commit left behind no manifest names. One writer at a time commits to a store; a commit whose
starting point is no longer the latest is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "version long, commit string, content string"


class Conflict(RuntimeError):
    """The store has moved on since this unit of work began."""


class DuplicateKey(ValueError):
    """A key is already stored, or staged twice."""


class Store:
    """A folder that all executors share. ``tables``: name -> schema (DDL); ``keys``: name -> the column that is unique."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], keys: dict[str, str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schemas = {t: StructType.fromDDL(ddl) for t, ddl in tables.items()}
        spark.createDataFrame([], _MANIFEST).write.mode("append").json(f"{self.path}/manifests")

    def manifest(self) -> dict:
        """version, tables (name -> folders) and batches (writer -> last batch) of the latest commit; one row a commit is read."""
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests").where("content is not null")
        last = rows.orderBy(F.desc("version"), "commit").first()
        return json.loads(last["content"]) | {"version": last["version"]} if last else {"version": 0, "tables": {}, "batches": {}}

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        folders = (at or self.manifest())["tables"].get(table, [])
        schema = self.schemas[table]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self) -> UnitOfWork:
        return UnitOfWork(self)


class UnitOfWork:
    """``with store.begin() as work``: stage, then ``commit``; leaving without it, or by an error, changes nothing."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.staged: dict[str, list[DataFrame]] = {}
        self.deleted: dict[str, list[DataFrame]] = {}

    def __enter__(self) -> UnitOfWork:
        return self

    def __exit__(self, *_) -> None:
        self.staged, self.deleted = {}, {}

    def read(self, table: str) -> DataFrame:
        """What was committed when the work began; staged rows are not among it."""
        return self.store.read(table, self.base)

    def exists(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is stored."""
        key = self.store.keys[table]
        return keys.join(self.read(table).select(key), key, "left_semi")

    def add(self, table: str, rows: DataFrame) -> None:
        """Stage rows with new keys; a key that is stored or staged already is refused."""
        key = self.store.keys[table]
        rows = rows.select(*self.store.schemas[table].names)
        earlier = [self.read(table).select(key), *(s.select(key) for s in self.staged.get(table, []))]
        if any(not rows.join(e, key, "left_semi").isEmpty() for e in earlier) or not rows.groupBy(key).count().where("count > 1").isEmpty():
            raise DuplicateKey(f"{table}: {key}")
        self.staged.setdefault(table, []).append(rows)

    def delete(self, table: str, keys: DataFrame) -> None:
        self.deleted.setdefault(table, []).append(keys.select(self.store.keys[table]))

    def commit(self, writer: str | None = None, batch: int | None = None) -> int:
        """Make all of it visible at once; returns the version. ``writer`` and ``batch`` are kept, so that a batch is not taken twice."""
        store, name = self.store, uuid.uuid4().hex
        tables = {t: list(f) for t, f in self.base["tables"].items()}
        for table in {*self.staged, *self.deleted}:
            key, folder = store.keys[table], f"{store.path}/data/{table}/{name}"
            new = None
            for rows in self.staged.get(table, []):
                new = rows if new is None else new.unionByName(rows)
            if table in self.deleted:  # written anew without the deleted keys
                new, tables[table] = self.read(table) if new is None else self.read(table).unionByName(new), []
                for keys in self.deleted[table]:
                    new = new.join(keys, key, "left_anti")
            new.write.parquet(folder)
            tables.setdefault(table, []).append(folder)
        if store.manifest()["version"] != self.base["version"]:
            raise Conflict(store.path)
        batches = self.base["batches"] | ({writer: batch} if writer is not None else {})
        version = self.base["version"] + 1
        content = json.dumps({"tables": tables, "batches": batches}, sort_keys=True)
        store.spark.createDataFrame([(version, name, content)], _MANIFEST).coalesce(1).write.mode("append").json(f"{store.path}/manifests")
        self.__exit__()
        return version
